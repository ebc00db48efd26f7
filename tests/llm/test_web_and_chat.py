"""URL rules, archives, chats and neighbours against plain Python."""

from __future__ import annotations

import hashlib
import io
import random
import tempfile

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from kinegrid.llm import ann, chat, warc
from kinegrid.llm import url_filter as uf


def brute_verdict(url: str | None) -> tuple:
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


URLS = [
    None, "", "example.com/en/7", "http://example.com/en/7", "HTTP://WWW.Example.COM/en/71?x#y", "http://com/en/", "http://xcom/en/", "http://a.com/EN/",
    "http://a.net/de/8", "http://example.net/de/80", "http://notexample.net/de/8", "http://b.org/es/", "http://b.org", "http://b.org?/es/", "x://y://a.com/en/", "http://É.com/en/", "http://a.com:80/en/", "http:///en/", "http://a.com\n/en/",
]


def test_url_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    for inline in (500, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(pages, uf.RULES, max_inline=inline).collect()}
        assert got == {k: brute_verdict(u) for k, u in enumerate(URLS * 2)}
    assert uf.judge_urls(pages.limit(0), uf.RULES).collect() == []
    assert {r.verdict for r in uf.judge_urls(pages, [], default="block").collect()} == {"block"}


def test_url_patterns_without_tokens_and_with_many_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.example/ads/banner.js"), (2, "http://a.example/news")], "page_id long, url string")
    rules = [uf.UrlRule("block", "*banner*", "banner"), uf.UrlRule("block", "/ads/", "/ads/", ("ads",)), *(uf.UrlRule("allow", f"r{k}", f"/never{k}/", (f"never{k}",)) for k in range(600))]
    for inline in (1000, 0):
        got = {r.page_id: (r.rule, r.verdict) for r in uf.judge_urls(pages, rules, max_inline=inline).collect()}
        assert got == {1: ("*banner*", "block"), 2: (None, "allow")}


PAGES = [(3, "u3", "<p>same</p>"), (1, "u\n1%", "<p>same</p>"), (2, None, None), (5, "u5", ""), (4, "u4", "é" * 4000), (7, "u7", "\r\n\r\nWARC/1.1"), (1, "u1", "<p>same</p>"), (None, "n", "<p>same</p>")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES * 1, "page_id long, url string, html string")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    many = spark.range(300).selectExpr("id + 100 AS page_id", "'u' AS url", "concat('<html><body>', repeat(concat('text ', id % 7, ' '), 40), id, '</body></html>') AS html")
    everything = pages.unionByName(many)
    dictionary = warc.train_dictionary(everything)
    assert dictionary
    archives = warc.write_warc(warc.with_revisits(everything), folder, dictionary)
    got = warc.read_warc(archives).collect()
    assert len(got) == 308 and not [r for r in got if r.error]
    payloads = {}
    for p, _, h in PAGES:
        payloads.setdefault((h or "").encode(), []).append(p)
    for r in got:
        if r.page_id is None or r.page_id < 100:
            data = next(d for d in payloads if warc.digest(d) == r.payload_digest)
            first = min(p for p in payloads[data] if p is not None)
            assert r.payload_bytes == len(data)
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
            assert bytes(r.payload or b"") == (data if r.record_type == "response" else b"")
    assert {r.target_uri for r in got if r.page_id == 1} == {"u\n1%", "u1"}


def test_each_reading_task_has_one_archive_and_columns_may_clash(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "concat(repeat('text ', 30), id % 390) AS html", "id AS _digest", "'x' AS digest", "id AS revisit").repartition(8)
    placed = warc.with_revisits(pages)
    assert placed.columns == ["page_id", "url", "html", "_digest", "digest", "revisit", "refers_to"]
    assert placed.filter("_digest <> page_id or digest <> 'x'").count() == 0 and placed.filter("revisit").count() == 10
    archives = warc.write_warc(placed.repartition(8), "file://" + tempfile.mkdtemp(prefix="spark-"), b"")
    assert archives.count() == 8
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in (8, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            read = warc.read_warc(archives).select("archive", F.spark_partition_id().alias("task")).distinct().collect()
            assert len({r.archive for r in read}) == len({r.task for r in read}) == len(read) == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_very_long_page_comes_back(spark):
    pages = spark.createDataFrame([(1, "u", "é<p>" * 1_000_000), (2, "u", "é<p>" * 1_000_000)], "page_id long, url string, html string")
    archives = warc.write_warc(warc.with_revisits(pages), "file://" + tempfile.mkdtemp(prefix="spark-"), b"")
    got = {r.page_id: (r.record_type, r.payload_bytes, r.error) for r in warc.read_warc(archives, payloads=False).collect()}
    assert got == {1: ("response", 5_000_000, None), 2: ("revisit", 5_000_000, None)}


def test_archives_without_rows_or_dictionary(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.train_dictionary(empty) == b""
    archives = warc.write_warc(warc.with_revisits(empty), "file://" + tempfile.mkdtemp(prefix="spark-"), b"")
    assert warc.read_warc(archives).collect() == []


def test_broken_records_are_told():
    good = warc.format_record(1, "u", b"body", None, False)
    assert warc.parse_record(good)["error"] is None
    assert warc.parse_record(good.replace(b"body", b"b0dy"))["error"].startswith("payload differs")
    assert warc.parse_record(good[:-1])["error"] == "length differs from Content-Length"
    assert warc.parse_record(good.replace(b"WARC-Date", b"X"))["error"] == "no warc-date"
    assert warc.parse_record(b"junk")["error"] == "no WARC header"
    frame = zstandard.ZstdCompressor().compress(good)
    assert list(warc.read_archive(io.BytesIO(frame + frame))) == [good, good]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(frame[:-3])))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(warc.dictionary_frame(b"not a dictionary") + frame)))


def test_digest_matches_a_known_value():
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


MARKS = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|im_end|>\\\\", "<|im_sep|>", "\n\n lead", "trail \n", "é日\U0001f600", "", "<", "|>"]


def test_chats_come_back_and_masks_hold_assistant_text_only(spark):
    rng = random.Random(3)
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "r\n|<|", None]), rng.choice([*MARKS, None, "plain text", "a " * 2000])))
    rng.shuffle(rows)
    rows += [(99, 1, "assistant", "x"), (99, 1, "assistant", "x"), (None, None, "assistant", "y")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    wanted: dict = {}
    for c, t, r, x in rows:
        wanted.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in wanted.items():
        turns.sort()
        said = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for r in formatted.collect():
        for low, high, m in zip(r.token_starts, r.token_ends, r.loss_mask, strict=True):
            assert m in (0, 1) and low <= high
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("text", MARKS)
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_mask_by_binary_search_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        cuts = sorted(rng.sample(range(60), 12))
        starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
        edges = sorted(rng.sample(range(62), 6))
        spans = [(edges[k], edges[k + 1]) for k in range(0, 6, 2)]
        mask, low, high = chat.loss_pieces(starts, ends, spans)
        assert mask.tolist() == [int(any(s < b and a < e for a, b in spans)) for s, e in zip(starts, ends, strict=True)]
        assert {x for a, b in zip(low, high, strict=True) for x in range(a, b)} == {x for a, b in spans for x in range(a, b)} & set(range(cuts[0], cuts[-1]))


def brute_nearest(rows: list[tuple], query: int, k: int) -> list[tuple]:
    x = {i: np.array(v, float) for i, v in rows if v is not None}
    return sorted((float(np.sqrt(((x[query] - v) ** 2).sum())), i) for i, v in x.items() if i != query)[:k]


@pytest.mark.parametrize(("chained", "dim", "block"), [(1, 32, 2048), (2, 64, 300), (3, 12, 2048), (2, 200, 2048)])
def test_neighbours_reach_the_recall(spark, monkeypatch, chained, dim, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, dim))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 100 == 0, chained=chained).collect()
    hits = 0
    for q in range(0, 1500, 100):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and [r.score for r in mine] == sorted(r.score for r in mine)
        exact = dict((i, s) for s, i in brute_nearest(rows, q, 1499))
        assert all(r.score == pytest.approx(exact[r.vec_id], abs=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for _, i in brute_nearest(rows, q, 10)})
    assert hits / 150 >= 0.9


def test_probes_needed_are_the_places_among_probes():
    rng = np.random.default_rng(8)
    q, v = (ann._unit(rng.normal(size=(6, 8))) for _ in range(2))
    for chained in (1, 2, 3):
        every, code = ann.probes(q, 2, chained, 16**chained), ann.codes(v, 2, chained)
        for row, needed in enumerate(ann.probes_needed(q, v, 2, chained)):
            found = lambda n: n and any(code[row, t] in ann.probes(q[row : row + 1], 2, chained, n)[0, t] for t in range(2))  # noqa: B023, E731
            assert len(set(every[row, 0])) == 16**chained and found(int(needed)) and not found(int(needed) - 1)


def test_neighbours_of_extreme_vectors(spark):
    rows = [(k, [1e200 * k, 1e200]) for k in range(1, 30)] + [(k, [float(k), 1e-200]) for k in range(100, 140)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c == 100)
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(100 + k, float(k)) for k in range(1, 11)]


def test_neighbours_of_few_and_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, rank string"
    one = [1.0, 2.0, 2.0]
    rows = [(0, one, "x"), (100, one, "x"), (7, one, "x"), (3, [0.0, 1.0, 0.0], "x"), (4, None, "x"), (5, [0.0] * 3, "x"), (6, [float("nan"), 1.0, 1.0], "x"), (8, [1.0, None, 1.0], "x"), (9, [1.0], "x"), (None, one, "x"), (200, [float("inf"), 1.0, 1.0], "x"), (3, [0.0, 1.0, 0.0], "x")]
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.search(spark.createDataFrame(rows, schema), lambda c: c % 100 == 0).collect())
    far = round(6**0.5, 6)
    assert got == [(0, 1, 7, 0.0), (0, 2, 100, 0.0), (0, 3, 3, far), (100, 1, 0, 0.0), (100, 2, 7, 0.0), (100, 3, 3, far)]
    assert ann.search(spark.createDataFrame([], schema), lambda c: c % 100 == 0).collect() == []


def test_many_equal_vectors(spark):
    rows = [(k, [1.0, 0.0] if k % 3 else [float(k), 1.0]) for k in range(1, 401)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: c % 100 == 0)
    for q in (100, 200, 400):
        mine = [(r.vec_id, r.score) for r in got.filter(f"query_id = {q}").orderBy("rank").collect()]
        assert mine == [(i, s) for s, i in brute_nearest(rows, q, 10)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))
