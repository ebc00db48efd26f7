"""Near duplicates and repeated passages against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from kinegrid.llm import minhash_dedup as mh
from kinegrid.llm import suffix_dedup as sd

DOCS = "doc_id long, text string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 1) -> list[tuple]:
    """Texts with exact and near copies, chains of near copies, shared passages, and odd ones."""
    rng = random.Random(seed)
    texts: list[str | None] = [" ".join(words(rng, rng.randrange(20, 200))) for _ in range(60)]
    for k in range(0, 40, 2):
        copy = texts[k].split(" ")
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    chain = words(rng, 100, 5000)
    for k in range(12):
        texts.append(" ".join(chain))
        chain = chain[: 8 * k] + words(rng, 4, 5000) + chain[8 * k + 4 :]
    texts += [texts[3], texts[3].upper(), "a b c", "A  b\tc", "a", "", None, " \n ", "É b", "é b"]
    passage = " ".join(words(rng, 70, 9000))
    texts += [f"{' '.join(words(rng, 30))} {passage} {' '.join(words(rng, 30))}" for _ in range(4)]
    return [(k + 5, t) for k, t in enumerate(texts)]


def shingles(text: str | None, width: int) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows: list[tuple], width: int, percent: int) -> dict[int, int]:
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize(("width", "block"), [(4, mh.BLOCK_BYTES), (5, 3000)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, block):
    monkeypatch.setattr(mh, "BLOCK_BYTES", block)
    rows = corpus(width)
    found = {r.doc_id: r for r in mh.near_duplicates(spark.createDataFrame(rows, DOCS), width, 80).collect()}
    expected = brute_components(rows, width, 80)
    assert {d: r.component_id for d, r in found.items()} == expected
    assert {d: r.n_shingles for d, r in found.items()} == {d: len(shingles(t, width)) for d, t in rows}
    assert all(r.kept == (r.component_id == d) for d, r in found.items())


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(4)
    base = words(rng, 150, 9000)
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(copy)))
    found = mh.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 80).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_components(rows, 4, 80)


@pytest.mark.parametrize("block", [mh.BLOCK_BYTES, 20_000])
def test_near_copies_about_the_threshold_equal_brute_force(spark, monkeypatch, block):
    """Copies of a text that is not there: most pairs miss the threshold narrowly, and hubs link few."""
    monkeypatch.setattr(mh, "BLOCK_BYTES", block)
    rng = random.Random(12)
    rows = []
    for g in range(3):
        base = words(rng, 120, 9000)
        for k in range(60):
            copy = list(base)
            for at in rng.sample(range(120), rng.randrange(2, 5)):
                copy[at] = f"x{rng.randrange(10**9)}"
            rows.append((1000 * g + k, " ".join(copy)))
    expected = brute_components(rows, 4, 80)
    found = mh.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 80).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert 5 < len(set(expected.values())) < 170


def test_bridges_equal_all_pairs():
    rng = np.random.default_rng(2)
    for one_block in (True, False):
        sets = [np.unique(rng.integers(0, 40, 25)).astype(np.uint64) for _ in range(40)]
        component, upper = rng.integers(0, 15, 40), np.arange(40) % 3 == 0
        x, y = mh._bridges([s.tobytes() for s in sets], component, upper & (not one_block), one_block, 60)
        label = {c: c for c in component.tolist()} | dict(zip(x.tolist(), y.tolist(), strict=True))
        rows = {c: {c} for c in label}
        for a in range(40):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 60 * (len(sets[a]) + len(sets[b]) - both) and (one_block or upper[a] != upper[b]):
                    joined = rows[component[a]] | rows[component[b]]
                    for c in joined:
                        rows[c] = joined
        assert label == {c: min(r) for c, r in rows.items()}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "one two three four five"), (1, "one two three four five"), (1, "one two three four five"), (1, "something else altogether here now"), (2, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in mh.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 80).collect())
    assert got == [(False, 1, 1, True)] * 3 + [(False, 2, 2, True), (True, 0, None, True)]
    assert mh.near_duplicates(spark.createDataFrame([], DOCS), 4, 80).collect() == []
    clashing = spark.createDataFrame([(1, "a b c d", "x", "y")], DOCS + ", component_id string, sig string")
    assert mh.drop_near_duplicates(clashing).collect()[0].asDict() == {"doc_id": 1, "text": "a b c d", "component_id": "x", "sig": "y"}


def test_near_duplicates_of_very_long_texts_and_repeated_rows(spark):
    rng = random.Random(41)
    long_text = words(rng, 60_000, 10**6)
    near = list(long_text)
    for at in rng.sample(range(60_000), 1200):
        near[at] = "other"
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (long_text, near)]
    assert len(sets[0] & sets[1]) > 0.8 * len(sets[0] | sets[1])
    far = [w if rng.random() < 0.9 else "x" for w in long_text]
    rows = [(9, " ".join(long_text)), (4, " ".join(near)), (7, " ".join(far)), (9, " ".join(long_text)), (2, "a b"), (2, "a b")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in mh.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 80).collect())
    assert got == [(2, 2, True), (2, 2, True), (4, 4, True), (7, 7, True), (9, 4, False), (9, 4, False)]


def test_every_pair_within_the_radius_shares_a_bucket():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 1 << mh.BITS, mh.COMPONENTS, dtype=np.uint16)
        b = a.copy()
        b[rng.choice(mh.COMPONENTS, mh.RADIUS, replace=False)] ^= 1
        keys = mh.chunk_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def brute_repeats(texts: list[bytes], length: int = 200) -> list[list[tuple[int, int]]]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    return [sd.merged([(k, k + length) for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1]) for t in texts]


def repeats_corpus() -> list[str | None]:
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdefgh éü") for _ in range(n))
    shared = [line(n) for n in (199, 200, 201, 350, 900)]
    texts: list[str | None] = [line(rng.randrange(700)) for _ in range(20)]
    texts += [line(rng.randrange(150)) + s + line(rng.randrange(150)) for s in shared for _ in range(3)]
    texts += [line(50) + shared[3][:230] + line(10), shared[3][100:] + line(80), line(60) + shared[4] + line(5) + shared[4] + line(40)]
    texts += ["x" * 900, "ab" * 400, "x" * 250 + line(90), texts[2], texts[2], texts[5], "", None, "short", "short"]
    return texts


@pytest.mark.parametrize("bucket", [16_000, 7])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(sd, "BUCKET", bucket)
    texts = repeats_corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = {r.doc_id: r for r in sd.without_repeats(docs).collect()}
    data = [(t or "").encode() for t in texts]
    for k, runs in enumerate(brute_repeats(data)):
        kept = sd.kept_bytes(data[k], runs)
        want = (len(data[k]), len(data[k]) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
        r = found[k]
        assert (r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) == want, k
        assert set((r._kept or "").encode()) <= set(data[k])


def test_equal_hashes_of_unlike_strings_do_no_harm(spark, monkeypatch):
    texts = [t.encode() for t in repeats_corpus() if t and len(t.encode()) >= sd.LENGTH]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    at = np.arange(0, len(flat) - sd.LENGTH + 1, 3)
    whole = flat.tobytes()
    seen: dict[bytes, int] = {}
    expected = [seen.setdefault(whole[k : k + sd.LENGTH], n) for n, k in enumerate(at)]
    for hashes in (sd.string_hashes(flat)[at], np.zeros(len(at), np.uint64), (at % 7).astype(np.uint64) * 0 + flat[at].astype(np.uint64) % np.uint64(3)):
        got = sd.equal_strings(flat, at, hashes)
        first: dict[int, int] = {}
        assert [first.setdefault(g, n) for n, g in enumerate(got.tolist())] == expected


def test_repeats_in_a_very_long_text_and_with_clashing_columns(spark):
    rng = random.Random(31)
    long_text = "".join(rng.choice("abcdefghij") for _ in range(400_000))
    rows = [(1, long_text, "a", 1), (2, "x" * 10 + long_text[150_000:151_000], "b", 2), (2, None, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _n_bytes long")
    got = {r._key: r for r in sd.without_repeats(docs).collect()}
    assert {k: (r._n_bytes, r._n_removed, r._n_spans) for k, r in got.items()} == {"a": (400_000, 1000, 1), "b": (1010, 1000, 1), "c": (0, 0, 0)}
    out = sd.drop_repeats(docs)
    assert out.columns == docs.columns and {(r._key, r._n_bytes) for r in out.collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_repeats_of_odd_rows(spark):
    assert sd.without_repeats(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "z" * 150 + "q" * 150, 1, "k"), (None, "z" * 150 + "q" * 150, 1, "k"), (3, None, 2, "k"), (4, "hello", 5, "k")]
    out = sd.drop_repeats(spark.createDataFrame(rows, DOCS + ", n_chars long, key string")).collect()
    assert sorted((r.text or "", r.n_chars or 0, r.key) for r in out) == [("", 0, "k")] * 3 + [("hello", 5, "k")]


def test_a_repeated_row_stays_once_through_both_stages(spark):
    rng = random.Random(21)
    text = {k: " ".join(words(rng, 60, 90_000)) for k in "abcde"}
    near = text["d"].split()
    near[3] = "other"
    rows = [(1, text["a"], "x")] * 5 + [(2, text["a"], "x"), (3, text["b"], "y"), (3, text["b"], "x"), (4, text["c"], "x"), (4, text["a"], "x")]
    rows += [(None, text["d"], "x"), (None, text["d"], "x"), (None, " ".join(near), "x"), (None, text["e"], "x"), (9, text["e"], "x"), (7, None, "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, DOCS + ", source string").repartition(3)
    kept = mh.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted((r[0] or 0, r[1] or "") for r in got if r[0] is not None) == sorted([(1, text["a"]), (3, text["b"]), (4, text["c"]), (9, text["e"]), (7, ""), (8, "")])
    assert [r[1] in (text["d"], " ".join(near)) for r in got if r[0] is None] == [True]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in mh.drop_near_duplicates(docs.repartition(2)).collect())
    left = [r.text for r in sd.drop_repeats(spark.createDataFrame(got, docs.schema)).collect()]
    assert sorted(t or "" for t in left) == sorted(r[1] or "" for r in got)


def test_characters_stay_whole():
    data = "aé€b".encode()
    assert sd.whole_characters(data, [(2, 5)]) == [(3, 3)] or sd.whole_characters(data, [(2, 5)]) == []
    assert sd.kept_bytes(data, sd.whole_characters(data, [(1, 6)])).decode() == "ab"


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 4, (500, 4)).astype(np.uint64)
    order = sd.multikey_quicksort(rows, small=5)
    assert [tuple(r) for r in rows[order]] == sorted(map(tuple, rows))
