"""Sources, quality rules, toxicity and pieces against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from kinegrid.llm import quality_forest as qf
from kinegrid.llm import sentencepiece as sp
from kinegrid.llm import source_mix as sm
from kinegrid.llm import toxicity as tx

ODD = ["", None, " \n\t", "word", "a  b", "é ü\nß", "x" * 5000, "▁a ▁", "<s> <0x0A> \x00 日本語 \U0001f600", " lead", "trail ", "a\r\nb\x0bc\x0c"]


def brute_targets(sizes: dict, weights=(5, 2, 1)) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 5, "b": 900, "c": 40, None: 7}, {"a": 1}, {"b": 10, "a": 10_000, "c": 0}, {f"s{k}": 7**k for k in range(8)}])
def test_targets_equal_repeated_capping(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r for r in sm.source_targets(rows).collect()}
    for s, want in brute_targets(sizes).items():
        assert got[s].target == pytest.approx(want)
        assert got[s].rate <= 3
        if sizes[s]:
            assert got[s].rate == pytest.approx(want / sizes[s])


def test_mix_takes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 20)), rng.choice(["a", "b", "b", "b", None])) for k in range(4000)]
    plan = sm.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in plan:
        taken[r.source] += r._copies * r._size
        target[r.source] = r._target
        assert 0 <= r._copies <= 3
    assert all(abs(taken[s] - t) < 0.1 * t for s, t in target.items())


def test_mix_of_odd_rows(spark):
    schema = "doc_id long, text string, source string, rate string"
    rows = [(1, "a b", "s", "x"), (1, "a b", "s", "x"), (None, None, None, "y"), (2, "", None, "z")]
    docs = spark.createDataFrame(rows, schema)
    once, again = (sorted(map(str, sm.mix_sources(docs).collect())) for _ in range(2))
    assert once == again
    assert sm.mix_sources(docs).columns == docs.columns
    assert sm.mix_sources(spark.createDataFrame([], schema)).collect() == []


def test_sources_of_rows_without_ids_or_with_one_id_come_near_their_targets(spark):
    rng = random.Random(8)
    lines = [" ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(5, 15))) for _ in range(2000)]
    rows = [(None, t, "a") for t in lines] + [(7, t, "b") for t in lines] + [(None, "the same text again", "c")] * 2000 + [(k, t, "d") for k, t in enumerate(lines, 10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    plan = sm.mix_plan(docs)
    taken = {r.source: (r.taken, r.target) for r in plan.groupBy("source").agg(sm.F.sum(sm.F.col("_copies") * sm.F.col("_size")).alias("taken"), sm.F.first("_target").alias("target")).collect()}
    for source, (got, target) in taken.items():
        assert abs(got - target) <= 0.1 * target, source
    once, again = (sorted((r.text, r.source, r._copies) for r in sm.mix_plan(docs.repartition(n)).collect()) for n in (2, 5))
    assert once == again and len(once) == len(rows)


def brute_stats(text: str | None) -> tuple:
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    seen, dups, lines = set(), 0, 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            lines += 1
            dups += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(covered), len(set(w)), lines


def test_text_stats_equal_brute_force():
    rng = random.Random(5)
    texts = ODD + ["a b c d e " * 3, "l1 é\nl1 é\n\n \nl1 é", "a a a a a a", "#*$% &|<>"] + [" ".join(rng.choices("abcé\n#", k=rng.randrange(80))) for _ in range(200)]
    for t in texts:
        assert qf.text_stats(t) == brute_stats(t), t


def test_very_long_texts(pieces):
    rng = random.Random(17)
    text = "".join(rng.choice([" ", "\n", "ab", "é", "word", "#", "日"]) for _ in range(200_000))
    assert qf.text_stats(text) == brute_stats(text)
    assert pieces.decode(pieces.encode(text)) == text


def test_repeated_rows_are_judged_each(spark):
    rng = random.Random(18)
    good = [(k, " ".join(rng.choices([f"w{j:03d}" for j in range(500)], k=60))) for k in range(120)]
    docs = spark.createDataFrame([*good, good[0], good[0], (0, "a")], "doc_id long, text string")
    judged = qf.judge_quality(docs, spark.createDataFrame([(k, 1) for k in range(120)], "doc_id long, quality int")).collect()
    assert len(judged) == 123 and sorted(r.n_words for r in judged if r.doc_id == 0) == [1, 60, 60, 60]
    assert [r.kept for r in judged if r.n_words == 1] == [False]


def test_quality_keeps_good_and_rejects_odd_documents(spark):
    rng = random.Random(6)
    good = [(k, " ".join(rng.choices([f"w{j:03d}" for j in range(500)], k=60))) for k in range(400)]
    bad = [(1000 + k, " ".join(rng.choices(["%%%%", "&&a", "#x|", "<<>>"], k=60))) for k in range(40)]
    # single words on lines that largely repeat break no base rule; neighbours keep them out of repeated windows
    listed = [f"w{k % 40:03d}" if k % 2 else f"w{k:03d}" for k in range(300)]
    bad += [(2000, "\n".join(listed))]
    docs = spark.createDataFrame([*good, *bad, (5000, None), (None, "a"), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(300)] + [(1000 + k, 0) for k in range(20)] + [(None, 1)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in qf.judge_quality(docs, labels).collect()}
    assert sum(kept[k] for k in range(400)) >= 396
    assert not any(v for d, v in kept.items() if d is None or d >= 1000)
    assert not qf.with_stats(docs.filter("doc_id = 2000")).filter(qf.base_failed()).count()
    without = qf.judge_quality(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in without)
    assert qf.judge_quality(docs.limit(0), labels).collect() == []


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(7)
    rows, marks = [], []
    for k in range(900):
        w = [f"w{rng.randrange(3000)}" for _ in range(60)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["blarg", "snorf"]) + rng.choice(["", "en", "isch", "tion"])
        rows.append((k, " ".join(w)))
        marks.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, "w1 w2"), (9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (9003, 1)], "doc_id long, toxic int")
    learned = labels.filter(~tx.held_out(labels.doc_id))
    model = tx.fit_toxicity(docs, learned)
    scored = model.score(docs.withColumn("held", tx.held_out(docs.doc_id))).collect()
    assert len(scored) == 903 and all(0 <= r.score <= 1 for r in scored)
    tested = [r for r in scored if r.held and r.doc_id < 900]
    right = sum((r.score >= tx.THRESHOLD) == (r.doc_id % 5 == 0) for r in tested)
    assert len(tested) > 200 and right / len(tested) > 0.97


def brute_features(text: str, lexicon: tx.Lexicon) -> dict:
    """The densities and rates by plain loops over words and characters."""
    bare = [b for w in text.lower().split() if (b := w.strip(".,;:!?\"'()[]{}*#%&$-_"))]
    fits = lambda w: [v for e, v in lexicon.weights.items() if (w == e[1:] if e[0] == "=" else w.startswith(e))]
    hits = [k for k, w in enumerate(bare) if fits(w)]
    yous = [k for k, w in enumerate(bare) if w in tx.SECOND_PERSON]
    n, length = max(len(bare), 1), max(len(text), 1)
    hidden = [w for w in text.split() if re.search(r"[A-Za-z][0134578@$!*]+[A-Za-z]", w)]
    return {
        "hit_share": len(hits) / n,
        "top_weight": max((v for w in bare for v in fits(w)), default=0.0),
        "seed_share": sum(w in tx.SEED_WORDS for w in bare) / n,
        "near_you_share": sum(any(abs(k - y) <= 5 for y in yous) for k in hits) / n,
        "you_share": len(yous) / n,
        "capital_share": sum("A" <= c <= "Z" for c in text) / length,
        "exclaim_share": text.count("!") / n,
        "question_share": text.count("?") / n,
        "disguised_share": len(hidden) / n,
    }


def test_text_features_equal_brute_force():
    rng = random.Random(13)
    lexicon = tx.Lexicon({"blar": 2.5, "=snorf": 1.5, "idio": 3.0})
    automaton = lexicon.automaton()
    vocabulary = ["blarg", "blar", "snorf", "snorfs", "idiot", "You", "your!", "tu", "Word", "UPPER!!", "id1ot", "m0ron?", "é", "a-b", "(stupid)", "...", "x"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(120))) for _ in range(300)] + ["", "blarg " * 40_000]
    for text in texts:
        got = dict(zip(tx.FEATURES, tx.text_features(text, automaton), strict=True))
        for name, want in brute_features(text, lexicon).items():
            assert got[name] == pytest.approx(want), (name, text[:200])


def test_scores_with_clashing_columns_and_repeated_rows(spark):
    rows = [(k % 50, f"w{k % 50} {'blarg' if k % 5 == 0 else 'plain'} text", k % 50, "x") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits long, `_raw odd` string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(50)], "doc_id long, toxic int")
    model = tx.fit_toxicity(docs, labels)
    got = model.score(docs).collect()
    assert len(got) == 100 and all(r.hits == r.doc_id and r["_raw odd"] == "x" for r in got)
    assert len({(r.doc_id, r.score) for r in got}) == 50
    assert tx.drop_toxic(docs, labels).columns == docs.columns


def test_paths_equal_a_walk_down_every_tree():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(5, 1, 300), rng.uniform(0, 0.1, 300), rng.uniform(0.4, 1, 300)])
    forest = qf.grow_forest(x, trees=20, tree_rows=64)
    rows = np.concatenate([x[:40], [[30.0, 0.0, 0.5], [5.0, 4.0, 0.5], [5.0, 0.0, 0.0]]])
    for row, got in zip(rows, qf.anomaly(forest, rows), strict=True):
        total = 0.0
        for t in range(20):
            node = 0
            while forest["feature"][t, node] >= 0:
                node = 2 * node + 1 + int(row[forest["feature"][t, node]] > forest["threshold"][t, node])
            total += forest["path"][t, node]
        assert got == pytest.approx(2 ** (-total / 20 / qf.mean_depth(64)))
    assert qf.anomaly(forest, rows[40:]).min() > np.quantile(qf.anomaly(forest, x), 0.9)


def test_mixing_keeps_columns_that_clash(spark):
    rows = [(k, "a b c", "s", k, "r") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies long, _rate string")
    out = sm.mix_sources(docs)
    assert out.columns == docs.columns and all(r._copies == r.doc_id and r._rate == "r" for r in out.collect())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "kept")], "doc_id long, text string, hits string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.drop_toxic(docs, none).collect()[0].asDict() == {"doc_id": 1, "text": "a", "hits": "kept"}
    only = tx.fit_toxicity(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert only.score(docs.select("doc_id", "text")).first().score == 1.0
    assert tx.drop_toxic(docs.limit(0), none).collect() == []


@pytest.fixture(scope="module")
def pieces() -> sp.Pieces:
    with open(sp.MODEL, "rb") as f:
        return sp.Pieces(f.read())


def brute_score(pieces: sp.Pieces, segment: str) -> float:
    """The best sum of scores over all segmentations, by plain dynamic programming."""
    scores = {p: s for p, (n, s, k) in pieces.automaton.items()}
    best = [0.0] + [float("-inf")] * len(segment)
    for end in range(1, len(segment) + 1):
        for start in range(max(0, end - 20), end):
            part = segment[start:end]
            if part in scores:
                best[end] = max(best[end], best[start] + scores[part])
        if segment[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + pieces.unknown)
    return best[-1]


def test_viterbi_is_optimal_and_word_by_word_exact(pieces):
    rng = random.Random(8)
    scores = {k: s for p, (n, s, k) in pieces.automaton.items()}
    for _ in range(300):
        text = "".join(rng.choices("abcdeinrst  é日\n", k=rng.randrange(1, 40)))
        marked = sp.SPACE + text.replace(" ", sp.SPACE)
        ids = pieces.encode(text)
        unknown = sum(c not in pieces.single for c in marked)
        total = sum(scores[k] for k in ids if k in scores) + unknown * pieces.unknown
        assert total == pytest.approx(brute_score(pieces, marked))
        assert pieces.decode(ids) == text


def test_segments_step_together_like_whole_texts(pieces, monkeypatch):
    """A Viterbi pass of its own for each new word took 934 CPU seconds a GB."""

    def whole(text: str) -> list[int]:
        marked, ids = (" " + text).translate(sp.MARKED), []
        for end, k in reversed(pieces.viterbi(marked) if text else []):
            ids += [k] if k != sp.BYTES else [pieces.bytes[b] for b in marked[end - 1].translate(sp.MARKED).encode()]
        return ids

    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choices("abcderst   ▁é日一个ж.,|─\n\x00\U0001f600", k=rng.randrange(60))) for _ in range(400)]
    want = [whole(t) for t in texts]
    assert pieces.encode_all(texts).to_pylist() == want
    assert pieces.decode_all(pieces.encode_all(texts)) == texts
    assert pieces.encode_all([]).to_pylist() == []
    for name, value in (("LONG", 3), ("BLOCK", 50)):
        with monkeypatch.context() as m:
            m.setattr(sp, name, value)
            assert pieces.encode_all(texts).to_pylist() == want
    with monkeypatch.context() as m:
        m.setattr(pieces, "split", False)
        assert pieces.encode_all(texts).to_pylist() == want
    words = ["".join(rng.choices("abcdeinrst", k=rng.randrange(3, 12))) for _ in range(3000)]
    monkeypatch.setattr(sp.Pieces, "viterbi", None)
    assert pieces.decode(pieces.encode(" ".join(words))) == " ".join(words)


def test_round_trips(pieces, spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    out = sp.encode_texts(docs.selectExpr("*", "'kept' AS round_trip", "1 AS other")).collect()
    assert all(r.round_trip for r in out) and {r.other for r in out} == {1}
    assert all(pieces.decode(r.piece_ids) == (r.text or "") for r in out)
    back = sp.decode_pieces(sp.encode_texts(docs)).collect()
    assert {r.doc_id: r.text for r in back} == {k: t or "" for k, t in enumerate(ODD)}
    reader = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    for t in ("Hello world, this is text.", "Äpfel und Öl\nzwei"):
        assert reader.decode(pieces.encode(t)) == t
    assert sp.encode_texts(docs.limit(0)).collect() == []
