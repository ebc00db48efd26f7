"""The stages in a row, each against what it must do to its own input."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from kinegrid.llm import sentencepiece as sp
from kinegrid.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = " ".join(word() for _ in range(60))
    rows, marks = [], []
    for k in range(240):
        words = [word() for _ in range(60)]
        toxic = k % 6 == 0
        if toxic:
            words[5] = words[30] = words[50] = "blargish"
        if k % 40 == 1:
            words[20:20] = passage.split()
        rows.append((k, " ".join(words), "en", f"s{k % 4}", None))
        marks.append((k, 1, int(toxic)))
    near = rows[7][1].split()
    near[3] = "other"
    rows += [(900, rows[7][1], "en", "s1", 5), (901, " ".join(near), "en", "s1", 5), (902, None, None, None, None), (903, "", "en", "s0", 0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    calm = {r.doc_id for r in seen["toxicity"]}
    assert not [k for k in range(0, 240, 6) if k in calm] and calm >= {k for k in range(240) if k % 6} | {900, 901, 902, 903}
    kept = {r.doc_id: r.text for r in seen["minhash_near_dedup"]}
    assert set(kept) == calm - {900, 901}
    sets = [s for s in map(shingles, kept.values()) if s]
    assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    cut = {r.doc_id: r for r in seen["suffix_array_dedup"]}
    assert set(cut) == set(kept)
    data = [(t or "").encode() for t in kept.values()]
    times: dict[bytes, int] = {}
    for d in data:
        for k in range(len(d) - sd.LENGTH + 1):
            times[d[k : k + sd.LENGTH]] = times.get(d[k : k + sd.LENGTH], 0) + 1
    for key, text in kept.items():
        d = (text or "").encode()
        runs = sd.merged([(k, k + sd.LENGTH) for k in range(len(d) - sd.LENGTH + 1) if times[d[k : k + sd.LENGTH]] > 1])
        assert (cut[key].text or "").encode() == sd.kept_bytes(d, runs)
        assert cut[key].text is None or cut[key].n_chars == len(cut[key].text)
    assert not any(passage in (r.text or "") for r in cut.values())
    mixed = [r.doc_id for r in seen["source_mix"]]
    assert set(mixed) <= set(cut) and max(map(mixed.count, mixed)) <= 3
    with open(sp.MODEL, "rb") as f:
        pieces = sp.Pieces(f.read())
    assert sorted(r.doc_id for r in seen["sentencepiece"]) == sorted(mixed)
    assert all(pieces.decode(r.piece_ids) == (cut[r.doc_id].text or "") for r in seen["sentencepiece"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(mixed)
