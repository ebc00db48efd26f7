"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of word beginnings is learned from labelled documents. Each whole text
then becomes a row of densities and rates; boosted trees score it, and an
isotonic fit on rows held back from the trees turns that into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, hash_sample, small_batches, table

#: Labelled rows that the lexicon, the trees and the calibration are fitted on, at most.
FIT_ROWS = 16_384
#: Of these, one in CALIBRATE is held back from the trees for the calibration.
CALIBRATE = 4
#: Lexicon entries, documents that must hold one, and how much more often toxic ones must.
LEXICON, MIN_DOCS, MIN_LIFT = 512, 4, 8.0
#: Lengths of word beginnings that can be an entry, besides whole words.
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7

#: Insults that a corpus without labels is searched for too.
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "filth", "imbecile", "dumb", "vermin")
#: Second-person pronouns of English, French, German and Spanish.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "usted", "ustedes", "tus", "ti", "vosotros")
#: Signs that stand for a letter in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")

FEATURES = ("hits", "hit_share", "weight_share", "top_weight", "seed_share", "near_you_share", "you_share", "capital_share", "shouted_share", "exclaim_share", "question_share", "run_share", "disguised_share", "disguised_hits", "log_words")
_SHOUTED, _RUNS, _DISGUISED = re.compile(r"\b[A-Z]{3,}\b"), re.compile(r"[!?]{2,}"), re.compile(r"[A-Za-z][0134578@$!*]+[A-Za-z]")
_NEAR = 5


@dataclass(frozen=True)
class Lexicon:
    """Entries with their weights: "=word" for a whole word, "word" for a beginning."""

    weights: dict[str, float]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in (dict.fromkeys((f"={w}" for w in SEED_WORDS), 0.0) | self.weights).items():
            key = " " + entry[1:] + " " if entry[0] == "=" else " " + entry
            found.add_word(key, (len(key), weight, entry[0] == "=" and entry[1:] in SEED_WORDS, entry in self.weights))
        found.make_automaton()
        return found


def bare_words(text: str) -> list[str]:
    """Lower-cased words without the punctuation around them."""
    return [b for w in text.lower().split() if (b := w.strip(".,;:!?\"'()[]{}*#%&$-_"))]


def text_features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, ...]:
    """``FEATURES`` of one whole text; a null text counts as empty, and all rates of an empty text are 0."""
    text = text or ""
    words = bare_words(text)
    n = max(len(words), 1)
    joined = " " + " ".join(words) + " "
    starts, weight, top, seeds = set(), 0.0, 0.0, 0
    for end, (length, w, seed, learned) in automaton.iter(joined):
        start = end - length + 1
        seeds += seed
        if learned:
            top = max(top, w)
            if start not in starts:  # a word counts once, however many entries it fits
                starts.add(start)
                weight += w
    near = 0
    yous = sum(map(_YOU.__contains__, words))
    if starts and yous:
        places = np.flatnonzero(np.fromiter((w in _YOU for w in words), bool, len(words)))
        ordinals = np.searchsorted(np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32), sorted(starts))
        after = np.searchsorted(places, ordinals)
        gaps = np.minimum(np.abs(places[np.minimum(after, len(places) - 1)] - ordinals), np.abs(places[np.maximum(after - 1, 0)] - ordinals))
        near = int((gaps <= _NEAR).sum())
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256) if text else np.zeros(256, int)
    disguised = [w for w in text.split() if _DISGUISED.search(w)] if _DISGUISED.search(text) else []
    plain = " " + " ".join(w.translate(DISGUISE).replace("*", "").lower() for w in disguised) + " "
    length = max(len(text), 1)
    return (
        math.log1p(len(starts)), len(starts) / n, weight / n, top, seeds / n, near / n, yous / n,
        data[65:91].sum() / length, len(_SHOUTED.findall(text)) / n, data[33] / n, data[63] / n, len(_RUNS.findall(text)) / n,
        len(disguised) / n, float(sum(1 for _ in automaton.iter(plain))) if disguised else 0.0, math.log1p(len(words)),
    )


_YOU = frozenset(SECOND_PERSON)


def with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by ``FEATURES``; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON entries
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for b in batches:
            rows = np.array([text_features(t, automaton) for t in b.column(text).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*map(b.column, rest), *(pa.array(rows[:, k]) for k in range(len(FEATURES)))], [*rest, *FEATURES])

    carried = docs.select(text, *(F.col(f"`{c}`") for c in rest))
    schema = carried.select(*(F.col(f"`{c}`") for c in rest)).schema
    for f in FEATURES:
        schema = schema.add(f, "double")
    return carried.mapInArrow(run, schema)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and word beginnings that toxic documents of ``sample`` hold far more often.

    Counted are distinct pairs of an entry and the words around it, so that a
    text that was copied, whole or with changes elsewhere, counts once. Entries
    are ranked by support times log lift; of entries that begin alike with the
    same support the shortest stays.
    """
    strip = lambda w: F.regexp_replace(w, r"^[.,;:!?\"'()\[\]{}*#%&$_-]+|[.,;:!?\"'()\[\]{}*#%&$_-]+$", "")
    words = F.filter(F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), strip), lambda w: w != "")
    # each word with its neighbours' hash; the list of words stays behind
    beside = lambda w, k: F.struct(w.alias("word"), F.xxhash64(F.get("words", k - 1), F.get("words", k + 1)).alias("around"))
    listed = sample.select("toxic", words.alias("words"))
    entries = F.array(F.concat(F.lit("="), "word"), *(F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in PREFIXES))
    each = F.explode(F.array_compact(entries)).alias("entry")
    toxic, clean = sample.agg(F.sum(F.col("toxic")), F.sum(1 - F.col("toxic"))).first()
    least = max(MIN_DOCS, (toxic or 0) // 100)
    bad = listed.filter("toxic = 1").select(F.inline(F.transform("words", beside))).select(each, "around").distinct().groupBy("entry").agg(F.count("*").alias("bad")).filter(F.col("bad") >= least)
    # the entries come from a bounded sample; broadcast, they let few words through, which are counted where they are
    bad = bounded_broadcast(bad, 500_000)
    good = listed.filter("toxic = 0").select(F.explode("words").alias("word")).select(each).join(bad.select("entry"), "entry", "left_semi").groupBy("entry").agg(F.count("*").alias("good"))
    counted = bad.join(good, "entry", "left")
    lift = (F.col("bad") / F.lit(max(toxic or 0, 1))) / ((F.coalesce("good", F.lit(0)) + 0.5) / F.lit(max(clean or 0, 1)))
    ranked = counted.withColumn("weight", F.log(lift)).filter(F.col("weight") >= math.log(MIN_LIFT))
    best = ranked.orderBy((F.col("bad") * F.col("weight")).desc(), F.length("entry"), "entry").limit(LEXICON).collect()
    return Lexicon({r.entry: float(r.weight) for r in best})


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    #: Score where there is nothing to learn from.
    prior: float

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``text`` replaced by ``score``, which also replaces a column of that name."""
        columns = [c for c in docs.columns if c not in (text, "score")]
        # the other columns travel as one, so that none can clash with a feature
        row = F.struct(*(F.col(f"`{c}`") for c in columns), F.lit(0).alias("_")).alias("_row")
        rest = [F.col(f"_row.`{c}`") for c in columns]
        rows = with_features(docs.select(F.col(f"`{text}`").alias("_text"), row), self.lexicon, "_text")
        if self.trees is None:
            return rows.select(*rest, F.lit(self.prior).alias("score"))
        raw = _raw(self.trees, rows)
        if self.calibration is not None:
            raw = self.calibration.setPredictionCol("_calibrated").transform(raw).withColumn("_raw", F.col("_calibrated"))
        return raw.select(*rest, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_raw")).alias("score"))


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector").transform(rows)
    return trees.transform(vectors).withColumn("_raw", vector_to_array("_probability")[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on at most ``fit_rows`` labelled rows, those with the smallest hashes of their keys.

    ``labels`` has ``key`` and ``toxic`` (0 or 1; null rows are left out). A
    document with both labels counts as toxic. Of rows that share a key one is
    learned from, that with the smallest hash of its text. With one class alone there are no
    trees, and every score is that class.
    """
    marks = labels.filter(F.col(key).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    chosen = hash_sample(marks, F.xxhash64(F.lit(11), key), fit_rows, marks.count())
    # fit_rows rows of two numbers: that is a proven bound for the broadcast
    labelled = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(chosen), key)
    # one row a key, however many rows share it
    sample = cut(labelled.groupBy(key).agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    present = {r.toxic for r in sample.select("toxic").distinct().collect()}
    if len(present) < 2:
        return ToxicityModel(Lexicon({}), None, None, float(max(present, default=0)))
    held = F.pmod(F.xxhash64(F.lit(5), key), F.lit(CALIBRATE)) == 0
    growing = sample.filter(~held)
    lexicon = learn_lexicon(growing)
    rows = cut(with_features(sample.select(key, "toxic", "text"), lexicon).withColumn("_held", held))
    grow = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector").transform(rows.filter("not _held"))
    if grow.select("toxic").distinct().count() < 2:
        return ToxicityModel(lexicon, None, None, float(max(present)))
    gbt = GBTClassifier(featuresCol="_vector", labelCol="toxic", predictionCol="_predicted", maxIter=20, maxDepth=3, stepSize=0.2, maxBins=32, seed=3)
    trees = gbt.setProbabilityCol("_probability").setRawPredictionCol("_margin").fit(grow)
    held_rows = _raw(trees, rows.filter("_held")).select("toxic", "_raw")
    calibration = None
    if held_rows.select("toxic").distinct().count() == 2:
        calibration = IsotonicRegression(featuresCol="_raw", labelCol="toxic").fit(held_rows.withColumn("toxic", F.col("toxic").cast("double")))
    return ToxicityModel(lexicon, trees, calibration, 0.0)


def held_out(key: Column) -> Column:
    """Whether labels of this row are never learned: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; a row for each, in no order.

    A null text counts as empty; all its rates are 0. A null doc_id is not held
    out. Rows that repeat a text have the same score.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    model = fit_toxicity(docs, labels)
    return model.score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; other columns pass through."""
    model = fit_toxicity(docs, labels)
    carried = docs.select(F.col("text").alias("_scored"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return model.score(carried, "_scored").filter(F.col("score") < threshold).select("_row.*")
