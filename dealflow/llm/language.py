"""Language identification in two levels (operator 1).

A text is first given to a language family (multinomial logistic regression),
then to a language of that family: each pair of languages in the family has a
linear support vector machine, each casts a vote, and the summed margins break
ties.  Features are hashed letter n-grams (bytes of the lower-cased text, one
to three long within and around words), counted over the whole text.

Training reads labelled rows only, at most ``sample_per_language`` of each
language, chosen by a hash of ``doc_id`` (the documented bound; labels are
counted first, so no more texts than these are moved).  Prediction uses the
text alone, in Arrow batches, with weights of a fixed size.

Null and odd input: a text that is null or has no letter is ``und`` with score
0.  Repeated rows and repeated or null ``doc_id`` give a row each (a null
``doc_id`` is never trained on and counts as not held out).  Extra columns are
ignored.  Rows with a null label are predicted, not learned from.  With one
language there is nothing to separate and every text with a letter is given it; with
none (also an empty table) every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE, slices, written

# ISO 639-1 codes by family.  A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("az", "kk", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}

DIMS = 4096
#: Rows of features (DIMS numbers each) in a batch.
FEATURE_ROWS = 64


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def _byte_classes() -> np.ndarray:
    """Letters in lower case, other ASCII as blank, bytes of longer characters as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    lower = np.arange(ord("a"), ord("z") + 1)
    table[lower] = lower
    table[lower - 32] = lower
    return table


_CLASSES = _byte_classes()
_MIX = np.uint32(2654435761)
_SHIFT = np.uint32(32 - 12)


def features(text: str) -> np.ndarray:
    """Hashed counts of byte 1- to 3-grams of the whole text, scaled to length 1."""
    raw = _CLASSES[np.frombuffer(f" {text} ".encode("utf-8", "replace"), np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])].astype(np.uint32)  # one blank for a run
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:]
    counts = np.zeros(DIMS, np.float64)
    for grams, kind in ((raw, 1), (two, 2), (three, 3)):
        mixed = (grams + np.uint32(kind << 24)) * _MIX
        mixed ^= mixed >> np.uint32(15)
        counts += np.bincount((mixed * _MIX) >> _SHIFT, minlength=DIMS)
    counts = np.sqrt(counts)
    return counts / (np.sqrt(counts @ counts) or 1.0)


@dataclass
class LanguageModel:
    """Weights by family and by pair; a few rows of DIMS numbers each."""
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None
    family_bias: np.ndarray | None = None
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language of a feature row and the probability the two levels give it."""
        if len(self.families) == 1:
            best, sure = 0, 1.0
        else:
            z = self.family_weights @ x + self.family_bias
            p = np.exp(z - z.max())
            best = int(np.argmax(p))
            sure = float(p[best] / p.sum())
        family = self.families[best]
        languages = self.members[family]
        if len(languages) == 1:
            return languages[0], sure
        votes, margins, odds = (np.zeros(len(languages)) for _ in range(3))
        for i, j, w, b in self.pairs[family]:
            m = float(w @ x + b)  # above 0: language j
            votes[j if m > 0 else i] += 1
            margins += m * (np.arange(len(languages)) == j) - m * (np.arange(len(languages)) == i)
            q = 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
            odds[j] += q
            odds[i] += 1 - q
        won = max(range(len(languages)), key=lambda k: (votes[k], margins[k], -k))
        return languages[won], sure * float(odds[won]) / (len(languages) - 1)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, x of every row; a short text has thousands of numbers too, so rows are counted, not only bytes."""
    for piece in slices(batches, "text", PIECE):
        for i in range(0, len(piece), FEATURE_ROWS):
            batch = piece.slice(i, FEATURE_ROWS)
            x = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(x, pa.list_(pa.float64()))], ["lang", "x"])


def fit_languages(labelled: DataFrame, sample_per_language: int = 500) -> LanguageModel:
    """Fit from (doc_id, text, lang); null labels and texts are left out."""
    rows = labelled.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"),
                           F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    # A first, cheap pass counts rows of each language; the hash threshold then lets through about twice the bound.
    counts = {r["lang"]: r["n"] for r in labelled.filter(F.col("lang").isNotNull()).groupBy(F.col("lang").cast("string").alias("lang"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col("lang") == language, min(1.0, 2.0 * sample_per_language / n)).otherwise(share)
    near = rows.withColumn("order", order).filter((F.col("order").cast("double") / 2.0 ** 64 + 0.5) <= share)
    sample = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", "text"))) \
        .filter(F.col("rank") <= sample_per_language).select("lang", "text")

    sample = written(sample.mapInArrow(_feature_batches, "lang string, x array<double>"), "language-sample").coalesce(4)
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    model = LanguageModel(sorted({family_of(x) for x in languages}))
    model.members = {f: [x for x in languages if family_of(x) == f] for f in model.families}
    sample = sample.select("lang", array_to_vector("x").alias("features")).cache()
    try:
        if len(model.families) > 1:
            number = F.lit(None).cast("double")
            for x in languages:
                number = F.when(F.col("lang") == x, float(model.families.index(family_of(x)))).otherwise(number)
            fitted = LogisticRegression(family="multinomial", maxIter=25, regParam=1e-4).fit(
                sample.withColumn("label", number))
            model.family_weights = fitted.coefficientMatrix.toArray()
            model.family_bias = fitted.interceptVector.toArray()
        for f in model.families:
            model.pairs[f] = []
            for i, j in combinations(range(len(model.members[f])), 2):
                one, other = model.members[f][i], model.members[f][j]
                fitted = LinearSVC(maxIter=25, regParam=1e-4).fit(
                    sample.filter(F.col("lang").isin(one, other)).withColumn("label", (F.col("lang") == other).cast("double")))
                model.pairs[f].append((i, j, fitted.coefficients.toArray(), float(fitted.intercept)))
    finally:
        sample.unpersist()
    return model


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row; columns of these names are replaced."""
    kept = docs.drop("lang_pred", "score", "__has_letter").withColumn(
        "__has_letter", F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__has_letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, PIECE):
            found = [model.predict(features(t)) if letter and model.families else ("und", 0.0)
                     for t, letter in zip(batch.column(text).to_pylist(), batch.column("__has_letter").to_pylist())]
            rest = batch.drop_columns("__has_letter")
            yield pa.RecordBatch.from_arrays(
                rest.columns + [pa.array([f[0] for f in found], pa.string()),
                                pa.array([round(f[1], 6) for f in found], pa.float64())],
                rest.schema.names + ["lang_pred", "score"])

    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Every fifth document by crc32 of its id is kept out of training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, sample_per_language: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``, learned from its rows that are not held out."""
    model = fit_languages(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample_per_language)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return predict_languages(rows, model).select("doc_id", "held_out", "lang_pred", "score")
