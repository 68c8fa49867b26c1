"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-case letters, everything else being one
blank, weighted by (1 + log tf) * idf and scaled to length 1.  Weights are learned
by follow-the-regularised-leader with an elastic net (L1 keeps them sparse), and a
temperature fitted on rows set apart calibrates the probabilities.

Weights are learned from a sample of about ``MAX_TRAIN`` labelled rows, more only where
there are so many languages that each would have under ``MIN_EACH``, drawn evenly from
all languages by a hash of the row.  Document frequencies are counted over all labelled
rows that are not held out.  Both are made on the executors, so the driver holds rows of
counts, not texts; weights take about half a megabyte a language there.  Prediction covers every whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is
every text if there is nothing to learn from; rows with a null id are never learned
from and count as not held out; repeated rows are predicted alike; an empty table
gives no rows; a very long text is one document like any other; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import tidy

#: Rows of the sample to learn from, in expectation, and the least that a language has of them, or all it has.
MAX_TRAIN, MIN_EACH = 3000, 15
#: One in so many sampled rows fits the temperature instead of the weights.
SET_APART = 6
DIMENSIONS = 1 << 15
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Lower-case form of each letter's code point; a blank for all else."""
    if not _letters:
        _letters.append(np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, range(0x110000))], np.uint32))
    return _letters[0]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and counts of a text's n-grams; empty if it has no letter."""
    codes = letter_table()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == 32
    if blank.all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    c = codes[keep]
    c = np.concatenate([[32] * int(c[0] != 32), c, [32] * int(c[-1] != 32)]).astype(np.uint32)
    total = np.zeros(DIMENSIONS, np.int64)
    gram = c.copy()
    for n in (1, 2, 3):
        if n > 1:
            if len(gram) < 2:
                break
            gram = gram[:-1] * np.uint32(0x01000193) + c[n - 1 :]
        mixed = (gram + np.uint32(n)) * np.uint32(0x9E3779B1)
        total += np.bincount((mixed ^ (mixed >> np.uint32(15))) & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    where = np.flatnonzero(total)
    return where, total[where]


class Model:
    def __init__(self, languages: list[str]):
        self.languages, self.temperature = languages, 1.0
        self.idf = np.ones(DIMENSIONS, np.float32)
        self.weights, self.bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def vector(self, where: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[where]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def scores(self, where: np.ndarray, n: np.ndarray) -> np.ndarray:
        return softmax((self.vector(where, n) @ self.weights[where] + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        where, n = counts(text)
        if not len(where) or not self.languages:
            return UNKNOWN, 0.0
        p = self.scores(where, n)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, max(0.0, p[best])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, used: np.ndarray | None = None, total: int = 0) -> Model:
    """Learns from (language, indices, counts); the order of the rows decides which ones are set apart.

    ``used`` has the documents, of ``total``, that hold each n-gram; without it the rows are counted."""
    model = Model(sorted({lang for lang, _, _ in rows}))
    known = {lang: k for k, lang in enumerate(model.languages)}
    if used is None:
        used, total = np.zeros(DIMENSIONS), len(rows)
        for _, where, _ in rows:
            used[where] += 1
    model.idf = (np.log((1 + total) / (1 + used)) + 1).astype(np.float32)
    examples = [(known[lang], where, model.vector(where, n)) for lang, where, n in rows]
    learn = [e for k, e in enumerate(examples) if k % SET_APART] or examples
    apart = [e for k, e in enumerate(examples) if not k % SET_APART]
    # One more row of weights, which every example uses, is the bias.
    z, sums = np.zeros((DIMENSIONS + 1, len(known))), np.zeros((DIMENSIONS + 1, len(known)))

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(sums[at])) / alpha + l2)

    for _ in range(epochs):
        for label, where, x in learn:
            at, values = np.append(where, DIMENSIONS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(values @ w)
            p[label] -= 1
            g = values[:, None] * p
            more = np.sqrt(sums[at] + g * g) - np.sqrt(sums[at])
            z[at] += g - more / alpha * w
            sums[at] += g * g
    every = weights(slice(None))
    model.weights, model.bias = every[:-1].astype(np.float32), every[-1].astype(np.float32)
    raw = [(label, x @ model.weights[where] + model.bias) for label, where, x in apart]
    if raw:
        loss = lambda t: sum(-math.log(max(1e-12, softmax(s / t)[label])) for label, s in raw)
        model.temperature = min(np.geomspace(0.05, 20, 60).tolist(), key=loss)
    return model


def remainder(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 3


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts (a column text) hold each n-gram, and how many hold any."""

    def used(batches):
        sums = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for t in batch["text"]:
                where, _ = counts(t)
                sums[where] += 1
                sums[DIMENSIONS] += len(where) > 0
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"at": at, "n": sums[at]})

    sums = np.zeros(DIMENSIONS + 1, np.int64)
    for r in texts.select("text").mapInPandas(tidy(used), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[r["at"]] = r["n"]
    return sums[:-1], int(sums[-1])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """Learns from the labelled rows whose crc32(id) mod 3 is not 1."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("id")) != 1))
    per_lang = rows.groupBy("lang").count().collect()
    if not per_lang:
        return Model([])
    quota = max(max_train / len(per_lang), MIN_EACH)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, quota / r["count"])) for r in per_lang], "lang string, share double")
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    sample = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share") * F.lit(float(1 << 30)))

    def features(batches):
        for batch in batches:
            made = [counts(t) for t in batch["text"]]
            yield pd.DataFrame({"draw": batch["draw"], "lang": batch["lang"], "at": [a.astype(np.uint16).tobytes() for a, _ in made], "n": [n.tobytes() for _, n in made]})

    told = sample.select(draw.alias("draw"), "lang", "text").mapInPandas(tidy(features), "draw long, lang string, at binary, n binary").toLocalIterator()
    found = sorted((r["draw"], r["lang"], bytes(r["at"]), bytes(r["n"])) for r in told if r["at"])
    if not found:
        return Model([])
    used, total = document_frequencies(rows)
    return fit([(lang, np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(n, np.int64)) for _, lang, at, n in found], used=used, total=total)


def predicted(model: Model, spark: SparkSession, text: Column) -> Column:
    """A struct column (lang_pred, score) from a column of texts."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text.cast("string"))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    model = model or train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.coalesce(remainder(F.col("id")) == 1, F.lit(False)).alias("held_out"), predicted(model, docs.sparkSession, F.col("text")).alias("p"))
    return rows.select(F.col("id").alias(id_col), "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: list[str] | None = None, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language (one of ``languages``, if given), told apart with at least ``min_score``."""
    model = train(docs, id_col, text_col, lang_col)
    told = docs.select("*", predicted(model, docs.sparkSession, F.col(text_col)).alias("__told"))
    fits = (F.col("__told.lang_pred") != UNKNOWN) & (F.col("__told.score") >= min_score)
    if languages is not None:
        fits &= F.col("__told.lang_pred").isin(languages)
    return told.where(fits).select(*docs.columns)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
