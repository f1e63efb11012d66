"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of 1 to 3 lower-cased code points (other than letters all count as one blank), hashed to
BUCKETS. Document frequencies come from all training documents; every text is read whole. The weights are
trained with follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a bounded sample of
labelled rows, at most SAMPLE_ROWS of them, those with the smallest hash of their key; what the sample sends to
the driver is bounded by SAMPLE_ROWS * BUCKETS counts. A fifth of the sample is held back to fit the temperature
that calibrates the probabilities. Prediction reads nothing but the text.

Null texts and texts without a letter get `und` with score 0. A table without a training row, an empty one among
them, predicts `und` everywhere. Ties between languages go to the first by name. Repeated rows each get their row; repeated
labelled rows count as often as they occur. Very long texts are counted in steps. Other columns, whatever their names,
pass through untouched; one called like the result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import read

BUCKETS = 1 << 15
SAMPLE_ROWS = 6000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"
_STEP = 1 << 16


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters as code points, everything else as blanks, runs of which become one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _LETTERS[np.minimum(points, len(_LETTERS) - 1)]
    beyond = np.flatnonzero(points >= len(_LETTERS))
    if len(beyond):
        letter[beyond] = [chr(p).isalpha() for p in points[beyond].tolist()]
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return points[keep]


#: Which code points are letters; those beyond the table are asked for one by one.
_LETTERS = np.array([chr(i).isalpha() for i in range(0x30000)])


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each occurs."""
    points = code_points(text) if text else np.zeros(0, dtype=np.uint32)
    if not (points != 32).any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for i in range(0, len(points), _STEP):
        p = points[i : i + _STEP + 2]
        two = (p[:-1] * np.uint32(0x85EBCA6B)) ^ (p[1:] * np.uint32(0xC2B2AE35) + np.uint32(1))
        three = (two[:-1] * np.uint32(0x27D4EB2F)) ^ (p[2:] * np.uint32(0x165667B1) + np.uint32(2))
        h = np.concatenate([p[:_STEP] * np.uint32(0x9E3779B1), two[:_STEP], three[:_STEP]])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        total += np.bincount(h >> np.uint32(17), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def tf_idf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def probabilities(self, text: str | None) -> np.ndarray | None:
        at, n = counts(text)
        return softmax(tf_idf(at, n, self.idf) @ self.weights[at] / self.temperature) if len(at) else None


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, over all of them. Each task sends its own totals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for t in batch.iloc[:, 0]:
                total[counts(t)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], n)})

    summed = docs.select(F.col(f"`{text}`")).mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for bucket, k in summed.collect():  # at most BUCKETS + 1 rows
        if bucket < 0:
            n = k
        else:
            out[bucket] = k
    return out, n


def labelled_sample(docs: DataFrame, key: str, text: str, label: str, rows: int) -> pd.DataFrame:
    """The label, buckets and counts of at most `rows` labelled rows: those whose hash (of key, label and text) is smallest.

    Rows are chosen, not keys: repeated or missing keys make no difference, and of rows alike in all three any may stand for another. No task and
    not the driver holds more than `rows` of them.
    """
    few = docs.select(F.xxhash64(*(x for c in (key, label, text) for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull()))).alias("h"), F.col(f"`{label}`").alias("label"), F.col(f"`{text}`").alias("text"))
    least = few.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if least is None:
        return pd.DataFrame({"label": [], "at": [], "n": []})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counts(t) for t in batch["text"]]
            yield pd.DataFrame({"h": batch["h"], "label": batch["label"], "at": [a for a, _ in found], "n": [n for _, n in found]})

    kind = dict(few.dtypes)["label"]
    chosen = few.filter(F.col("h") <= least).mapInPandas(run, f"h long, label {kind}, at array<long>, n array<long>").orderBy("h").limit(rows)
    out = chosen.toPandas()
    return out[out["at"].map(len) > 0].drop(columns="h").reset_index(drop=True)


def train(sample: pd.DataFrame, idf: np.ndarray, seed: int = 7) -> Model:
    """FTRL-proximal over the sample, row by row in a fixed random order, then the temperature."""
    languages = sorted(sample["label"].unique())
    z, squares = np.zeros((BUCKETS, len(languages))), np.zeros((BUCKETS, len(languages)))
    truth = np.searchsorted(languages, sample["label"])
    rows = [(np.asarray(a), tf_idf(np.asarray(a), np.asarray(n), idf)) for a, n in zip(sample["at"], sample["n"], strict=True)]
    order = np.random.default_rng(seed).permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order[:0]

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(squares[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in order[len(held) :]:
            at, x = rows[i]
            w = weights(at)
            error = softmax(x @ w)
            error[truth[i]] -= 1
            gradient = x[:, None] * error
            step = (np.sqrt(squares[at] + gradient**2) - np.sqrt(squares[at])) / ALPHA
            z[at] += gradient - step * w
            squares[at] += gradient**2
    model = Model(languages, idf, weights(slice(None)))
    if len(held):
        logits = np.array([rows[i][1] @ model.weights[rows[i][0]] for i in held])
        scales = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
        loss = [-np.log(softmax(logits / t)[np.arange(len(held)), truth[held]] + 1e-12).mean() for t in scales]
        model.temperature = float(scales[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the labels of docs, or None where no row has a label."""
    docs = docs.filter(F.col(f"`{label}`").isNotNull())
    sample = labelled_sample(docs, key, text, label, sample_rows)
    if not len(sample):
        return None
    df, n = document_frequencies(docs, text)
    return train(sample, (np.log((1 + n) / (1 + df)) + 1).astype(np.float32))


def predictor(model: Model | None) -> Column:
    if model is None:
        return lambda text: F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    languages = model.languages

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch:
                p = model.probabilities(t)
                out.append((UNKNOWN, 0.0) if p is None else (languages[int(np.argmax(p))], float(p.max())))
            yield pd.DataFrame(out, columns=["lang", "score"])

    return F.pandas_udf(run, "lang string, score double")


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents with a column _language: lang and score."""
    return docs.withColumn("_language", predictor(model)(F.col(f"`{text}`")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs.filter(~held_out))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"))
