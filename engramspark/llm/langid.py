"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import ship

BUCKETS, DIMENSIONS, ORDERS = 1 << 13, 16, (1, 2, 3, 4)
#: Texts per language that the model is fitted on, and texts at most: the bound on what the driver gets. MOST / 10 languages are
#: learned at most, those with the most different texts.
QUOTA, MOST, CROP = 700, 7000, 48
EPOCHS, RATE, BATCH, REFUSED = 30, 4.0, 32, 0.002

#: Upper case to lower, everything in ASCII that is no letter to a blank.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def subwords(raw: np.ndarray) -> list[np.ndarray]:
    """Buckets of the byte n-grams of each order that start at each byte."""
    x = FOLD[raw].astype(np.uint32)
    total, out = np.zeros(len(x), np.uint32), []
    for j in range(max(ORDERS)):
        if j >= len(x):
            break
        total = total[: len(x) - j] * np.uint32(0x9E3779B1) + x[j:] + np.uint32(j + 1)
        if j + 1 in ORDERS:
            out.append(((total ^ (total >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 13))
    return out


def counts_of(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS, np.float32)
    for part in subwords(raw):
        out += np.bincount(part, minlength=BUCKETS)
    return out


@W.frugal
def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Non-zero counts of whole texts and of a short span of each."""
    for batch in batches:
        raw, offs = W.utf8(batch.column(1))
        rows: list[list] = [[], [], [], []]
        for i in range(len(batch)):
            own = raw[offs[i] : offs[i + 1]]
            at = (len(own) * 40503 + 7) % max(1, len(own) - CROP)
            for whole, part in ((True, own), (False, own[at : at + CROP])):
                c = counts_of(part)
                at_bucket = np.flatnonzero(c)
                for column, value in zip(rows, (i, whole, at_bucket.astype(np.int16).tobytes(), c[at_bucket].tobytes())):
                    column.append(value)
        lang = batch.column(0).take(pa.array(rows[0], pa.int64()))
        yield pa.RecordBatch.from_arrays([lang, *(pa.array(x) for x in rows[1:3]), pa.array(rows[3], pa.binary())], names=["lang", "whole", "at", "n"])


@dataclass
class Rows:
    """Rows of counts, each divided by its sum, without the zeros: a few megabytes, however wide a row is."""

    at: np.ndarray  # buckets of all rows
    share: np.ndarray
    offs: np.ndarray

    @staticmethod
    def of(at: list[bytes], n: list[bytes]) -> Rows:
        shares = [x / max(1.0, x.sum()) for x in (np.frombuffer(b, np.float32) for b in n)]
        offs = np.cumsum([0, *map(len, shares)])
        return Rows(np.frombuffer(b"".join(at), np.int16), np.concatenate([*shares, np.zeros(0, np.float32)]), offs)

    def __len__(self) -> int:
        return len(self.offs) - 1

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            own = slice(self.offs[r], self.offs[r + 1])
            out[i, self.at[own]] = self.share[own]
        return out


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages: the embeddings under the linear layer
    bias: np.ndarray
    temperature: float
    refuse_below: float

    def predict(self, counts: np.ndarray) -> tuple[int, float]:
        logits = (counts @ self.scores / max(1.0, counts.sum()) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        best = int(np.argmax(p))
        return best, float(p[best] / p.sum())


def train(x: Rows, y: np.ndarray, k: int, own: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """own: the rows of x to learn from; only those of one step are ever dense. Returns the folded scores and the bias."""
    random = np.random.default_rng(seed)
    embeddings = random.normal(0, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32)
    linear, bias = random.normal(0, 0.1, (DIMENSIONS, k)).astype(np.float32), np.zeros(k, np.float32)
    steps, step = EPOCHS * -(-len(own) // BATCH), 0
    for _ in range(EPOCHS):
        for rows in np.array_split(own[random.permutation(len(own))], -(-len(own) // BATCH)):
            rate, step = RATE * (1 - step / steps), step + 1
            f = x.dense(rows)
            mean = f @ embeddings
            p = np.exp((z := mean @ linear + bias) - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ linear.T
            linear -= rate * mean.T @ p
            bias -= 0.1 * rate * p.sum(axis=0)
            embeddings -= 10 * rate * (f.T @ back)
    return embeddings @ linear, bias


def calibrate(logits: np.ndarray, y: np.ndarray, refused: float) -> tuple[float, float]:
    """The temperature of least log loss on held-out rows; the score that a share of refused of the rightly
    labelled ones lies below."""
    def log_p(t: float) -> np.ndarray:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    t = min(np.geomspace(0.05, 10, 60), key=lambda t: -log_p(t)[np.arange(len(y)), y].mean())
    p = np.exp(log_p(t))
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return float(t), float(min(0.5, np.quantile(right, refused))) if len(right) else 0.0


def sample(labelled: DataFrame, quota: int, most: int) -> tuple[list[str], DataFrame]:
    """labelled (lang, text) -> the languages that are learned, and their texts to learn from (lang, text).

    Of each language the quota different texts with the smallest hashes (fewer where there are more languages than most / quota;
    all where there are no more), whatever the number of copies. Of the languages, the most / 10 with the most different texts, by name where these
    are as many. The estimate of different texts only bounds how many are ranked."""
    order = F.pmod(F.xxhash64("text"), F.lit(1_000_003))
    known = labelled.filter("lang is not null and text is not null and text <> ''").select("lang", "text", order.alias("order"), F.xxhash64("text").alias("hash"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).orderBy(F.desc("n"), "lang").limit(max(1, most // 10)).collect()
    if not sizes:
        return [], known.select("lang", "text").limit(0)
    each = max(1, min(quota, most // len(sizes)))
    limits = F.create_map(*(F.lit(v) for r in sizes for v in (r["lang"], min(1.0, (2 * each + 20) / max(1, r["n"])))))
    near = known.filter(F.col("order") < limits[F.col("lang")] * 1_000_003).groupBy("lang", "order", "hash").agg(F.min("text").alias("text"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "hash")))
    return sorted(r["lang"] for r in sizes), ranked.filter(F.col("rank") <= each).select("lang", "text")


def learn(lang: list[str], whole: list[bool], at: list[bytes], n: list[bytes], languages: list[str], refused: float) -> Model:
    """The model of rows of _sample(), in any order. A fifth of the rows is held out for calibration."""
    order = sorted(range(len(lang)), key=lambda i: (lang[i], whole[i], at[i], n[i]))
    y = np.searchsorted(languages, [lang[i] for i in order])
    x = Rows.of([at[i] for i in order], [n[i] for i in order])
    held = np.random.default_rng(11).random(len(x)) < 0.2
    if held.all() or not held.any():
        held[:] = False
    scores, bias = train(x, y, len(languages), np.flatnonzero(~held))
    known = np.flatnonzero(held & np.array([whole[i] for i in order], bool))
    if not len(known):
        return Model(languages, scores, bias, 1.0, 0.0)
    logits = np.concatenate([x.dense(part) @ scores for part in np.array_split(known, -(-len(known) // 256))]) + bias
    return Model(languages, scores, bias, *calibrate(logits, y[known], refused))


def _learn(languages: list[str], refused: float):
    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], []]
        for batch in batches:
            for column, values in zip(columns, batch.columns):
                column += values.to_pylist()
        model = learn(*columns, languages, refused)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in (model.scores, model.bias)] + [pa.array([float(x)]) for x in (model.temperature, model.refuse_below)], names=["scores", "bias", "temperature", "refuse_below"]
        )

    return run


def fit(labelled: DataFrame, quota: int = QUOTA, most: int = MOST, refused: float = REFUSED) -> Model:
    """labelled (lang, text): learns from sample(), which is bounded, in one task; the driver gets the model alone. Rows without a
    language or text do not count; without others nothing is learned, and every prediction is und."""
    ship(labelled.sparkSession)
    languages, chosen = sample(labelled, quota, most)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rows = chosen.mapInArrow(_sample, "lang string, whole boolean, at binary, n binary").repartition(1)
    row = rows.mapInArrow(_learn(languages, refused), "scores binary, bias binary, temperature double, refuse_below double").first()
    scores, bias = (np.frombuffer(bytes(x), "<f4").reshape(-1, len(languages)) for x in (row["scores"], row["bias"]))
    return Model(languages, scores, bias[0], row["temperature"], row["refuse_below"])


def _has_letter(own: np.ndarray) -> bool:
    if ((own | 0x20) - 97 < 26).any():
        return True
    return bool((own >= 0x80).any()) and any(map(str.isalpha, own.tobytes().decode("utf-8", "replace")))


def _predict(model: Model):
    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = W.utf8(batch.column(1))
            names, scores = ["und"] * len(batch), np.zeros(len(batch))
            for i in range(len(batch)):
                own = raw[offs[i] : offs[i + 1]]
                if model.languages and len(own) and _has_letter(own):
                    best, scores[i] = model.predict(counts_of(own))
                    names[i] = model.languages[best]
            rejected = np.array([x == "und" for x in names], bool) | (scores < model.refuse_below)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, lang_pred, score, rejected: a row for each row, from its whole text alone.

    score is the calibrated probability of lang_pred. Null or empty text, or one without a letter: und, score 0,
    rejected; so is every row if nothing was learned. rejected also says that score is below what a share of REFUSED of
    the rightly labelled held-out texts lies below. Equal texts get equal rows; null doc_id is carried. Empty table: no
    rows. Other columns are ignored. No shuffle."""
    ship(docs.sparkSession)
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return two.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the labelled rows that are not held out and predicts all: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.filter(~held_out()).select("lang", "text"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language the model does not reject, with all their columns; each row is judged by its
    own text, whatever its id. No shuffle."""
    model = fit(docs.filter(~held_out()).select("lang", "text"))
    columns = docs.columns

    @W.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = _predict(model)
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(columns.index("doc_id")), batch.column(columns.index("text"))], names=["doc_id", "text"])
            for out in decide([pair]):
                yield batch.filter(pa.array(~out.column(3).to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, docs.schema)
