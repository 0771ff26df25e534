"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled texts.  The ordinary one is made
by the library's trainer from windows of ordinary texts.  The toxic one continues it with what the trainer makes of the words
that toxic texts have of their own (words around byte strings much more frequent there), so that the two
differ by toxic text alone: separate dictionaries of whole texts differ mostly by the ordinary passages that
each happens to hold.  Both keep the ordinary one's entropy tables.  Every window of a text is compressed with both;
a window is toxic to the degree that the toxic dictionary makes it shorter.  Counts of
windows at and above thresholds of saved bytes make the score, by a logistic regression that is
calibrated to the labels' proportion.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.storage import written

WINDOW = 64
OVERLAP = 8
LEVEL = 3
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8, 10)
GRAMS = (6,)
RATIO = 10.0
#: toxic texts that must hold a string of their own: so many and this share
LEAST, LEAST_SHARE = 4, 0.02
ORDINARY_BYTES, TOXIC_BYTES = 16384, 2048
#: of the trainer: bytes of a segment, in the ordinary and the toxic dictionary, and of the strings it counts
SEGMENT, TOXIC_SEGMENT, STRING = 64, 24, 6
#: bounds of the labelled sample: texts of each class, windows and words that the trainer reads
SAMPLE, TRAINER_WINDOWS, TRAINER_BYTES, TRAINER_WORDS = 4000, 16384, 200, 20000
FOLDS = 5
SEED = 5


@dataclasses.dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


@functools.lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes):
    out = []
    for content in (ordinary, ordinary + toxic):
        held = zstandard.ZstdCompressionDict(content)  # a trained one with its tables, as they lead the content
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def saved_bytes(text: str, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Of every window, bytes by which the toxic dictionary makes it shorter than the ordinary one."""
    plain, both = _compressors(ordinary, toxic)
    data = _bytes(text)
    return np.array([len(plain.compress(w)) - len(both.compress(w)) for w in (data[max(0, i - OVERLAP) : i + WINDOW] for i in range(0, max(1, len(data)), WINDOW))], dtype=float)


def features(text: str, ordinary: bytes, toxic: bytes) -> np.ndarray:
    saved = saved_bytes(text, ordinary, toxic)
    above = np.array([(saved >= t).sum() for t in THRESHOLDS], dtype=float)
    return np.concatenate([[1.0], np.log1p(above), above / len(saved) * 10, [saved.max(), saved.mean()]])


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The library's dictionary of the samples; their bytes where they are too few for its trainer."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=STRING).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def trainer_windows(text: str) -> list[bytes]:
    """Windows of a whole text that the trainer may read."""
    data = _bytes(text)
    return [data[i : i + TRAINER_BYTES] for i in range(0, len(data), TRAINER_BYTES) if len(data) - i >= 8]


def window_rank(window: bytes) -> int:
    """Order of which windows are read: a hash, so that they are spread over all texts."""
    return xxhash.xxh3_64_intdigest(window, seed=SEED) >> 1


def padded(word: str) -> bytes:
    return f" {word} ".encode("utf-8", "replace")


def strings(word: str) -> set[bytes]:
    """The byte strings of GRAMS bytes in a word."""
    data = padded(word)
    return {data[i : i + n] for n in GRAMS for i in range(len(data) - n + 1)}


def text_words(text: str) -> set[str]:
    return set(text.lower().split())


def text_strings(text: str) -> set[bytes]:
    """The byte strings in the words of a text."""
    return set().union(*map(strings, text_words(text)))


def toxic_samples(words: list[tuple[str, int]]) -> list[bytes]:
    """What the trainer reads of (word, toxic texts that hold it): each word as often, in proportion where they are too many.

    In a random order, as the trainer takes one segment from each stretch of what it reads.
    """
    words = sorted(words, key=lambda w: (-w[1], w[0]))[:TRAINER_WORDS]
    scale = min(1.0, TRAINER_WORDS / max(1, sum(n for _, n in words)))
    every = [padded(w) for w, n in words for _ in range(max(1, round(n * scale)))]
    return [every[i] for i in np.random.default_rng(SEED).permutation(len(every))]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def calibrated(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, ...]:
    """Weights of the features; share: of label 1 among all labelled rows, which may not be the sample's."""
    ones = y.sum()
    return tuple(logistic(x, y, np.where(y == 1, share * len(y) / ones, (1 - share) * len(y) / (len(y) - ones))).tolist())


def score(text: str, model: Model) -> float:
    if len(model.weights) == 1:
        return float(1 / (1 + np.exp(-model.weights[0])))
    return float(1 / (1 + np.exp(-np.clip(features(text, model.ordinary, model.toxic) @ np.array(model.weights), -30, 30))))


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    """crc32 of the id as text, modulo folds, is fold; an id that is null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _ordinary_dictionary(texts: DataFrame) -> bytes:
    def windows(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = trainer_windows(text)
                yield pa.RecordBatch.from_arrays([pa.array([window_rank(w) for w in found], type=pa.int64()), pa.array(found, type=pa.binary())], names=["rank", "part"])

    some = texts.where("toxic = 0").select("text").mapInArrow(windows, "rank long, part binary").orderBy("rank", "part").limit(TRAINER_WINDOWS)
    return trained([bytes(r["part"]) for r in some.collect()], ORDINARY_BYTES, SEGMENT) or b" "


def _held_by(texts: DataFrame, toxic: int, items, kind: str) -> DataFrame:
    """item, texts: how many texts of a class hold each of what ``items(text)`` gives, a set."""

    def counted(batches):
        held: dict = {}

        def rows():
            yield pa.RecordBatch.from_arrays([pa.array(held, type=pa.string() if kind == "string" else pa.binary()), pa.array(held.values(), type=pa.int64())], names=["item", "texts"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for x in items(text):
                    held[x] = held.get(x, 0) + 1
                if len(held) > 500_000:
                    yield from rows()
                    held.clear()
        yield from rows()

    found = texts.where(F.col("toxic") == toxic).select("text").mapInArrow(counted, f"item {kind}, texts long")
    return found.groupBy("item").agg(F.sum("texts").alias("texts"))


def _toxic_dictionary(texts: DataFrame, n_toxic: int, n_ordinary: int) -> bytes:
    """From the words around strings that ``RATIO`` times as many toxic texts hold."""
    least = max(LEAST, LEAST_SHARE * n_toxic)
    often = {bytes(r["item"]): r["texts"] for r in _held_by(texts, 1, text_strings, "binary").where(F.col("texts") >= least).collect()}  # few, as each is in a share of the texts
    plain = {bytes(r["item"]): r["texts"] for r in _held_by(texts, 0, lambda t: text_strings(t) & often.keys(), "binary").collect()}
    own = {g for g, n in often.items() if n / n_toxic > RATIO * (plain.get(g, 0) + 0.5) / n_ordinary}
    found = _held_by(texts, 1, lambda t: {w for w in text_words(t) if not own.isdisjoint(strings(w))}, "string").orderBy(F.desc("texts"), "item").limit(TRAINER_WORDS)
    return trained(toxic_samples([(r["item"], r["texts"]) for r in found.collect()]), TOXIC_BYTES, TOXIC_SEGMENT) or b" "


def fit(texts: DataFrame, share: float) -> Model:
    """The model of a table (toxic 0 or 1, text) of few rows, whose texts may be of any length: they never meet in one task or the driver."""
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(b" ", b" ", (30.0 if n.get(1) else -30.0,))
    ordinary, toxic = _ordinary_dictionary(texts), _toxic_dictionary(texts, n[1], n[0])

    def measured(batches):
        for batch in batches:
            found = [features(t, ordinary, toxic).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sorted((r["toxic"], r["x"]) for r in texts.select("toxic", "text").mapInArrow(measured, "toxic int, x array<double>").collect())
    return Model(ordinary, toxic, calibrated(np.array([x for _, x in rows]), np.array([float(t) for t, _ in rows]), share))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows that are not held out.

    Of each class the ``sample`` ids first by md5 are used, with their whole texts (of rows that repeat an
    id the first text); the classes' proportion comes from all labels.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not total:
        return Model(b" ", b" ", (-30.0,))
    by = [F.md5(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string"))), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*by).limit(sample).unionByName(known.where("toxic = 0").orderBy(*by).limit(sample))
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen.collect()], "_id long, toxic int")  # at most 2 * sample ids
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    parts = docs.sparkSession.sparkContext.defaultParallelism
    held = texts.groupBy("_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).repartition(parts, "_id")
    return fit(written(held.select("toxic", "text"), "labelled"), total.get(1, 0) / sum(total.values()))


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), names: tuple[str, str, str] = ("doc_id", "score", "predicted")) -> DataFrame:
    """doc_id, score, predicted of every whole text, under ``names``, and the columns of ``keep``; null texts are empty, repeated rows stay.

    Only the text enters the score, so equal texts have equal scores.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias(names[0]), *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*kept.schema.fields, T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.IntegerType())])
    fields = [f.name for f in schema]

    def each(batches):
        for batch in batches:
            scores = [score(t or "", model) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, type=pa.float64()), pa.array([int(s >= 0.5) for s in scores], type=pa.int32())], names=fields)

    return docs.select(F.col("text").alias("__quire_text"), F.col("doc_id").cast("long").alias(names[0]), *[F.col(f"`{c}`") for c in keep]).mapInArrow(each, schema)
