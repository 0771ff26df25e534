"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``k`` smallest distinct shingle hashes of a text.  Sketches
of parts merge into the sketch of the whole; two sketches estimate resemblance
(Jaccard), containment and distinct shingle counts, exactly so when they hold
all hashes.  A null or empty text has an empty sketch, whose likeness to another empty one
is 1 and to any other 0.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import kernels

K = 128
_FULL = float(1 << 64)


def bottom(values: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, sorted."""
    if len(values) > 4 * k:
        low = kernels.distinct(np.partition(values, 2 * k)[: 2 * k])
        if len(low) >= k:
            return low[:k]
    return kernels.distinct(values)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of the sketched sets."""
    return kernels.distinct(np.concatenate(sketches))[:k] if sketches else np.zeros(0, np.uint64)


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Estimated size of the sketched set; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[k - 1]) + 1) / _FULL)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of two sketched sets."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k=k)
    both = np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)
    return len(both) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's set that is in b's."""
    if not len(a):
        return 1.0
    union = distinct_count(merge(a, b, k=k), k)
    return float(min(1.0, resemblance(a, b, k) * union / distinct_count(a, k)))


def pack(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode("ascii")


def unpack(text: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text or ""), dtype=">u8").astype(np.uint64)


def sketch_column(text: Column, k: int = K, width: int = kernels.WIDTH) -> Column:
    """Packed sketch of each text."""

    @F.pandas_udf("string")
    def sketch(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, type=pa.string(), from_pandas=True)
        return pd.Series([pack(bottom(s, k)) for _, s in kernels.shingles(column, width)], dtype=object)

    return sketch(text)


def likeness_column(a: Column, b: Column, kind: str = "resemblance", k: int = K) -> Column:
    """Estimated resemblance, or containment of the first in the second, of two packed sketches."""
    of = {"resemblance": resemblance, "containment": containment}[kind]

    @F.pandas_udf("double")
    def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([of(unpack(p), unpack(q), k) for p, q in zip(x, y, strict=True)], dtype=float)

    return likeness(a, b)


def count_column(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles of a packed sketch."""

    @F.pandas_udf("double")
    def count(x: pd.Series) -> pd.Series:
        return pd.Series([distinct_count(unpack(p), k) for p in x], dtype=float)

    return count(sketch)


def merged(df: DataFrame, keys: list[str], sketch: str, k: int = K, fan: int = 64) -> DataFrame:
    """One sketch for each group: merged in ``fan`` salted parts first, then across parts, so no group meets in one task."""

    @F.pandas_udf("string")
    def union(x: pd.Series) -> str:
        out = np.zeros(0, np.uint64)
        for p in x:
            out = merge(out, unpack(p), k=k)
        return pack(out)

    salted = df.withColumn("_part", F.pmod(F.xxhash64(sketch), F.lit(fan)))
    parts = salted.groupBy(*keys, "_part").agg(union(F.col(sketch)).alias("_sketch"))
    return parts.groupBy(*keys).agg(union(F.col("_sketch")).alias(sketch))


def _edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, edited_contained double"


def with_successors(docs: DataFrame, parts: int) -> DataFrame:
    """Columns _bucket, _copy, doc_id, text, dealt so that each row's successor, by descending doc_id, stands in its partition.

    Null ids come last; equal ids, however many, stand in the order of their texts' hashes and texts.  Buckets are ranges
    of that order, cut where a range partitioning of its keys alone cuts; each ends with copies of
    the row that begins the next one, and the last with those of the first.  Only rows alike in id and text stay in one bucket.
    """
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = placed.select("*", F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("d"), F.xxhash64("text").alias("k")).alias("_at"))
    keys = keyed.select("_at.n", "_at.d", "_at.k").repartitionByRange(parts, "n", "d", "k")
    firsts = sorted(tuple(r["first"]) for r in keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("n", "d", "k")).alias("first")).collect())  # a row for each bucket
    if not firsts:
        return placed.select(F.lit(0).alias("_bucket"), F.lit(0).alias("_copy"), "doc_id", "text")
    cuts = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).cast("long").alias("d"), F.lit(k).cast("long").alias("k")) for n, d, k in firsts])
    bucket = F.size(F.filter(cuts, lambda c: c <= F.col("_at"))) - 1
    spread = keyed.withColumn("_own", bucket).withColumn("_head", F.element_at(cuts, F.col("_own") + 1) == F.col("_at"))
    own = F.struct(F.col("_own").alias("b"), F.lit(0).alias("c"))
    copy = F.struct(F.pmod(F.col("_own") - 1, F.lit(len(firsts))).alias("b"), F.lit(1).alias("c"))
    spread = spread.withColumn("_to", F.explode(F.when(F.col("_head"), F.array(own, copy)).otherwise(F.array(own))))
    dealt = spread.select(F.col("_to.b").alias("_bucket"), F.col("_to.c").alias("_copy"), "doc_id", "text", "_at").repartitionById(len(firsts), F.col("_bucket"))
    return dealt.sortWithinPartitions("_bucket", "_copy", "_at", "text").select("_bucket", "_copy", "doc_id", "text")


def fingerprints(docs: DataFrame, k: int = K, width: int = kernels.WIDTH, parts: int | None = None) -> DataFrame:
    """Sketches of every text, of its edited text, and their likenesses.

    The edited text has its last third replaced by the beginning of the next
    text by descending doc_id.  Nulls are empty texts; repeated rows are kept
    and follow each other; other columns are not read.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches):
        carry = None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            texts = batch.column(3)
            sketches = [bottom(s, k) for _, s in kernels.shingles(texts, width)]
            every = [(*r, t, s) for r, t, s in zip(rows, texts.to_pylist(), sketches, strict=True)]
            if carry is not None:
                every.insert(0, carry)
            if not every:
                continue
            pairs = [(x, y) for x, y in zip(every, every[1:], strict=False) if not x[1] and x[0] == y[0]]
            carry = every[-1]
            for at in range(0, len(pairs), 500):
                part = pairs[at : at + 500]
                edits = [_edited(x[3], y[3]) for x, y in part]
                marks = [bottom(s, k) for _, s in kernels.shingles(pa.array(edits, type=pa.string()), width)]
                out = [(x[2], len(x[3]), hashlib.sha256(e.encode("utf-8")).hexdigest(), pack(x[4]), pack(m), resemblance(x[4], m, k), resemblance(x[4], y[4], k), distinct_count(x[4], k), containment(m, x[4], k)) for (x, y), e, m in zip(part, edits, marks, strict=True)]
                names = [c.split()[0] for c in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4], strict=True)], names=names)

    return with_successors(docs, parts).mapInArrow(each, RESULT)
