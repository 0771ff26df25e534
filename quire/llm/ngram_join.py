"""Jaccard join of documents' word-shingle sets with set-relation skipping.

Two sets of sizes a and b link when 100 * common >= 80 * union.  Exact and complete:

1. Sets are hashed; equal sets are one set from here on.
2. All shingles are counted, in buckets of their hashes, and each chunk of texts gets its shingles' counts
   back as levels.  The global order of shingles is by level, then by hash: rare ones first, without a bound on how many are frequent.
3. A set posts its prefix: its first a - ceil(0.8 a) + 1 shingles, but for those that no other set has; two sets
   that link share one of these.  Index lists hold (size, position, set), sorted so, in blocks of
   equal size.  Of each block a set meets just the positions with which the overlap can still be reached: blocks of
   other sizes and all other positions are skipped, no pair is made of them.
   Short lists give pairs, counted over all lists; a pair whose count cannot
   reach the overlap any more goes.  Longer lists only chain neighbours of compatible sizes.
4. Families, the components of what is left, are compared in blocks of compatible sizes.  Every block is compared
   with itself and with a few sets of the family; only sets that are still outside the family's largest
   part then meet the other blocks.  A set's overlaps with a block derive from those of the set before,
   by their difference, wherever it is the smaller; only links that join trees leave a task.
5. Components of links, mapped back to documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import dealing, kernels
from quire.llm.components import Forest, components, release
from quire.llm.storage import drop, written

PERCENT = 80
#: entries of a list that gives pairs
SHORT = 64
#: sets of a block, at most and at least; sets of each size class of a family that all its blocks are compared with
BLOCK, LEAST_BLOCK, CENTRES = 512, 64, 4
#: large families whose sizes may be broadcast
FEW = 1 << 20
#: bytes of texts in a chunk; shingles in a bucket, which decides how many buckets there are
CHUNK, BUCKET = 3 << 20, 1 << 22
_U = np.uint64


def set_id(values: np.ndarray) -> int:
    """Identity of a sorted set, as a signed long."""
    return int(np.int64(_U(xxhash.xxh3_64_intdigest(values.tobytes(), seed=kernels.SEED)).astype(np.int64)))


def least_overlap(total, percent: int = PERCENT):
    """Smallest overlap with which sets of that total size link."""
    return -(-percent * total // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    return n + (-percent * n // 100) + 1


def bucket_of(values: np.ndarray, parts: int) -> np.ndarray:
    """Bucket of a shingle, by a second hash, as prefixes hold the smallest of the first."""
    return ((kernels.mix(values ^ _U(0x9E3779B97F4A7C15)) >> _U(32)) * _U(parts)) >> _U(32)


def _order(bucket: np.ndarray, parts: int) -> np.ndarray:
    return np.argsort(bucket.astype(np.uint16) if parts <= 65536 else bucket, kind="stable")


def _dealt(values: np.ndarray, fields: list[np.ndarray], parts: int):
    """(bucket, bytes) of the rows of ``fields`` in each bucket of values."""
    bucket = bucket_of(values, parts)
    order = _order(bucket, parts)
    table = np.concatenate([f[order] for f in fields], axis=1)
    ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=parts))
    for b in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(b), table[(ends[b - 1] if b else 0) : ends[b]].tobytes()


def _bytes(values: np.ndarray, width: int) -> np.ndarray:
    size = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, size)[:, :width]


def _numbers(table: np.ndarray, at: int, width: int, dtype) -> np.ndarray:
    out = np.zeros((len(table), np.dtype(dtype).itemsize), dtype=np.uint8)
    out[:, :width] = table[:, at : at + width]
    return out.view(dtype).ravel()


def chunk_sets(texts: pa.Array, width: int) -> dict[int, np.ndarray]:
    """The different sets of a chunk by identity, without empty ones, in order."""
    out: dict[int, np.ndarray] = {}
    for _, s in kernels.shingles(texts, width):
        if len(s):
            s = kernels.distinct(s)
            out.setdefault(set_id(s), s)
    return out


def shingle_levels(texts: DataFrame, tasks: int, parts: int, width: int, limit: int = CHUNK) -> DataFrame:
    """(bucket, chunk, payload): level of each shingle of a chunk's sets that is in the bucket, in order; texts: part, text.

    A level grows with the logarithm of the number of sets; 0: no other set has it.  A bucket whose shingles are all
    at 0 sends nothing.  A collision only moves a shingle in the order, everywhere alike.
    """

    def deal(batches):
        for chunk, some in dealing.chunks(batches, limit):
            sets = chunk_sets(some.column(0), width)
            if sets:
                every = np.concatenate(list(sets.values()))
                yield dealing.emit([(b, chunk, x) for b, x in _dealt(every, [_bytes(every, 5)], parts)])

    def count(batches):
        for bucket, some in dealing.in_order(batches):
            keys = _numbers(np.frombuffer(b"".join(x for _, x in some), dtype=np.uint8).reshape(-1, 5), 0, 5, "<u8")
            order = np.argsort(keys, kind="stable")
            new = np.r_[True, np.diff(keys[order]) != 0]
            sizes = np.diff(np.r_[np.flatnonzero(new), len(keys)])
            levels = np.empty(len(keys), dtype=np.uint8)
            levels[order] = np.repeat(np.minimum(255, np.ceil(8 * np.log2(sizes))).astype(np.uint8), sizes)
            at = 0
            for chunk, x in some:
                mine = levels[at : at + len(x) // 5]
                at += len(mine)
                if mine.any():
                    yield dealing.emit([(bucket, chunk, mine.tobytes())])

    return dealing.to_tasks(texts.mapInArrow(deal, dealing.MESSAGE), tasks).mapInArrow(count, dealing.MESSAGE)


def postings(texts: DataFrame, tasks: int, parts: int, width: int, percent: int = PERCENT, limit: int = CHUNK) -> DataFrame:
    """(bucket, chunk, payload): prefixes of the sets, each entry its shingle, set, size and position."""

    def carried(batches):
        for chunk, some in dealing.chunks(batches, limit):
            yield dealing.emit([(-1, chunk, dealing.packed(some))])

    def post(batches):
        def posted(levels):
            sets = chunk_sets(dealing.unpacked(levels.pop(-1)).column(0), width)
            if not levels or not sets:
                return []
            every = np.concatenate(list(sets.values()))
            bucket = bucket_of(every, parts)
            order, level = _order(bucket, parts), np.zeros(len(every), dtype=np.uint8)
            starts = np.r_[0, np.cumsum(np.bincount(bucket.astype(np.int64), minlength=parts))]
            for b, x in levels.items():
                level[order[starts[b] : starts[b + 1]]] = np.frombuffer(x, dtype=np.uint8)  # of equal length, or the chunks differ
            held, at = [], 0
            for name, s in sets.items():
                own, at = level[at : at + len(s)], at + len(s)
                first = np.argsort(own, kind="stable")[: prefix_length(len(s), percent)]
                rank = np.flatnonzero(own[first])
                held.append((s[first[rank]], rank.astype(np.uint32), name, len(s)))
            count = [len(h[0]) for h in held]
            shingle = np.concatenate([h[0] for h in held])
            sid = np.repeat(np.array([h[2] for h in held], dtype=np.int64), count)
            n = np.repeat(np.array([h[3] for h in held], dtype=np.uint32), count)
            return _dealt(shingle, [_bytes(shingle, 6), _bytes(sid, 8), _bytes(n, 4), _bytes(np.concatenate([h[1] for h in held]), 4)], parts) if len(shingle) else []

        for _, messages in dealing.by_chunk(batches):
            if out := [(b, 0, p) for b, p in posted(messages)]:
                yield dealing.emit(out)

    met = texts.mapInArrow(carried, dealing.MESSAGE).unionByName(shingle_levels(texts, tasks, parts, width, limit))
    return met.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(post, dealing.MESSAGE)


def compatible_pairs(starts, sizes, n, rank, short: int, percent: int):
    """Positions (x, y), x before y, of entries of one list that may link, over all lists of 2 to ``short`` entries sorted by (n, rank).

    A list's entries of one size are a block; of each block an entry meets one range of positions, or none of it.
    """
    some = (sizes >= 2) & (sizes <= short)
    if not some.any():
        return
    starts, sizes = starts[some], sizes[some]
    y = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    which = np.repeat(np.arange(len(sizes)), sizes)
    n, rank = n[y], rank[y]
    new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (n[1:] != n[:-1])])
    block = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(y)]))
    by_size, by_rank = (which[new] << 32) + n[new], (block << 32) + rank
    lowest = np.searchsorted(by_size, (which << 32) + -(-percent * n // 100))
    meets = block - lowest + 1
    step = max(1, int(np.searchsorted(np.cumsum(meets), 1 << 18)))
    for lo in range(0, len(y), step):
        e = np.arange(lo, min(len(y), lo + step))
        own = np.repeat(e, meets[e])
        b = np.arange(len(own)) - np.repeat(np.cumsum(meets[e]) - meets[e] - lowest[e], meets[e])
        nx, ny, ry = n[new[b]], n[own], rank[own]
        need = least_overlap(nx + ny, percent)
        first = np.searchsorted(by_rank, (b << 32) + np.maximum(0, need - ny + ry))
        last = np.minimum(np.searchsorted(by_rank, (b << 32) + nx + ry - need, side="right"), own)
        found = np.flatnonzero(last > first)
        first, count, own = first[found], (last - first)[found], own[found]
        for part in np.array_split(np.arange(len(found)), max(1, int(count.sum()) >> 19)):
            c = count[part]
            x = np.arange(int(c.sum())) + np.repeat(first[part] - (np.cumsum(c) - c), c)
            yield y[x], y[np.repeat(own[part], c)]


def candidate_edges(texts: DataFrame, tasks: int, parts: int, width: int, percent: int = PERCENT, short: int = SHORT, limit: int = CHUNK) -> DataFrame:
    """(a, b) of set ids that may link, or that chain sets which may; texts: part, text."""

    def index(batches):
        for _, some in dealing.in_order(batches):
            yield from listed(np.frombuffer(b"".join(x for _, x in some), dtype=np.uint8).reshape(-1, 22))

    def listed(table):
        key, sid = _numbers(table, 0, 6, "<u8"), _numbers(table, 6, 8, "<i8")
        n, rank = _numbers(table, 14, 4, "<u4").astype(np.int64), _numbers(table, 18, 4, "<u4").astype(np.int64)
        order = np.lexsort((sid, rank, n, key))
        key, sid, n, rank = key[order], sid[order], n[order], rank[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])]
        key, sid, n, rank = key[new], sid[new], n[new], rank[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])

        def out(x, y, count):
            low, high = np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])
            flip = sid[x] > sid[y]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (low, high, np.where(flip, n[y], n[x]), np.where(flip, n[x], n[y]), count)], names=["a", "b", "na", "nb", "common"])

        held, size = [], 0

        def counted():
            x, y = (np.concatenate(v) for v in zip(*held, strict=True))
            order = np.lexsort((sid[y], sid[x]))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.r_[True, (sid[x][1:] != sid[x][:-1]) | (sid[y][1:] != sid[y][:-1])]) if len(x) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(x)]).astype(np.int64)
            for lo in range(0, len(first), 65536):
                yield out(x[first[lo : lo + 65536]], y[first[lo : lo + 65536]], count[lo : lo + 65536])

        for x, y in compatible_pairs(starts, sizes, n, rank, short, percent):
            flip = sid[x] > sid[y]
            held.append((np.where(flip, y, x), np.where(flip, x, y)))
            size += len(x)
            if size >= 1 << 21:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()
        long = np.repeat(sizes > short, sizes)
        x = np.flatnonzero(long[:-1] & (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:]))
        if len(x):
            a, b = np.minimum(sid[x], sid[x + 1]), np.maximum(sid[x], sid[x + 1])
            x = x[np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)[1]]
            for lo in range(0, len(x), 65536):
                yield out(x[lo : lo + 65536], x[lo : lo + 65536] + 1, np.full(len(x[lo : lo + 65536]), 1 << 40, dtype=np.int64))

    dealt = dealing.to_tasks(postings(texts, tasks, parts, width, percent, limit), tasks)
    pairs = dealt.mapInArrow(index, "a long, b long, na long, nb long, common long").groupBy("a", "b", "na", "nb").agg(F.sum(F.least("common", F.lit(1 << 40))).alias("common"))
    outside = lambda c: F.expr(f"({percent} * {c} + 99) div 100 - 1")  # noqa: E731  shingles behind the prefix
    needed = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    return pairs.where(F.col("common") + F.greatest(outside("na"), outside("nb")) >= needed).select("a", "b")


class _Index:
    """Index lists of a block of sets, to count every member's overlap with another set."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        at = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        self.values, self.at, self.size, self.n = every[at], at, np.diff(np.r_[at, len(every)]), len(sets)

    def counts(self, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(self.n, dtype=np.int64)
        i = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        i = i[self.values[i] == values]
        size = self.size[i]
        total = int(size.sum())
        if not total:
            return np.zeros(self.n, dtype=np.int64)
        lists = np.arange(total) + np.repeat(self.at[i] - np.r_[0, np.cumsum(size)[:-1]], size)
        return np.bincount(self.owner[lists], minlength=self.n)


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between two blocks, or inside one (right: None), reduced to a forest; right counts on from left."""
    own = right is None
    other = left if own else right
    index, sizes = _Index(other), np.array([len(s) for s in other], dtype=np.int64)
    shift, forest, out = (0 if own else len(left)), Forest(len(left) + (0 if own else len(other))), []
    before = counts = None
    for x in sorted(range(len(left)), key=lambda k: int(left[k][0])):
        s = left[x]
        if 100 * len(s) >= percent * sizes.min() and percent * len(s) <= 100 * sizes.max():
            added = gone = None
            if before is not None:
                added = s[~np.isin(s, before, assume_unique=True)]
                if 2 * len(added) + len(before) - len(s) < len(s):
                    gone = before[~np.isin(before, s, assume_unique=True)]
            counts = counts + index.counts(added) - index.counts(gone) if gone is not None else index.counts(s)
            before = s
            links = np.flatnonzero(100 * counts >= percent * (sizes + len(s) - counts))
            if own:
                links = links[links != x]
            out += [(x, y) for y in forest.join(x, links + shift)] if len(links) else []
    return out


def family_links(members: DataFrame, width: int, percent: int = PERCENT) -> DataFrame:
    """(a, b) of set ids that link; members: task, set, side, text.

    Sides 0 and 1 of a task are compared with each other; sets of side 2 also among themselves, and with those of side 1.
    """

    def each(batches):
        key, held = None, []

        def found():
            texts = pa.array([h[2] for h in held], type=pa.string())
            sets = [kernels.distinct(s) for _, s in kernels.shingles(texts, width)]
            seen = {(h[0], h[1]): k for k, (h, s) in enumerate(zip(held, sets, strict=True)) if set_id(s) == h[0]}  # an id can stand for other texts too
            rows = sorted(seen.values())
            left, right = [k for k in rows if held[k][1] != 1], [k for k in rows if held[k][1] == 1]
            links = []
            if len(left) > 1 and held[left[0]][1] == 2:
                links += block_links([sets[k] for k in left], None, percent)
            if left and right:
                links += block_links([sets[k] for k in left], [sets[k] for k in right], percent)
            at = left + right
            return pa.RecordBatch.from_arrays([pa.array([held[at[x]][0] for x, _ in links], type=pa.int64()), pa.array([held[at[y]][0] for _, y in links], type=pa.int64())], names=["a", "b"])

        for batch in batches:
            for task, sid, side, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if task != key:
                    if held:
                        yield found()
                    key, held = task, []
                held.append((sid, side, text))
        if held:
            yield found()

    return members.select("task", "set", "side", "text").repartition("task").sortWithinPartitions("task").mapInArrow(each, "a long, b long")


def _blocks(members: DataFrame, block: int, label: str) -> DataFrame:
    """members with the block of each: a number below that of its family's blocks of its size class, by hash."""
    classes = members.groupBy("family", "class").agg(F.ceil(F.count("*") / block).cast("long").alias("_n"))
    return members.join(classes, ["family", "class"]).withColumn(label, F.pmod(F.xxhash64("set"), F.col("_n"))).drop("_n")


def compare_families(members: DataFrame, texts: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """(a, b) of set ids, the links of all families reduced to forests; members: family, set, _id, n; texts: _doc, text.

    A family of up to ``block`` sets is one task.
    """

    def linked(rows: DataFrame, name: str) -> DataFrame:
        return written(family_links(rows.join(texts, F.col("_id").eqNullSafe(F.col("_doc"))), width, percent), name)

    sizes = written(members.groupBy("family").agg(F.count("*").alias("_size")).where(F.col("_size") > block), "large")
    few = sizes.count() <= FEW  # then they may be broadcast, and the members of small families are not shuffled by family
    marked = members.join(F.broadcast(sizes) if few else sizes, "family", "left")
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent))  # sets that link are of one class or of neighbouring ones
    large = written(_blocks(marked.where("_size is not null").select("family", "set", "_id", size_class.cast("long").alias("class")), block, "b"), "members")
    near = lambda c: F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias(c)
    picks = [F.min_by(F.struct("set", "_id"), F.xxhash64(F.lit(k), "set")).alias(f"p{k}") for k in range(CENTRES)]
    centres = large.groupBy("family", "class").agg(*picks).select("family", "class", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(CENTRES)]))).alias("p")).select("family", (F.col("class")).alias("c0"), near("d"), "p.set", "p._id")
    blocks = large.select("family", "class", "b").distinct()
    met = centres.select("family", (F.col("c0") + F.col("d")).alias("class"), "set", "_id").join(blocks, ["family", "class"])
    task = lambda *c: F.struct(*[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in c])
    own = large.select(F.xxhash64(task("family", "class", "b")).alias("task"), "set", "_id", F.lit(2).alias("side"))
    own = own.unionByName(marked.where("_size is null").select(F.xxhash64(task("family")).alias("task"), "set", "_id", F.lit(2).alias("side")))
    first = linked(own.unionByName(met.select(F.xxhash64(task("family", "class", "b")).alias("task"), "set", "_id", F.lit(1).alias("side"))), "links")
    if not large.limit(1).count():
        return first
    parts = written(components(first), "parts")
    named = written(large.join(parts.withColumnRenamed("node", "set"), "set", "left").withColumn("part", F.coalesce("component", "set")).drop("component"), "named")  # a table, so that its parts are not counted where families meet
    main = named.groupBy("family", "part").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    rest = written(_blocks(named.join(main, "family").where("part != main").select("family", "class", "set", "_id"), block, "r"), "rest")
    left_blocks = rest.select("family", F.col("class").alias("c1"), "r").distinct()
    right_blocks = blocks.select("family", F.col("class").alias("c2"), "b")
    close = F.abs(F.col("c1") - F.col("c2")) <= 1
    pair = F.xxhash64(task("family", "c1", "r", "c2", "b")).alias("task")
    left = rest.withColumnRenamed("class", "c1").join(right_blocks, "family").where(close).select(pair, "set", "_id", F.lit(0).alias("side"))
    right = large.select("family", F.col("class").alias("c2"), "b", "set", "_id").join(left_blocks, "family").where(close).select(pair, "set", "_id", F.lit(1).alias("side"))
    second = linked(left.unionByName(right), "links")
    return second.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))


def documents_sets(docs: DataFrame, width: int = kernels.WIDTH) -> DataFrame:
    """doc_id, n_shingles, set (id of the set; null where it is empty)."""

    def each(batches):
        for batch in batches:
            sizes, names = [], []
            for _, s in kernels.shingles(batch.column(1), width):
                s = kernels.distinct(s)
                sizes.append(len(s))
                names.append(set_id(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int64()), pa.array(names, type=pa.int64())], names=["doc_id", "n_shingles", "set"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(each, "doc_id long, n_shingles long, set long")


def join_components(docs: DataFrame, width: int = kernels.WIDTH, percent: int = PERCENT, block: int = BLOCK, short: int = SHORT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links.

    A null, empty or blank text has an empty set and is a component of its
    own; a text of fewer than ``width`` words has one shingle.  Repeated rows stay and
    fall into one component.  Null ids link too, but never name a component unless all its ids are null.
    """
    spark = docs.sparkSession
    rows = written(documents_sets(docs, width), "sets")
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = tasks * max(1, -(-total // (BUCKET * tasks)))
    texts = docs.select(F.spark_partition_id().alias("part"), "text")
    families = written(components(candidate_edges(texts, tasks, parts, width, percent, short, chunk)), "families")
    release(spark)
    sets = rows.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("_id"), F.max("n_shingles").alias("n"))
    members = written(sets.join(families.select(F.col("node").alias("set"), F.col("component").alias("family")), "set"), "family-sets")
    largest = families.groupBy("component").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    block = int(min(block, max(min(block, LEAST_BLOCK), largest / tasks)))  # so that the largest family is spread over the partitions
    texts_by_id = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text")
    found = written(components(compare_families(members, texts_by_id, width, percent, block)), "components")
    drop(families)
    named = rows.where("set is not null").join(found.withColumnRenamed("node", "set"), "set", "left").select("doc_id", "n_shingles", F.coalesce("component", "set").alias("_c"))
    firsts = written(named.groupBy("_c").agg(F.min("doc_id").alias("component_id")), "firsts")
    alone = rows.where("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.join(firsts, "_c").select("doc_id", "n_shingles", "component_id").unionByName(alone)
