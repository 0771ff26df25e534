"""Embedding near-dedup: an exact metric range join of unit vectors.

cosine >= c means a distance of at most e = sqrt(2 - 2c) between unit vectors.
Pivots cut each group (label and length) into cells of nearest vectors.  A
vector also visits every later cell that can hold a vector within e: by the
triangle inequality if its distance to the pivot is at most the cell's radius + e,
and by the bisector of the two pivots.  Members within e / 2 of a pivot all link
with each other, and a vector that is near or far enough links with all or none of these: counted, not
compared.  The rest of a cell is compared in pairs of blocks, each a task of
bounded size, so no cell is too large for one task.  Pivots are broadcast, so
their number is bounded: groups beyond the largest ``PIVOTS`` are one cell each, in
pairs of blocks, without a pivot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import Forest, components
from quire.llm.storage import written

COSINE = 0.93
#: bounds: vectors a pivot stands for, pivots in all (they are broadcast), vectors in a block
CELL, PIVOTS, BLOCK = 4096, 2048, 2048
#: bytes of all pivots, at most
PIVOT_BYTES = 32 << 20
SLACK = 1e-7
CLOSE = 1e-10


def unit_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, group, unit (bytes of doubles) of vectors that can link; equal ids are one vector, its first by (label, embedding)."""

    def each(batches):
        for batch in batches:
            ids, groups, units = [], [], []
            for vec_id, label, values in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if vec_id is None or label is None or not values or any(v is None for v in values):
                    continue
                v = np.array(values, dtype=np.float64)
                if not np.isfinite(v).all() or not v.any():
                    continue
                v = v / np.abs(v).max()  # neither overflow nor underflow in the norm
                ids.append(vec_id)
                groups.append(f"{label}/{len(v)}")
                units.append((v / np.sqrt(v @ v)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(groups, type=pa.string()), pa.array(units, type=pa.binary())], names=["vec_id", "grp", "unit"])

    first = vectors.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("label", "embedding")).alias("v"))
    return first.select("vec_id", "v.label", "v.embedding").mapInArrow(each, "vec_id long, grp string, unit binary")


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.float64).reshape(len(values), -1)


def choose_pivots(units: DataFrame, e: float, cell: int = CELL, most: int = PIVOTS) -> tuple[dict[str, np.ndarray], bool]:
    """Pivots of each of the ``most`` largest groups, and whether there are more groups: those of its ids first by hash that lie farther than e apart, one for ``cell`` vectors and one at least."""
    longest = units.agg(F.coalesce(F.max(F.octet_length("unit")), F.lit(8))).first()[0]
    most = max(1, min(most, PIVOT_BYTES // longest))
    largest = units.groupBy("grp").count().orderBy(F.desc("count"), "grp").limit(most + 1).collect()
    counts = {r["grp"]: r["count"] for r in largest[:most]}
    scale = max(cell, sum(counts.values()) / max(1, most - len(counts)))
    wanted = {g: max(1, round(n / scale)) for g, n in counts.items()}
    rate = units.sparkSession.createDataFrame([(g, min(1.0, 4 * k / counts[g])) for g, k in wanted.items()] or [("", 0.0)], "g string, rate double")
    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    some = units.join(F.broadcast(rate), F.col("grp") == F.col("g")).where((hashed < F.col("rate"))).orderBy(hashed, "vec_id").limit(8 * most)
    out: dict[str, list[np.ndarray]] = {}
    for r in some.select("grp", "unit").collect():
        held, v = out.setdefault(r["grp"], []), np.frombuffer(r["unit"], dtype=np.float64)
        if len(held) < wanted[r["grp"]] and all(np.sqrt(max(0.0, 2 - 2 * (v @ p))) > e for p in held):
            held.append(v)
    missed = [(g,) for g in counts if g not in out]  # no row of theirs was drawn
    if missed:
        own = units.join(F.broadcast(units.sparkSession.createDataFrame(missed, "g string")), F.col("grp") == F.col("g"))
        for r in own.groupBy("grp").agg(F.min_by("unit", F.struct(hashed.alias("at"), "vec_id")).alias("unit")).collect():
            out[r["grp"]] = [np.frombuffer(r["unit"], dtype=np.float64)]
    return {g: np.stack(v) for g, v in out.items()}, len(largest) > most


def without_pivots(units: DataFrame, groups: list[str], block: int) -> DataFrame:
    """Rows for the tasks (group, 1, i, j) that compare all blocks of the groups other than ``groups``."""
    spark = units.sparkSession
    rest = units.join(F.broadcast(spark.createDataFrame([(g,) for g in groups], "grp string")), "grp", "left_anti")
    sizes = rest.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int")
    rows = rest.join(sizes, "grp").select("grp", own.alias("b"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"), "vec_id", "unit")
    return rows.select(F.col("grp").alias("c"), F.lit(1).alias("kind"), F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"), (F.col("b") > F.col("k")).cast("int").alias("side"), "vec_id", "unit")


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def block_links(left: np.ndarray, right: np.ndarray | None, cosine: float) -> np.ndarray:
    """Boolean matrix of links; a product that is nearly ``cosine`` is summed exactly."""
    other = left if right is None else right
    product = left @ other.T
    out = product >= cosine
    for i, j in zip(*np.nonzero(np.abs(product - cosine) < CLOSE), strict=True):
        a, b = left[i].tolist(), other[j].tolist()
        out[i, j] = math.fsum(map(lambda p, q: p * q, a, b)) / math.sqrt(math.fsum(p * p for p in a) * math.fsum(q * q for q in b)) >= cosine
    if right is None:
        np.fill_diagonal(out, False)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int | None = None, most: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vec_id.

    Vectors that are null, zero, or hold null or non-finite components, and those
    with a null label or id, link with nothing.  Rows that repeat an id are one vector.
    Vectors of different length never link.
    """
    spark, e = vectors.sparkSession, math.sqrt(2 - 2 * cosine)
    units = written(unit_rows(vectors), "units")
    pivots, more = choose_pivots(units, e, cell, most)
    shared, groups = spark.sparkContext.broadcast(pivots), sorted(pivots)  # PIVOT_BYTES at most
    names = {g: i for i, g in enumerate(groups)}
    first = dict(zip(names, np.cumsum([0, *(len(pivots[g]) for g in names)])[:-1].tolist(), strict=True)) if names else {}
    total = sum(len(p) for p in pivots.values())
    core = e / 2 - SLACK

    def placed(batch):
        """Of each group in a batch: rows, units, distances to its pivots, home cell."""
        pivots = shared.value
        by: dict[str, list[int]] = {}
        for i, g in enumerate(batch.column(1).to_pylist()):
            if g in pivots:
                by.setdefault(g, []).append(i)
        for g, rows in by.items():
            x = _matrix(batch.column(2).take(pa.array(rows)))
            d = _distances(x, pivots[g])
            yield g, np.array(rows), x, d, d.argmin(axis=1)

    def measured(batches):
        radius, inner, n_core, least = np.zeros(total), np.zeros(total), np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for g, rows, _, d, home in placed(batch):
                own, at = d[np.arange(len(rows)), home], first[g] + home
                np.maximum.at(radius, at, own)
                c = own <= core
                np.maximum.at(inner, at[c], own[c])
                np.add.at(n_core, at[c], 1)
                np.minimum.at(least, at[c], ids[rows[c]])
        used = np.arange(total)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (used, radius, inner, n_core, least)], names=["c", "radius", "inner", "n", "least"])

    stats = units.mapInArrow(measured, "c long, radius double, inner double, n long, least long").groupBy("c").agg(F.max("radius").alias("radius"), F.max("inner").alias("inner"), F.sum("n").alias("n"), F.min("least").alias("least")).collect()  # a row for each pivot
    radius, inner, n_core, least = np.zeros(total), np.zeros(total), np.zeros(total, np.int64), np.zeros(total, np.int64)
    for r in stats:
        radius[r["c"]], inner[r["c"]], n_core[r["c"]], least[r["c"]] = r["radius"], r["inner"], r["n"], r["least"]
    bisectors = spark.sparkContext.broadcast({g: np.maximum(1e-12, _distances(p, p)) for g, p in pivots.items()})  # the square of a group's pivots, PIVOTS squared numbers at most
    del pivots

    def roles(g, d, home):
        """For each cell of the group: its number, and masks of core, rest, visitor, full, unsure rows."""
        own, bisector = d[np.arange(len(d)), home], bisectors.value
        for k in range(d.shape[1]):
            c, here = first[g] + k, home == k
            visits = (home < k) & (d[:, k] <= radius[c] + e + SLACK) & (d[:, k] ** 2 - own**2 <= 2 * (e + SLACK) * bisector[g][home, k])
            is_core = here & (own <= core)
            others = (here & ~is_core) | visits
            full = others & (d[:, k] + inner[c] <= e - SLACK) & (n_core[c] > 0)
            unsure = others & ~full & (d[:, k] - inner[c] <= e + SLACK) & (n_core[c] > 0)
            yield c, is_core, here & ~is_core, visits, full, unsure

    def counted(batches):
        out = np.zeros((total, 4), dtype=np.int64)
        for batch in batches:
            for g, _, _, d, home in placed(batch):
                for c, _, rest, visits, full, unsure in roles(g, d, home):
                    out[c] += (rest.sum(), visits.sum(), full.sum(), unsure.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total)), *[pa.array(out[:, i].copy()) for i in range(4)]], names=["c", "rest", "visits", "full", "unsure"])

    sizes = np.zeros((total, 4), dtype=np.int64)
    for r in units.mapInArrow(counted, "c long, rest long, visits long, full long, unsure long").groupBy("c").agg(*[F.sum(x).alias(x) for x in ("rest", "visits", "full", "unsure")]).collect():
        sizes[r["c"]] = r["rest"], r["visits"], r["full"], r["unsure"]
    rows = int(n_core.sum() + sizes[:, 0].sum())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = block or int(min(BLOCK, max(64, rows / (3.5 * math.sqrt(parts)))))
    blocks = lambda n: np.maximum(1, -(-n // block))
    b_core, b_rest, b_visits, b_unsure = blocks(n_core), blocks(sizes[:, 0]), blocks(sizes[:, 1]), blocks(sizes[:, 3])

    def dealt(batches):
        """Rows for the tasks (cell, kind, i, j): kind 0 core with unsure, 1 rest with rest, 2 rest with visitors; kind -1: links counted already."""
        for batch in batches:
            ids, out = batch.column(0).to_numpy(), []
            for g, at, x, d, home in placed(batch):
                spread = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for c, is_core, rest, visits, full, unsure in roles(g, d, home):
                    own = lambda mask, n: (np.flatnonzero(mask), (spread[mask] % np.uint64(n)).astype(int))
                    if sizes[c, 3]:
                        out += [(c, 0, int(b), j, 0, r) for r, b in zip(*own(is_core, b_core[c]), strict=True) for j in range(b_unsure[c])]
                        out += [(c, 0, i, int(b), 1, r) for r, b in zip(*own(unsure, b_unsure[c]), strict=True) for i in range(b_core[c])]
                    for r, b in zip(*own(rest, b_rest[c]), strict=True):
                        out += [(c, 1, min(int(b), k), max(int(b), k), int(b > k), r) for k in range(b_rest[c])]
                        if sizes[c, 1]:
                            out += [(c, 2, int(b), j, 0, r) for j in range(b_visits[c])]
                    if sizes[c, 0]:
                        out += [(c, 2, i, int(b), 1, r) for r, b in zip(*own(visits, b_visits[c]), strict=True) for i in range(b_rest[c])]
                    out += [(c, -1, int(n_core[c]), 0, 0, r) for r in np.flatnonzero(full)]
                    out += [(c, -1, int(n_core[c] - 1 + sizes[c, 2]), 0, 0, r) for r in np.flatnonzero(is_core)]
                for lo in range(0, len(out), 8192):
                    part = out[lo : lo + 8192]
                    here = [o[5] for o in part]
                    yield pa.RecordBatch.from_arrays([*[pa.array([o[k] for o in part], type=pa.int32()) for k in range(5)], pa.array(ids[at[here]]), pa.array([x[h].tobytes() if o[1] >= 0 else None for h, o in zip(here, part, strict=True)], type=pa.binary())], names=["c", "kind", "i", "j", "side", "vec_id", "unit"])
                out = []

    def linked(batches):
        """(vec_id, links, other): links of a vector in a task, and a vector it is linked with, for trees."""
        key, held = None, []

        def found():
            if key[1] < 0:
                return [(v, i, int(least[key[0]]), 1) for v, i, _, _ in held]
            left, right = [h for h in held if h[2] == 0], [h for h in held if h[2] == 1]
            own = key[1] == 1 and key[2] == key[3]
            if not left or not (own or right):
                return []
            m = lambda rows: np.frombuffer(b"".join(h[3] for h in rows), dtype=np.float64).reshape(len(rows), -1)
            links = block_links(m(left), None if own else m(right), cosine)
            both = left if own else left + right
            shift, forest, out = (0 if own else len(left)), Forest(len(both)), []
            n = links.sum(axis=1)
            for x in np.flatnonzero(n):
                trees = forest.join(int(x), np.flatnonzero(links[x]) + shift)
                out.append((left[x][0], int(n[x]), left[x][0], 1))
                out += [(left[x][0], 0, both[y][0], 1) for y in trees]
            if not own:
                n = links.sum(axis=0)
                out += [(right[y][0], int(n[y]), right[y][0], 1) for y in np.flatnonzero(n)]
            return out

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], type=pa.int64()) for k in range(3)], names=["vec_id", "links", "other"])

        for batch in batches:
            for c, kind, i, j, side, vec_id, unit in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                now = (c, kind, i, j) if kind >= 0 else (c, kind)
                if now != key:
                    if held and (out := found()):
                        yield batch_of(out)
                    key, held = now, []
                held.append((vec_id, i, side, unit))
                if kind < 0 and len(held) >= 8192:
                    yield batch_of(found())
                    held = []
        if held and (out := found()):
            yield batch_of(out)

    if total:
        tasks = units.mapInArrow(dealt, "c int, kind int, i int, j int, side int, vec_id long, unit binary")
        salt = F.when(F.col("kind") < 0, F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))).otherwise(0)
        joined = tasks.repartition("c", "kind", "i", "j", salt).sortWithinPartitions("c", "kind", "i", "j").mapInArrow(linked, "vec_id long, links long, other long")
    else:
        joined = spark.createDataFrame([], "vec_id long, links long, other long")
    if more:
        others = without_pivots(units, groups, block)
        joined = joined.unionByName(others.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j").mapInArrow(linked, "vec_id long, links long, other long"))
    joined = written(joined, "links")
    links = joined.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    parts_of = written(components(joined.where("vec_id != other").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))), "components")
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    out = every.join(links, "vec_id", "left").join(parts_of.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
