"""Line dedup: repeated multi-line chunks, with boundaries that content chooses.

Lines are hashed; a rolling hash over two neighbouring line hashes ends a chunk
where it falls into one of ``modulus`` classes, so chunks find their boundaries again
behind inserted or removed lines.  Several seeds cut a text in several ways.  Every two
neighbouring lines that are not blank, with the blank ones between, are a chunk as well, which no
other line decides, so every repeated run of two or more such lines is covered whole;
a line goes if any of its chunks is a repetition.  A chunk can be removed with two or more
lines that are not blank; a line of ``long_words`` words or more is cut off from its neighbours and
counts as a passage.  Of equal chunks, compared byte by byte, the
occurrence first by (doc_id, text hash, line) stays.  Expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import written

SEEDS = (1, 2, 3, 4)
MODULUS = 2
LONG_WORDS = 50


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(lines: Column, seeds: tuple[int, ...], modulus: int, long_words: int) -> Column:
    """Distinct struct<first,last,hash,big> of the chunks that can be removed; lines count from 1."""
    facts = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(F.btrim(x)) > 0).alias("full"), ((F.length(x) >= 2 * long_words - 1) & (F.size(F.split(F.btrim(x), r"\s+")) >= long_words)).alias("big")))

    def cut(f: Column, seed: int) -> Column:
        n = F.size(f)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | f[i - 1]["big"] | f[F.least(i, n - 1)]["big"] | (F.pmod(F.xxhash64(F.lit(seed), f[F.greatest(i - 2, F.lit(0))]["h"], f[i - 1]["h"]), F.lit(modulus)) == 0))
        return _let(ends, lambda e: F.transform(e, lambda last, j: F.struct((F.coalesce(F.get(e, j - 1), F.lit(0)) + 1).alias("first"), last.alias("last"))))

    def pairs(f: Column) -> Column:
        full = F.filter(F.sequence(F.lit(1), F.size(f)), lambda i: f[i - 1]["full"])
        return _let(full, lambda p: F.transform(F.slice(p, 2, F.size(p)), lambda last, j: F.struct(p[j].alias("first"), last.alias("last"))))

    def kept(f: Column, c: Column) -> Column:
        part = F.slice(f, c["first"], c["last"] - c["first"] + 1)
        return F.exists(part, lambda x: x["big"]) | (F.size(F.filter(part, lambda x: x["full"])) >= 2)

    def of(f: Column) -> Column:
        every = F.array_distinct(F.concat(pairs(f), *[cut(f, s) for s in seeds]))
        return F.transform(F.filter(every, lambda c: kept(f, c)), lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), F.xxhash64(F.transform(F.slice(f, c["first"], c["last"] - c["first"] + 1), lambda x: x["h"]), c["last"] - c["first"]).alias("hash")))

    return _let(facts, of)


def chunk_rows(docs: DataFrame, seeds: tuple[int, ...] = SEEDS, modulus: int = MODULUS, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, row (hash of the row), hash, first, last of every chunk that can be removed."""
    lines = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.split("text", "\n").alias("lines"))
    return lines.select("doc_id", "row", F.explode(_chunks(F.col("lines"), seeds, modulus, long_words)).alias("c")).select("doc_id", "row", "c.hash", "c.first", "c.last")


def dedup_lines(docs: DataFrame, seeds: tuple[int, ...] = SEEDS, modulus: int = MODULUS, long_words: int = LONG_WORDS, counts: tuple[str, str] = ("n_lines", "removed_lines")) -> DataFrame:
    """The columns of docs, text without repeated chunks, and how many lines a text had and lost, in columns named by ``counts``.

    A null text stays null with 0 lines; an empty one is one line.  Rows alike in doc_id and text are one occurrence, so
    they keep or lose the same lines.  A text can become empty; no row goes.  Columns named as
    ``counts`` are replaced; other columns, whatever their names, stay.
    """
    docs = docs.drop(*counts)
    rows = written(chunk_rows(docs, seeds, modulus, long_words), "chunks")  # a few numbers for each chunk, read three times
    place = F.struct("doc_id", "row", "first")
    repeated = rows.groupBy("hash").agg(F.min(place).alias("stays"), F.max(place).alias("ends")).where("stays != ends")
    found = rows.join(repeated.select("hash", "stays"), "hash")
    own_id, own_key, id_, row, chunks_, false_, lines_, lost_ = (f"__quire_{x}" for x in ("doc", "key", "id", "row", "chunks", "false", "lines", "lost"))
    lists = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("hash", "first", "last", (place != F.col("stays")).alias("again"))).alias(chunks_)).withColumnsRenamed({"doc_id": id_, "row": row})
    same = F.col(own_id).eqNullSafe(F.col(id_)) & (F.col(own_key) == F.col(row))
    keyed = docs.withColumns({own_id: F.col("doc_id"), own_key: F.xxhash64("doc_id", "text")})
    held = keyed.join(lists.hint("shuffle_hash"), same, "left").drop(id_, row)
    # reads what the result reads of a document, so that both share one shuffle of texts
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    texts = held.where(F.col(chunks_).isNotNull()).select(F.explode(chunks_).alias("c"), F.split("text", "\n").alias("lines"), F.xxhash64(*plain).alias("seen"))
    texts = texts.select("c.hash", F.array_join(F.slice("lines", F.col("c.first"), F.col("c.last") - F.col("c.first") + 1), "\n").alias("bytes"), "seen")
    unequal = texts.groupBy("hash").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b"), F.max("seen").alias("seen")).where("a != b and seen is not null").select("hash")
    false = found.join(unequal, "hash", "left_semi").groupBy("doc_id", "row").agg(F.collect_set("hash").alias(false_)).withColumnsRenamed({"doc_id": id_, "row": row})
    held = held.join(false.hint("shuffle_hash"), same, "left").drop(id_, row)
    gone = F.filter(F.coalesce(chunks_, F.array().cast("array<struct<hash:bigint,first:int,last:int,again:boolean>>")), lambda c: c["again"] & ~F.coalesce(F.array_contains(false_, c["hash"]), F.lit(False)))
    lost = F.array_distinct(F.flatten(F.transform(gone, lambda c: F.sequence(c["first"], c["last"]))))
    out = held.withColumns({lines_: F.split("text", "\n"), lost_: lost})
    text = F.when(F.size(lost_) == 0, F.col("text")).otherwise(_let(F.map_from_arrays(F.col(lost_), F.col(lost_)), lambda m: F.array_join(F.filter(lines_, lambda x, i: ~F.map_contains_key(m, i + 1)), "\n")))
    n_lines = F.when(F.col(lines_).isNull(), F.lit(0)).otherwise(F.size(lines_))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], n_lines.alias(counts[0]), F.size(lost_).alias(counts[1]))
