"""Conversation structure repair by a rank-compressed dynamic program.

A conversation is legal if the initials of its roles give ``(s?(ua)+)?``.  Turns are kept, given another role, deleted, or
preceded by inserted ones, at least cost; among the cheapest the audit string, the initials of all edits in order, is the least.

An insert run and the edit of the turn behind it are one macro edit, written ``I..IK``, ``I..IR`` or ``I..ID``.  These codes are free of
prefixes, so audit strings of equally many macros compare macro by macro.  The program is therefore layered by turns and keeps, for each of four
states, the cost, the rank of its string in the layer, and a pointer to the parent, instead of strings.  Strings are read off the
pointers afterwards.

Turns are range-partitioned by conversation and turn and numbered there; a block is a conversation's turns among ``BLOCK`` such numbers.  A block is a
table of cost and rank from each state before it to each behind it, and these tables chain like macros do, so a long conversation is spread
over tasks; one task holds a conversation's tables, one for each block.  Only its digest needs all its texts in order, and reads them one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.storage import written

#: log2 of the turns of a block, at most
BLOCK = 12
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: white space
SPACE = "\t\n\x0b\x0c\r "
#: states: nothing yet, after a system turn, after a user's, after an assistant's
START, SYSTEM, USER, ASSISTANT = range(4)
#: where a turn of that initial leads
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: who speaks when a turn is inserted or gets another role
NEXT = ("user", "user", "assistant", "user")
#: codes of macro edits in their order
CODES = sorted("I" * k + x for k in range(3) for x in "KRD")
#: inserts that end a conversation legally
TAILS = (0, 2, 1, 0)


def _after(state: int, run: int) -> int:
    for _ in range(run):
        state = STEPS[state][NEXT[state][0]]
    return state


def _macros(initial: str, truncated: bool, must: bool) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, code) of the best macro between two states for a turn of that kind."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state in range(4):
        for run in range(3):
            mid, extra = _after(state, run), TRUNCATED * truncated
            edits = [("D", mid, DELETE)]
            if not must:
                edits.append(("R", STEPS[mid][NEXT[mid][0]], RETYPE + extra))
                if initial in STEPS[mid]:
                    edits.append(("K", STEPS[mid][initial], extra))
            for x, to, cost in edits:
                found = (INSERT * run + cost, CODES.index("I" * run + x))
                best[state, to] = min(best.get((state, to), found), found)
    return [(s, t, cost, code) for (s, t), (cost, code) in best.items()]


#: by initial (others: empty), whether it is truncated, whether it must go
MACROS = {(i, t, m): _macros(i, t, m) for i in ("", "s", "u", "a") for t in (False, True) for m in (False, True)}


def _layer(before: dict, steps: list) -> dict:
    """Of each state behind the steps: (cost, rank, parent, code).  before: state: (cost, rank, ...); steps: (from, to, cost, code).

    Equal strings have equal ranks.
    """
    best: dict[int, tuple] = {}
    for s, t, cost, code in steps:
        if s in before:
            found = (before[s][0] + cost, before[s][1], code, s)
            if t not in best or found < best[t]:
                best[t] = found
    ranks = {x: k for k, x in enumerate(sorted({b[1:3] for b in best.values()}))}
    return {t: (b[0], ranks[b[1:3]], b[3], b[2]) for t, b in best.items()}


def block_table(kinds: list[tuple[str, bool, bool]], entries=range(4)) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, rank) of the best way through a block from each entry; ranks are those of all its strings."""
    layer = {(e, e): (0, 0) for e in entries}
    for kind in kinds:
        best: dict[tuple[int, int], tuple] = {}
        for (e, s), (cost, rank) in layer.items():
            for f, t, more, code in MACROS[kind]:
                if f == s:
                    found = (cost + more, rank, code)
                    if (e, t) not in best or found < best[e, t]:
                        best[e, t] = found
        ranks = {x: k for k, x in enumerate(sorted({b[1:] for b in best.values()}))}
        layer = {k: (b[0], ranks[b[1:]]) for k, b in best.items()}
    return [(e, t, cost, rank) for (e, t), (cost, rank) in layer.items()]


def block_edits(kinds: list[tuple[str, bool, bool]], entry: int, leave: int) -> list[tuple[str, str, str | None]]:
    """(inserted initials, edit, role it gives) of each turn on the best way from entry to leave."""
    layers = [{entry: (0, 0)}]
    for kind in kinds:
        layers.append(_layer(layers[-1], MACROS[kind]))
    codes, state = [], leave
    for layer in reversed(layers[1:]):
        _, _, parent, code = layer[state]
        codes.append((parent, CODES[code]))
        state = parent
    out = []
    for state, code in reversed(codes):
        mid = _after(state, len(code) - 1)
        out.append((inserted(state, len(code) - 1), code[-1], NEXT[mid] if code[-1] == "R" else None))
    return out


def inserted(state: int, run: int) -> str:
    """Initials of the roles of an insert run."""
    return "".join(NEXT[_after(state, k)][0] for k in range(run))


def chained(tables: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], int]:
    """Least cost, entry and exit of each block, and the inserts behind the last."""
    layers: list[dict] = [{START: (0, 0)}]
    for steps in tables:
        layers.append(_layer(layers[-1], steps))
    cost, _, tail, state = min((c[0] + INSERT * TAILS[s], c[1], TAILS[s], s) for s, c in layers[-1].items())
    ways = []
    for layer in reversed(layers[1:]):
        ways.append((layer[state][2], state))
        state = layer[state][2]
    return cost, ways[::-1], tail


def _grouped(batches, keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, the other columns) of rows that stand together with equal first columns."""
    now, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != now:
                if held:
                    yield now, [*zip(*held, strict=True)]
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, [*zip(*held, strict=True)]


def _batches(rows, schema: pa.Schema, size: int = 4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _kinds(initial, truncated, must):
    return [(i if i in ("s", "u", "a") else "", t, m) for i, t, m in zip(initial, truncated, must, strict=True)]


LEGAL = ("su", "ua", "au")
_TABLE = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())])


def block_tables(turns: DataFrame, bits: int = BLOCK) -> DataFrame:
    """conv_id, block, table, first, last, illegal of each block; turns: what ``ordered`` returns."""
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("steps", pa.list_(_TABLE)), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())])

    def each(batches):
        def rows():
            for (conv, block), (_, initial, truncated, must) in _grouped(batches, 2):
                steps = [dict(zip(("from", "to", "cost", "rank"), x, strict=True)) for x in block_table(_kinds(initial, truncated, must))]
                yield conv, block, steps, initial[0], initial[-1], sum(a + b not in LEGAL for a, b in zip(initial, initial[1:], strict=False))

        yield from _batches(rows(), schema)

    kept = turns.select("conv_id", F.shiftright("at", bits).alias("block"), "at", "initial", "truncated", "must")
    dealt = kept.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    return dealt.mapInArrow(each, "conv_id long, block long, steps array<struct<from:int,to:int,cost:long,rank:int>>, first string, last string, illegal long")


def block_ways(tables: DataFrame) -> DataFrame:
    """conv_id, block, entry, exit of each block; in a conversation's last block also tail, and the cost and illegal pairs of all."""
    names = ("conv_id", "block", "entry", "exit", "tail", "cost", "illegal")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def each(batches):
        def rows():
            for (conv,), (block, steps, first, last, illegal) in _grouped(batches, 1):
                cost, ways, tail = chained([[(x["from"], x["to"], x["cost"], x["rank"]) for x in s] for s in steps])
                pairs = sum(illegal) + sum(a + b not in LEGAL for a, b in zip(last, first[1:], strict=False))
                for k, (entry, leave) in enumerate(ways):
                    end = k == len(ways) - 1
                    yield conv, block[k], entry, leave, tail if end else None, cost if end else None, pairs if end else None

        yield from _batches(rows(), schema)

    return tables.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(each, ", ".join(f"{n} long" for n in names))


def edits(turns: DataFrame, ways: DataFrame, bits: int = BLOCK) -> DataFrame:
    """conv_id, at, inserted, edit, to: what stands before each turn, what becomes of it, and the role it gets; behind the last turn edit is empty."""
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("inserted", pa.string()), ("edit", pa.string()), ("to", pa.string())])

    def each(batches):
        def rows():
            for (conv, _), (at, initial, truncated, must, entry, leave, tail) in _grouped(batches, 2):
                for k, (before, edit, to) in zip(at, block_edits(_kinds(initial, truncated, must), entry[0], leave[0]), strict=True):
                    yield conv, k, before, edit, to
                if tail[0]:
                    yield conv, at[-1] + 1, inserted(leave[0], tail[0]), "", None

        yield from _batches(rows(), schema)

    kept = turns.select("conv_id", F.shiftright("at", bits).alias("block"), "at", "initial", "truncated", "must")
    way = ways.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "entry", "exit", "tail")
    met = kept.join(way, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    dealt = met.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")
    return dealt.mapInArrow(each, "conv_id long, at long, inserted string, edit string, to string")


def digests(turns: DataFrame, changes: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of ``role:text`` of the repaired turns, joined by newlines; texts pass one at a time."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    both = changes.select("conv_id", "at", F.lit(0).alias("side"), "inserted", "edit", "to", none("role"), none("text"))
    both = both.unionByName(turns.select("conv_id", "at", F.lit(1).alias("side"), none("inserted"), none("edit"), none("to"), "role", "text"))
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def each(batches):
        def rows():
            now, audit, digest, said, edit, to = (), [], None, False, "", None

            def say(role, text=""):
                nonlocal said
                digest.update(f"{chr(10) if said else ''}{role}:{text}".encode())
                said = True

            for batch in batches:
                for conv, _, side, before, x, role_to, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (conv,) != now:
                        if now:
                            yield now[0], "".join(audit), digest.hexdigest()
                        now, audit, digest, said = (conv,), [], hashlib.sha256(), False
                    if side == 0:
                        edit, to = x, role_to
                        audit.append("I" * len(before) + edit)
                        for i in before:
                            say("user" if i == "u" else "assistant")
                    elif edit != "D":
                        say(to or role, text)
            if now:
                yield now[0], "".join(audit), digest.hexdigest()

        yield from _batches(rows(), schema)

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at", "side").mapInArrow(each, "conv_id long, audit string, repaired_sha256 string")


def repaired_turns(turns: DataFrame, changes: DataFrame) -> DataFrame:
    """conv_id, at, step, role, text, edit of the repaired conversations in the order of at and step; inserted turns have an empty text."""
    met = changes.join(turns.select(F.col("conv_id").alias("_c"), F.col("at").alias("_a"), "role", "text"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("at") == F.col("_a")), "left")
    new = F.transform(F.filter(F.split("inserted", ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    own = F.when(F.col("edit").isin("K", "R"), F.array(F.struct(F.coalesce("to", "role").alias("role"), "text", "edit"))).otherwise(F.array().cast("array<struct<role:string,text:string,edit:string>>"))
    return met.select("conv_id", "at", F.posexplode(F.concat(new, own)).alias("step", "x")).select("conv_id", "at", "step", "x.role", "x.text", "x.edit")


def ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, faults): conv_id, turn, at, role, text; and conv_id, turn, at, initial, fault, truncated, must.

    at numbers the turns; those of one conversation stand by turn (nulls first), role and text.  Null roles and texts are one space.
    fault is the first of blank, duplicate (role and text stood earlier) and truncated, or null.  Turns alike in all are dealt to several tasks as well.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_tie")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("_tie"))
    texts = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("at", F.monotonically_increasing_id()), "turns")
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    facts = texts.select("conv_id", "turn", "at", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"), said.alias("said"))
    firsts = facts.groupBy("conv_id", "said").agg(F.min("at").alias("_a")).select(F.col("conv_id").alias("_c"), "_a")
    known = facts.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("at") == F.col("_a")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("_a").isNull(), "duplicate").when(F.col("open"), "truncated")
    is_ = lambda *x: F.coalesce(F.col("fault").isin(*x), F.lit(False))
    marked = known.select("conv_id", "turn", "at", "initial", fault.alias("fault"))
    return texts, written(marked.select("*", is_("truncated").alias("truncated"), is_("blank", "duplicate").alias("must")), "faults")


def gaps(turns: DataFrame) -> DataFrame:
    """conv_id, gaps: turn numbers that are missing between a conversation's least and greatest; null turns do not count."""
    numbers = turns.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("n"))
    return numbers.select("conv_id", F.coalesce(F.expr("cast(cast(high as decimal(38,0)) - low + 1 - n as bigint)"), F.lit(0).cast("long")).alias("gaps"))


def repair(turns: DataFrame, bits: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, texts, changes).

    report has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation; the others are what
    ``repaired_turns`` reads.  Turns of a null conv_id are one conversation; a role of any other initial must change or go.
    Blank and duplicate turns must go; truncated ones cost more when they stay, and keep their text.
    """
    texts, faults = ordered(turns)
    ways = written(block_ways(written(block_tables(faults, bits), "tables")), "ways")
    changes = written(edits(faults, ways, bits), "edits")
    n = lambda x: F.count_if(F.col("fault") == x).alias(x)
    counts = faults.groupBy("conv_id").agg(n("blank"), n("duplicate"), n("truncated"))
    total = ways.where("cost is not null").select("conv_id", "illegal", "cost")
    out = counts
    for k, more in enumerate((gaps(faults), total, digests(texts, changes))):
        out = out.join(more.withColumnRenamed("conv_id", f"_c{k}"), F.col("conv_id").eqNullSafe(F.col(f"_c{k}")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), texts, changes


def damaged(turns: DataFrame, of: int = 20) -> DataFrame:
    """conv_id, turn, role, text with faults put in by the crc32 of ``conv_id:turn`` modulo ``of`` (nulls: one space).

    0 drops the turn, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    space = lambda c: F.coalesce(c, F.lit(" "))
    rows = turns.select("conv_id", "turn", space(F.col("role")).alias("role"), space(F.col("text")).alias("text"))
    kind = F.crc32(F.concat(space(F.col("conv_id").cast("string")), F.lit(":"), space(F.col("turn").cast("string"))).cast("binary")) % of
    held = rows.withColumn("_kind", kind).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return held.select("conv_id", "turn", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_x")).drop("_x")


def damaged_report(turns: DataFrame, bits: int = BLOCK) -> DataFrame:
    """The report on the damaged turns for every conversation that there was; zeros, an empty audit and the empty string's hash where no turn is left."""
    report, _, _ = repair(damaged(turns), bits)
    every = turns.select(F.col("conv_id").cast("long").alias("_all")).distinct()
    held = every.join(report, F.col("_all").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return held.select(F.col("_all").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
