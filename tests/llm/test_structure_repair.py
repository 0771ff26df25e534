import hashlib
import itertools
import random
import zlib

import pytest

from quire.llm import structure_repair as sr

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = ("su", "ua", "au")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def sorted_turns(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip("\t\n\x0b\x0c\r ")
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_strings(rows):
    """(cost, audit, repaired) with whole strings for each state, every insert run up to four."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    speaks = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def runs(state):
        said = []
        for k in range(5):
            yield k, state, list(said)
            said.append(f"{speaks[state]}:")
            state = step[state][speaks[state][0]]

    best = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for state, (cost, audit, said) in best.items():
            for k, mid, more in runs(state):
                options = [("D", mid, 4, [])]
                if fault not in ("b", "d"):
                    extra = 3 if fault == "t" else 0
                    options += [("R", step[mid][to[0]], 3 + extra, [f"{to}:{text}"]) for to in ("user", "assistant") if to[0] in step[mid]]
                    if role[:1] in step[mid]:
                        options.append(("K", step[mid][role[:1]], extra, [f"{role}:{text}"]))
                for x, to, price, line in options:
                    found = (cost + 3 * k + price, audit + "I" * k + x, said + more + line)
                    if to not in new or found[:2] < new[to][:2]:
                        new[to] = found
        best = new
    return min((cost + 3 * k, audit + "I" * k, said + more) for state, (cost, audit, said) in best.items() for k, end, more in runs(state) if end in ("", "a"))


def report(rows):
    """What the report says of each conversation."""
    out = {}
    every = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted_turns([r for r in every if r[0] == conv])
        found, turns, initials = faults(own), [r[1] for r in own if r[1] is not None], [r[2][:1] for r in own]
        cost, audit, said = by_strings(own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (conv, gaps, *(found.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def messy(seed=1, conversations=120):
    rng = random.Random(seed)
    texts = ["", " \n", None, "ok.", "ok", "Why?", "é!", "no", "a.b", "x. \t", "..", "long " * 50 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "USER", "ü"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(0, 14)):
            t = rng.choice([turn, turn, turn, None, 3, -turn])
            rows.append((conv, t, rng.choice(roles), rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows += [(None, k, r, t) for k, (r, t) in enumerate(itertools.product(roles[:3], texts[:6]))]
    rows += [(-5, 19, "user", "x"), (1 << 40, -(1 << 62), "system", "y."), (1 << 40, 1 << 61, "assistant", "y.")]
    return rows


@pytest.mark.parametrize("bits", [sr.BLOCK, 1, 0])
def test_against_whole_strings(spark, bits):
    """Blocks of 4,096, two turns and one turn."""
    rows = messy(bits)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "7 at", "7 block", "7 cost")
    got = {r.conv_id: tuple(r) for r in sr.damaged_report(df, bits).collect()}
    assert got == report(rows)


def test_repaired_turns_are_legal_and_have_the_digest(spark):
    rows = [r for r in messy(9) if r[0] is not None]
    out, texts, changes = sr.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), 2)
    lines = {}
    for r in sr.repaired_turns(texts, changes).orderBy("conv_id", "at", "step").collect():
        lines.setdefault(r.conv_id, []).append(r)
    report = out.collect()
    for r in report:
        own = lines.get(r.conv_id, [])
        initials = "".join(x.role[0] for x in own)
        assert not initials or initials.removeprefix("s") == "ua" * (len(initials) // 2)
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256
        assert "".join(x.edit for x in own) == r.audit.replace("D", "")
    assert len(report) == len({r[0] for r in rows})


def test_tables_of_blocks_chain_to_the_whole():
    """Any cut of a run of turns gives the cost and edits of the uncut run."""
    rng = random.Random(3)
    kinds = [*sr.MACROS]
    for _ in range(300):
        turns = [rng.choice(kinds) for _ in range(rng.randrange(1, 10))]
        want = sr.chained([sr.block_table(turns)])
        cut = sorted(rng.sample(range(1, len(turns)), rng.randrange(0, len(turns))))
        parts = [turns[a:b] for a, b in itertools.pairwise([0, *cut, len(turns)])]
        cost, ways, tail = sr.chained([sr.block_table(p) for p in parts])
        assert (cost, tail) == (want[0], want[2])
        whole = sr.block_edits(turns, *want[1][0])
        assert [e for p, w in zip(parts, ways, strict=True) for e in sr.block_edits(p, *w)] == whole


def test_long_conversation_and_empty_table(spark):
    """One conversation of most rows, many of them alike in all, over many blocks."""
    rows = [(1, k // 3, "user" if k % 2 else "assistant", f"t{k % 50}.") for k in range(3000)] + [(1, 5, "user", "same")] * 2000 + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    got = {r.conv_id: tuple(r) for r in sr.damaged_report(spark.createDataFrame(rows, SCHEMA).repartition(6), 4).collect()}
    assert got == report(rows)
    assert sr.damaged_report(spark.createDataFrame([], SCHEMA)).count() == 0
