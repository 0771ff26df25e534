"""URL filters: glob rules run as one bit-parallel automaton over canonical URLs.

Every rule is a row of pattern positions; all rules' positions are packed into
64-bit words, so one shift, two masks and a carry advance all patterns by one
byte (Shift-And with self-loops for ``*``).  URLs of a batch advance together.

Glob syntax: ``*`` is any run without ``/``, ``**`` any run, ``?`` one byte
other than ``/``; A rule ``host/path`` means that host with all its subdomains
and every path that begins so.  A null url, or one without ``://``, has an empty host and path.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: (verdict, rule)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
RESULT = "page_id long, host string, path string, rule string, verdict string"
ROWS = 4096
#: texts that are left of a batch before each goes on alone
FEW = 4


def canonical(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path of a url."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    tail = rest[end:]
    return host, tail[: min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))]


def rule_glob(rule: str) -> str:
    """Glob over ``.host/path`` of a rule that holds for subdomains and longer paths too."""
    escape = lambda s: "".join(f"\\{c}" if c in "*?\\" else c for c in s)
    host, slash, path = rule.partition("/")
    return f"*.{escape(host)}{escape(slash + path)}**"


class Automaton:
    """Packed masks of the patterns; ``first`` gives, for each text, the first pattern that fits."""

    def __init__(self, globs: Sequence[str]):
        every, loops, finals, starts = [], [], [], []
        word = np.ones(256, dtype=bool)
        word[ord("/")] = False
        for glob in globs:
            starts.append(len(every))
            every.append(np.zeros(256, dtype=bool))
            loops.append(np.zeros(256, dtype=bool))
            data, i = glob.encode("utf-8"), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    loops[-1][:] = True
                    i += 2
                elif data[i : i + 1] == b"*":
                    loops[-1] |= word
                    i += 1
                else:
                    step = np.zeros(256, dtype=bool)
                    if data[i : i + 1] == b"?":
                        step |= word
                    else:
                        i += data[i : i + 1] == b"\\" and i + 1 < len(data)
                        step[data[i]] = True
                    i += 1
                    every.append(step)
                    loops.append(np.zeros(256, dtype=bool))
            finals.append(len(every) - 1)
        self.words = max(1, -(-len(every) // 64))
        self.step, self.loop = self._packed(every), self._packed(loops)
        self.integers = [[int.from_bytes(row.astype("<u8").tobytes(), "little") for row in table] for table in (self.step, self.loop)]
        self.start = np.zeros(self.words, dtype=np.uint64)
        for p in starts:
            self.start[p // 64] |= np.uint64(1 << (p % 64))
        self.finals = finals

    def _packed(self, rows: list[np.ndarray]) -> np.ndarray:
        bits = np.zeros((256, self.words * 64), dtype=np.uint8)
        if rows:
            bits[:, : len(rows)] = np.stack(rows, axis=1)
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def states(self, texts: list[bytes]) -> np.ndarray:
        """Active positions of every text at its end."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
        out = np.tile(self.start, (len(texts), 1))
        data = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes[order])[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        one, top = np.uint64(1), np.uint64(63)
        for t, n in enumerate(live):
            if n <= FEW:  # the few longest go on alone, as integers
                for k in range(n):
                    out[k] = self._finished(out[k], texts[order[k]][t:])
                break
            byte, now = data[at[:n] + t], out[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            out[:n] = (moved & self.step[byte]) | (now & self.loop[byte])
        back = np.empty_like(out)
        back[order] = out
        return back

    def _finished(self, state: np.ndarray, rest: bytes) -> np.ndarray:
        """The state after the rest of one text."""
        step, loop = self.integers
        now, full = int.from_bytes(state.astype("<u8").tobytes(), "little"), (1 << 64 * self.words) - 1
        for b in rest:
            now = ((now << 1) & step[b]) | (now & loop[b])
        return np.frombuffer((now & full).to_bytes(8 * self.words, "little"), dtype="<u8")

    def first(self, texts: list[bytes]) -> np.ndarray:
        """Index of the first pattern that fits each text, or -1."""
        found = np.full(len(texts), -1, dtype=np.int64)
        if texts:
            states = self.states(texts)
            for i in range(len(self.finals) - 1, -1, -1):
                p = self.finals[i]
                found[(states[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1) == 1] = i
        return found


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, otherwise: str = "allow") -> DataFrame:
    """The longest rule that fits each row's url, and its verdict, or ``otherwise``.

    Repeated rows are judged alike and kept; of equally long rules the earlier wins.
    """
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    automaton = Automaton([rule_glob(r) for _, r in ranked])
    names = [*(r for _, r in ranked), None]
    says = [*(v for v, _ in ranked), otherwise]

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                split = [canonical(u) for u in part.column(1).to_pylist()]
                best = automaton.first([f".{h}{p}".encode("utf-8", "surrogatepass") for h, p in split])
                out = [part.column(0), pa.array([h for h, _ in split]), pa.array([p for _, p in split]), pa.array([names[i] for i in best], type=pa.string()), pa.array([says[i] for i in best])]
                yield pa.RecordBatch.from_arrays(out, names=["page_id", "host", "path", "rule", "verdict"])

    return pages.selectExpr("cast(page_id as bigint) page_id", "url").mapInArrow(each, RESULT)
