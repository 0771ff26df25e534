"""Packing by power-of-two decomposition.

A document's token ids, with an end token, are cut into pieces of ``longest``
ids and then of the powers of two that sum to the rest; each piece is a sequence of
its own, of its bucket's length, so no sequence crosses documents or has padding.

Ids are those of the ``tokenizers`` file, whose added tokens (``<|endoftext|>``) are matched in
texts; the same vocabulary as ranks gives equal ids several times faster.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

LONGEST = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
RESULT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"
ROWS = 256


@functools.cache
def encoder(path: str | None = None, vocabulary: str | None = None):
    """The byte-level BPE; path: of its ranks, vocabulary: of the ``tokenizers`` file that names the added tokens."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str | None, ranks: str | None = None, vocabulary: str | None = None) -> np.ndarray:
    """What the ``tokenizers`` file gives for a text with add_special_tokens=False; a null text has none."""
    return encoder(ranks, vocabulary).encode_to_numpy(text or "", allowed_special="all")


def piece_lengths(total: int, longest: int = LONGEST) -> list[int]:
    """Lengths, longest first, of the pieces of so many ids; longest is a power of two."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, longest: int = LONGEST, end_id: int = END_ID, ranks: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: its ids (little-endian unsigned 32-bit), place in the document, sequence and bucket.

    A null text is empty: its document is the end token alone.  Repeated rows
    are packed again, with sequences of their own; other columns are not read.
    Sequence ids are unique, and the same whenever a lost partition is run again.
    """

    def each(batches):
        task, number = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = []
                for doc_id, text in zip(batch.column(0).slice(at, ROWS).to_pylist(), batch.column(1).slice(at, ROWS).to_pylist(), strict=True):
                    ids = np.append(token_ids(text, ranks, vocabulary), np.uint32(end_id)).astype("<u4")
                    start = 0
                    for n in piece_lengths(len(ids), longest):
                        rows.append((doc_id, start, n, ids[start : start + n].tobytes(), len(ids), task + number, 0, n.bit_length() - 1))
                        start += n
                        number += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32()], strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(each, RESULT)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Files of sequences of equal length, a folder for each bucket."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)
