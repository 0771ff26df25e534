"""Batched calls of an external model: fixed-size batches, validation, retries and a fall-back to the input."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.order import numbered

BATCH = 35


def batched(df: DataFrame, order: list[Column], size: int = BATCH) -> DataFrame:
    """Columns batch, from 0, and slot in the batch, from 1, in the given order."""
    placed = numbered(df, [], order, "_pos")
    return placed.withColumns({"batch": F.floor((F.col("_pos") - 1) / size).cast("long"), "slot": ((F.col("_pos") - 1) % size + 1).cast("int")}).drop("_pos")


#: fixed values: tries of a batch, seconds after an error, and after a refusal by rate, where they double from the first on top of the second
ATTEMPTS, WAIT, RATE_WAIT = 5, 5.0, (1.0, 10.0)


def refused(error: Exception) -> bool:
    """Is it an answer with status 429: too many requests?"""
    status = [getattr(error, a, None) for a in ("code", "status", "status_code")] + [getattr(getattr(error, "response", None), "status_code", None)]
    return 429 in status


def answered(given: list[str], call: Callable[[list[str]], list[str]], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """What call returns for a batch, or the batch where it fails or miscounts ``attempts`` times.

    A reply of a wrong length or kind is retried at once, a refusal by rate after longer and longer waits, any other error after ``WAIT`` seconds.
    """
    for k in range(attempts):
        try:
            got = call(given)
        except Exception as e:  # noqa: BLE001  any failure of the model is retried
            sleep(RATE_WAIT[0] * 2**k + RATE_WAIT[1] if refused(e) else WAIT)
            continue
        if isinstance(got, list) and len(got) == len(given):
            return got
    return given


def by_json(send: Callable[[str], str]) -> Callable[[list[str]], list[str]]:
    """A call that sends a batch as a JSON array of texts and reads one back; what is no JSON is an error."""

    def call(texts: list[str]) -> list[str]:
        return json.loads(send(json.dumps(texts, ensure_ascii=False)))

    return call


def corrected(batches: DataFrame, text: str, call: Callable[[list[str]], list[str]], attempts: int = ATTEMPTS, pace: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """df with column ``corrected``: the texts of every batch as ``answered``; ``pace``: seconds after each batch.

    Batches are dealt to tasks and sorted there, and called one after the other.  call is idempotent by batch; a lost task calls it again.
    """
    schema = T.StructType([*batches.schema.fields, T.StructField("corrected", T.StringType())])

    def each(pdfs):
        held = None

        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            out = pdf.assign(corrected=answered(pdf[text].fillna("").tolist(), call, attempts, sleep))
            if pace:
                sleep(pace)
            return out

        for pdf in pdfs:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            ends = np.flatnonzero(pdf["batch"].to_numpy()[1:] != pdf["batch"].to_numpy()[:-1]) + 1
            for lo, hi in zip([0, *ends], [*ends, 0], strict=True):
                if hi:
                    yield done(pdf.iloc[lo:hi])
            held = pdf.iloc[ends[-1] if len(ends) else 0 :]  # its batch may go on
        if held is not None and len(held):
            yield done(held)

    return batches.repartition("batch").sortWithinPartitions("batch", "slot").mapInPandas(each, schema)


def to_messages(batches: DataFrame, text: str) -> DataFrame:
    """batch, n, payload: a JSON array of the batch's texts in order."""
    rows = F.sort_array(F.collect_list(F.struct("slot", F.coalesce(text, F.lit("")).alias("t"))))
    return batches.groupBy("batch").agg(F.count("*").alias("n"), F.to_json(F.transform(rows, lambda r: r["t"])).alias("payload"))


def from_messages(replies: DataFrame) -> DataFrame:
    """batch, slot, text of replies whose length is n; others are left out, to fall back."""
    parsed = replies.withColumn("_texts", F.from_json("payload", "array<string>")).where(F.size("_texts") == F.col("n"))
    return parsed.select("batch", F.posexplode("_texts").alias("_at", "text")).select("batch", (F.col("_at") + 1).cast("int").alias("slot"), "text")
