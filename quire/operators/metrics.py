"""Recognition metrics: CER, WER and chrF of lines, groups and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import edits
from quire.functions.edits import ORDERS
from quire.operators.order import numbered


def with_edits(lines: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """c_edits, c_len, w_edits, w_len of every row; an empty reference has length 1."""
    r, h = F.col(ref), F.col(hyp)
    return lines.withColumns({"c_edits": edits.char_edits(r, h), "c_len": edits.char_length(r), "w_edits": edits.word_edits(r, h), "w_len": edits.word_length(r)})


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    return F.when((p == 0) & (r == 0), 0.0).otherwise(safe_ratio((1 + beta * beta) * p * r, beta * beta * p + r))


def gram_sums(column: str = "grams", orders: int = ORDERS) -> list[Column]:
    """Sums, over rows, of every entry of ``edits.gram_counts``."""
    return [F.sum(F.col(column)[i]).alias(f"_g{i}") for i in range(3 * orders)]


def chrf(orders: int = ORDERS, beta: float = 2.0) -> Column:
    """F of every order from sums _g0.., averaged; an order without a match counts as 0."""
    per = [f_beta(safe_ratio(F.col(f"_g{3 * n}"), F.col(f"_g{3 * n + 2}")), safe_ratio(F.col(f"_g{3 * n}"), F.col(f"_g{3 * n + 1}")), beta) for n in range(orders)]
    return sum(per[1:], per[0]) / orders


def chrf_effective(orders: int = ORDERS, beta: float = 2.0, scale: float = 100.0) -> Column:
    """Precision and recall averaged over the orders that both sides have, then one F."""
    used = [(F.col(f"_g{3 * n + 1}") > 0) & (F.col(f"_g{3 * n + 2}") > 0) for n in range(orders)]
    count = sum((u.cast("int") for u in used[1:]), used[0].cast("int"))

    def mean(column: int) -> Column:
        parts = [F.when(u, safe_ratio(F.col(f"_g{3 * n}"), F.col(f"_g{3 * n + column}"))).otherwise(0.0) for n, u in enumerate(used)]
        return safe_ratio(sum(parts[1:], parts[0]), count)

    return scale * f_beta(mean(2), mean(1), beta)


def edit_sums() -> list[Column]:
    """num_samples and the sums of ``with_edits``."""
    return [F.count("*").alias("num_samples")] + [F.sum(c).cast("long").alias(n) for c, n in (("c_edits", "cer_edits"), ("c_len", "cer_chars"), ("w_edits", "wer_edits"), ("w_len", "wer_words"))]


def rates(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Micro-averaged CER and WER, with their sums, by key; no keys: overall."""
    out = counted.groupBy(*keys).agg(*edit_sums())
    return out.select(*keys, "num_samples", safe_ratio(F.col("cer_edits"), F.col("cer_chars")).alias("cer"), safe_ratio(F.col("wer_edits"), F.col("wer_words")).alias("wer"), "cer_edits", "cer_chars", "wer_edits", "wer_words")


def list_rate(lines: DataFrame, ref: str = "ref", hyp: str = "hyp", total: str | None = None) -> DataFrame:
    """edits, chars, cer of a list of texts, and optionally how many there are; lengths as they are, so that empty references add nothing."""
    count = [F.count("*").alias(total)] if total else []
    out = lines.agg(*count, F.coalesce(F.sum(edits.char_edits(F.col(ref), F.col(hyp))), F.lit(0)).cast("long").alias("edits"), F.coalesce(F.sum(F.length(ref)), F.lit(0)).cast("long").alias("chars"))
    return out.withColumn("cer", safe_ratio(F.col("edits"), F.col("chars")))


def joined(lines: DataFrame, keys: list[str], order: list[Column], size: int, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """ref and hyp of ``size`` lines each, joined by newlines, in the given order within the keys."""
    placed = numbered(lines, keys, order, "_at")
    rows = F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col(ref).alias("ref"), F.col(hyp).alias("hyp"))))
    pages = placed.groupBy(*keys, F.floor((F.col("_at") - 1) / size).alias("page")).agg(rows.alias("x"))
    return pages.select(*keys, "page", F.array_join("x.ref", "\n").alias("ref"), F.array_join("x.hyp", "\n").alias("hyp"))


def corpus_chrf(lines: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """chrF of a corpus, by key: n-grams are summed over all rows first."""
    counted = lines.select(*keys, edits.gram_counts(F.col(ref), F.col(hyp)).alias("grams"))
    return counted.groupBy(*keys).agg(*gram_sums()).select(*keys, chrf().alias("chrf"))


def sentence_chrf(lines: DataFrame, keep: list[str], ref: str = "ref", hyp: str = "hyp", beta: float = 3.0) -> DataFrame:
    """chrF of each row alone, white space ignored."""
    counted = lines.select(*keep, edits.gram_counts(F.col(ref), F.col(hyp), spaces=False).alias("grams"))
    return counted.select(*keep, *[F.col("grams")[i].alias(f"_g{i}") for i in range(3 * ORDERS)]).select(*keep, chrf_effective(beta=beta, scale=1.0).alias("chrf"))
