"""A training corpus from raw documents, in five stages of the operators in quire.llm.

Each stage reads what the one before it wrote.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import line_dedup, mixing, ngram_join, packing, toxicity
from quire.llm.storage import written


OWN = "__quire_"  # begins the names of helping columns, so that they clash with none of the documents'


def _all(docs: DataFrame, **changed):
    """The columns of docs, some of them replaced."""
    return [changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not predict as toxic."""
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_documents(docs, model, keep=tuple(docs.columns), names=(f"{OWN}id", f"{OWN}score", f"{OWN}toxic"))
    return scored.where(F.col(f"{OWN}toxic") == 0).select(*_all(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a document that loses all its lines goes."""
    had, lost = f"{OWN}had", f"{OWN}lost_lines"
    cleaned = line_dedup.dedup_lines(docs, counts=(had, lost))
    kept = cleaned.where((F.col(lost) == 0) | (F.col(lost) < F.col(had)))
    return kept.select(*_all(docs, n_chars=F.when(F.col(lost) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; of rows alike in doc_id and text one stays."""
    found = ngram_join.join_components(docs)
    id_, n = f"{OWN}id", f"{OWN}rows"
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias(n))
    kept = docs.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    return kept.where(F.col(n) == 1).unionByName(kept.where(F.col(n) > 1).dropDuplicates(["doc_id", "text"])).select(*_all(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that crosses its source's target gives its first words last.

    Rows alike in doc_id and text share what the mix takes of them evenly.
    """
    weights = mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    key, id_, of, size, taken, copy = (f"{OWN}{x}" for x in ("key", "id", "of", "size", "taken", "copy"))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    mixed = mixing.mix(keyed, weights, keep=(key,)).select(F.col("doc_id").alias(id_), F.col(key).alias(of), F.col("size").alias(size), F.col("taken").alias(taken))
    each = mixed.groupBy(id_, of, size).agg(F.expr(f"sum({taken}) div count(*)").alias(taken)).where(F.col(taken) > 0)
    held = keyed.join(each, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.col(key).eqNullSafe(F.col(of)))
    held = held.withColumn(copy, F.explode(F.sequence(F.lit(0), F.expr(f"({taken} + {size} - 1) div {size} - 1"))))
    left = F.col(taken) - F.col(copy) * F.col(size)
    text = F.when(left >= F.col(size), F.col("text")).otherwise(mixing.first_words(F.col("text"), left))
    return held.select(*_all(docs, text=text, n_chars=F.when(left >= F.col(size), F.col("n_chars")).otherwise(F.length(text).cast("long"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, each a piece of one document of a power of two in length."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents in sf_dir; what each stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has neither zstandard nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None
