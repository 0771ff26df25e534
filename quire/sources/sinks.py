"""Writers of recognition datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.sources.staging import staged

#: a header, doubled quotes, white space and empty strings as they are
CSV = {"header": "true", "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """Header, fixed fields, doubled quotes."""
    df.select(*(fields or df.columns)).write.mode("overwrite").options(**CSV).csv(path)


def write_by_source(df: DataFrame, path: str, key: str = "source_id") -> None:
    """A folder of CSV files for each source, named so that any file system takes it."""
    df.withColumn("folder", text.file_safe(F.col(key))).write.mode("overwrite").options(**CSV).partitionBy("folder").csv(path)


def write_everywhere(df: DataFrame, paths: list[str]) -> None:
    """The same rows to several places, computed once."""
    held = staged(df)
    for path in paths:
        write_csv(held, path)


def write_manifests(df: DataFrame, path: str) -> None:
    """A manifest a split; the full one is the parent folder."""
    df.write.mode("overwrite").options(**CSV).partitionBy("split").csv(path)


def write_json(df: DataFrame, path: str, pretty: bool = True) -> None:
    """One JSON document a row, indented by 2 if pretty, other than ASCII characters kept; nothing is collected."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower()}).alias("value")).write.mode("overwrite").text(path)


def write_compiled(rows: DataFrame, files: DataFrame, path: str) -> None:
    """Images and texts for training as one Parquet table: image_path, ground_truth_text, content of the rows whose file (path, content) there is."""
    held = files.select(text.same_path(F.col("path")).alias("_at"), "content")
    met = rows.select("image_path", "ground_truth_text").join(held, text.same_path(F.col("image_path")) == F.col("_at"))
    met.drop("_at").write.mode("overwrite").parquet(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value a line: logs of missing files, lists of evaluation images."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def open_shared(path: str):
    """A stream to a new file of storage that executors share; a path without a scheme could be any machine's own disk."""
    from urllib.parse import quote

    from pyarrow import fs

    if "://" not in path:
        raise ValueError(f"{path} has no scheme, such as file:// or hdfs://")
    system, bare = fs.FileSystem.from_uri(quote(path, safe=":/@"))  # names may hold blanks and any other character
    system.create_dir(bare.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(bare)


def write_files(df: DataFrame, name: str, content: str, folder: str, opener: Callable = open_shared) -> DataFrame:
    """Each row's content as a file of its own, and the paths written.

    ``opener`` opens a path, below the URI ``folder``, for bytes; a file is written again if its task is.
    """

    def each(batches):
        import pandas as pd

        for pdf in batches:
            done = []
            for n, data in zip(pdf[name], pdf[content], strict=True):
                path = f"{folder.rstrip('/')}/{n}"
                with opener(path) as f:
                    f.write(data.encode("utf-8") if isinstance(data, str) else bytes(data))
                done.append((path,))
            yield pd.DataFrame(done, columns=["path"])

    return df.select(name, content).mapInPandas(each, "path string")


def sidecar_names(df: DataFrame) -> DataFrame:
    """Column stem: source, page and line, and the augmentation where there is one."""
    base = F.concat(F.col("source_id"), F.lit("_p"), F.col("page"), F.format_string("_l%03d", F.col("line").cast("int")))
    aug = F.coalesce(F.col("aug_id").cast("int"), F.lit(0)) if "aug_id" in df.columns else F.lit(0)
    return df.withColumn("stem", F.concat(base, F.when(aug > 0, F.format_string("_aug%02d", aug)).otherwise("")))


def backup_path(spark: SparkSession, path: str) -> str:
    """Where a backup of path goes, by the time of now."""
    now = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
    return f"{path.rstrip('/')}_backup_{now}"


def backup(spark: SparkSession, path: str) -> str | None:
    """Copies what stands at path to ``backup_path``, which is returned; None where there is nothing."""
    jvm, conf, to = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), backup_path(spark, path)
    held, copy = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    system = held.getFileSystem(conf)
    if not system.exists(held):
        return None
    jvm.org.apache.hadoop.fs.FileUtil.copy(system, held, copy.getFileSystem(conf), copy, False, conf)
    return to
