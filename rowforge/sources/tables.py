"""Reading and writing tables: discovery, projections, staged and split writes, reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """A new folder for results: under spark.checkpoint.dir, which driver and executors share. Unset, it's a temporary one on a local master and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Written once to a new folder and read again, for what several jobs need."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_table(spark: SparkSession, uri: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table at a path or URI; Hadoop's file systems resolve the scheme."""
    return spark.read.format(fmt).options(**options).load(uri)


def column(spark: SparkSession, uri: str, name: str) -> DataFrame:
    """One column, and only its bytes are read."""
    return open_table(spark, uri).select(name)


def fields(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Struct fields under new names, without their siblings."""
    return df.select(*(F.col(path).alias(name) for name, path in aliases.items()))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length) of all files below a folder, by path; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "modificationTime", "length").orderBy("path")


def shards(spark: SparkSession, folder: str, *, first: int | None = None, last: int | None = None) -> DataFrame:
    """(shard, path) of files named shard-N in number order, optionally a range of numbers."""
    number = F.regexp_extract("path", r"shard[-=](\d+)", 1).try_cast("long")
    found = listing(spark, folder).select(number.alias("shard"), "path").where("shard is not null")
    if first is not None:
        found = found.where(F.col("shard") >= first)
    if last is not None:
        found = found.where(F.col("shard") <= last)
    return found.orderBy("shard", "path")


def with_debug(df: DataFrame, schema: T.StructType, debug: str = "debug") -> DataFrame:
    """Columns of the schema in its order and types; a missing debug column is an empty object."""
    if debug in schema.names and debug not in df.columns:
        df = df.withColumn(debug, F.lit("{}"))
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def overwrite(df: DataFrame, path: str, *, rows_per_file: int = 0) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def publish_shards(df: DataFrame, path: str, shard: str, *, pieces: int = 1) -> None:
    """Replace the folders of the shards that df has; others stay. Tasks write to a staging folder and the job's commit moves whole folders into place.

    A shard that is too large for one task is written by as many as `pieces`, dealt by a hash of its rows.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(pieces))
    df.repartition(shard, salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)


def publish_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Replace only the splits that df has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(split).parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a writer finished here: Spark's _SUCCESS marker is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def checked_stats(stats: DataFrame) -> DataFrame:
    """Statistics whose std is finite and positive; one that isn't is an error when rows are read."""
    bad = F.col("std").isNull() | F.isnan("std") | (F.col("std") <= 0) | (F.col("std") == float("inf"))
    return stats.withColumn("std", F.when(bad, F.raise_error(F.lit("std must be finite and positive")).cast("double")).otherwise(F.col("std")))


def metric_scalars(aggregated: DataFrame) -> DataFrame:
    """(name, value): <metric>_<stat> of (metric, mean, std); a missing column is an error."""
    lost = {"metric", "mean", "std"} - set(aggregated.columns)
    if lost:
        raise ValueError(f"columns are missing: {', '.join(sorted(lost))}")
    long = aggregated.unpivot(["metric"], ["mean", "std"], "stat", "value")
    return long.select(F.concat_ws("_", "metric", "stat").alias("name"), "value")


def json_object(pairs: DataFrame, name: str, value: str) -> DataFrame:
    """One row with a JSON object of all pairs, by name. For summaries: as many pairs as there are metrics."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value))))
    return pairs.agg(F.to_json(entries).alias("json"))


def audit_card(winners: DataFrame, run_id: str) -> DataFrame:
    """One row: JSON with the run and the attempt chosen for each shard (as many as there are shards)."""
    chosen = F.array_sort(F.collect_list(F.struct("shard", "attempt")))
    return winners.agg(F.to_json(F.struct(F.lit(run_id).alias("run"), F.count("*").alias("shards"), chosen.alias("selected"))).alias("card"))


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a row of a Markdown table for each row, behind the heading."""
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "n int, line string")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns)), F.lit(" |"))
    return head.unionByName(df.select(F.lit(2).alias("n"), cells.alias("line"))).orderBy("n", "line").select("line")
