"""Materialised subsets in folders named by a digest of the request, used again only when their manifest matches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.functions.scalars import request_digest
from rowforge.sources.tables import is_complete, listing


class SnapshotMismatch(ValueError):
    """A folder is there, but not with the rows that are asked for; or a source isn't at the version that it is pinned to."""


def live_version(spark: SparkSession, source: str) -> str:
    """What a table is now, by the paths, lengths and times of its files. Contents aren't read; a file more, less or written again is another version."""
    return _digest_of_files(spark, source, F.col("path"), F.col("length"), F.col("modificationTime"))


def _digest_of_files(spark: SparkSession, folder: str, *columns: Column) -> str:
    prefix = len(_qualified(spark, folder)) + 1
    files = listing(spark, folder).withColumn("path", F.expr(f"substr(path, {prefix})")).where(~F.col("path").rlike("/[_.][^/]*$"))
    one = F.struct(*columns)
    found = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.bit_xor(F.xxhash64(one)).alias("x"), F.bit_xor(F.xxhash64(one, F.lit(1))).alias("y"))
    return request_digest({k: str(v) for k, v in found.first().asDict().items()})


def snapshot(
    spark: SparkSession, source: str, root: str, *, columns: list[str], order: list[str], limit: int | None = None, pin: str | None = None, name: str | None = None
) -> tuple[str, bool]:
    """Write the subset unless it's there; return its folder and whether it was.

    A request is source, version, columns, order and limit. Without a pin the version is the
    live one (`live_version`), so that a source that has changed never gives rows of before: its
    request is another one and gets a folder of its own. With a pin, a folder that is there is
    used without a look at the source; it is made only while the source has that version.

    The folder's name comes from the request, or is `name`. A folder without manifest or
    completion marker, with the manifest of another request (the one of an older version, say)
    or with other rows than were put there is an error, never rewritten. Rows and manifest are
    staged and renamed together, so a writer that dies leaves nothing under the folder's name; of
    two writers the later one uses what the first put there.
    """
    version = pin or live_version(spark, source)
    request = {"source": source, "version": version, "columns": columns, "order": order, "limit": limit}
    digest = request_digest(request)
    path = f"{root}/{name or digest[:16]}"
    if not _exists(spark, path):
        if pin and (live := live_version(spark, source)) != pin:
            raise SnapshotMismatch(f"{source} is at version {live[:16]}, not at {pin[:16]}")
        df = spark.read.parquet(source).select(*columns)
        if limit is not None:
            df = df.orderBy(*order).limit(limit)
        staged = f"{root}/_staged-{uuid.uuid4().hex}"
        df.write.parquet(f"{staged}/rows")
        if not pin and live_version(spark, source) != version:
            raise SnapshotMismatch(f"{source} has changed while it was read")
        manifest = (digest, source, version, _written(spark, staged))
        spark.createDataFrame([manifest], "digest string, source string, version string, written string").write.parquet(f"{staged}/manifest")
        if renamed(spark, staged, path):
            return path, False
    if _exists(spark, path):
        if not is_complete(spark, f"{path}/manifest") or not is_complete(spark, f"{path}/rows"):
            raise SnapshotMismatch(f"{path} isn't whole")
        stored = spark.read.parquet(f"{path}/manifest").first()
        if stored["digest"] != digest:
            raise SnapshotMismatch(f"{path} holds {stored['source']} at version {stored['version'][:16]}, or other columns or rows of it")
        if stored["written"] != _written(spark, path):
            raise SnapshotMismatch(f"{path} has other files than were put there")
        return path, True
    raise SnapshotMismatch(f"{path} couldn't be put in place")


def _written(spark: SparkSession, path: str) -> str:
    """What is in a snapshot's rows, whatever the folder is called."""
    return _digest_of_files(spark, f"{path}/rows", F.col("path"), F.col("length"))


def materialise_splits(
    spark: SparkSession, sources: dict[str, str], root: str, projections: dict[str, list[str]], order: list[str], limit: int | None = None, pins: dict[str, str] | None = None
) -> dict[str, str]:
    """A snapshot of every split with its own columns, of the pinned version where there is one; a source that no writer has finished is an error."""
    out = {}
    for split, source in sources.items():
        if not is_complete(spark, source):
            raise SnapshotMismatch(f"{source} has no completion marker")
        out[split], _ = snapshot(spark, source, root, columns=projections[split], order=order, limit=limit, pin=(pins or {}).get(split))
    return out


def rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def with_request(df: DataFrame, **request: str) -> DataFrame:
    """Adds the digest of a request, so that rows tell what made them."""
    return df.withColumn("request", F.lit(request_digest(request)))


def _qualified(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Whether `old` now has the name `new`, which nothing may have had."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    done = not fs.exists(b) and fs.rename(a, b)
    if not done:
        fs.delete(a, True)
    return done
