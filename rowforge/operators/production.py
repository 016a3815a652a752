"""Production control: complete attempts, claims, leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete(listing: DataFrame, keys: list[str], marker: str, required: list[str], invalid: str, limit: int = 1) -> DataFrame:
    """(keys, markers) of the attempts that have every required marker and fewer than `limit` invalid ones."""
    have = F.sort_array(F.collect_set(marker))
    return (
        listing.groupBy(*keys).agg(have.alias("markers"), F.count_if(F.col(marker) == invalid).alias("__bad"))
        .where((F.col("__bad") < limit) & F.forall(F.array(*map(F.lit, required)), lambda m: F.array_contains("markers", m))).drop("__bad")
    )


def claimable(status: Column, expiry: Column, now: Column) -> Column:
    """Available, or claimed with a lease that ended before now."""
    return (status == "available") | ((status == "claimed") & (expiry < now))
