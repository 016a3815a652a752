"""Encoding rows by a parameter-spec table: typed parameters, each with a span of the encoded vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.functions import scalars as S

SPEC = "pos int, name string, kind string, low double, high double, choices array<string>"


def with_spans(spec: DataFrame) -> DataFrame:
    """Adds width (choices for a category, else 1) and offset (the running sum of widths before) to a spec table.

    A spec has a row for each parameter of one row, tens to hundreds; it isn't data that grows.
    """
    width = F.when(F.col("kind") == "category", F.size("choices")).otherwise(1)
    before = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return spec.withColumn("width", width).withColumn("offset", F.coalesce(F.sum("width").over(before), F.lit(0)).cast("int"))


def encoded_parts(long: DataFrame, spec: DataFrame) -> DataFrame:
    """(id, pos, part) from (id, name, value string): part is the parameter's span, in [0, 1]."""
    rows = long.join(F.broadcast(with_spans(spec)), "name")
    number = F.col("value").try_cast("double")
    one = F.array(S.scaled(number, F.col("low"), F.col("high")))
    hot = F.transform("choices", lambda c: (c == F.col("value")).cast("double"))
    return rows.select("id", "pos", F.when(F.col("kind") == "category", hot).otherwise(one).alias("part"))


def encode(long: DataFrame, spec: DataFrame) -> DataFrame:
    """(id, encoded): spans behind one another in the order of the spec."""
    parts = encoded_parts(long, spec).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"))
    return parts.select("id", F.flatten(F.transform("p", lambda x: x["part"])).alias("encoded"))


def decode(encoded: DataFrame, spec: DataFrame) -> DataFrame:
    """(id, name, value string) from (id, encoded): numbers back to their range, integers cut to whole ones, categories by the largest component."""
    rows = encoded.join(F.broadcast(with_spans(spec)))
    part = F.slice("encoded", F.col("offset") + 1, F.col("width"))
    number = S.unscaled(F.element_at("encoded", F.col("offset") + 1), F.col("low"), F.col("high"))
    value = (
        F.when(F.col("kind") == "category", F.get("choices", S.arg_max(part).cast("int")))
        .when(F.col("kind") == "int", F.floor(number + 1e-9).cast("long").cast("string"))
        .otherwise(F.round(number, 6).cast("string"))
    )
    return rows.select("id", "name", value.alias("value"))


def weighted_choice(u: Column, names: list[str], weights: list[float]) -> Column:
    """A name by a number in [0, 1), each with its share of the weights."""
    total, at, out = sum(weights), 0.0, None
    for n, w in list(zip(names, weights, strict=True))[:-1]:
        at += w / total
        out = F.when(u < at, n) if out is None else out.when(u < at, n)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def point_mass(u0: Column, u1: Column, low: float, high: float, p: float, constant: float) -> Column:
    """`constant` with probability p, else even between low and high."""
    return F.when(u0 < p, F.lit(constant)).otherwise(low + u1 * (high - low))
