"""Validation as tables: each check gives rows of (rule, column, n_bad) or the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowforge.functions.arrays import not_finite


def checks(df: DataFrame, rules: dict[tuple[str, str], Column]) -> DataFrame:
    """(rule, column, n_bad) of all rules in one pass; a rule is a condition that bad rows meet."""
    found = df.agg(*(F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(rules.values())))
    rows = F.array(
        *(F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.col(f"r{i}").alias("n_bad")) for i, (rule, column) in enumerate(rules))
    )
    return found.select(F.inline(rows))


def first_violation(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row breaks, null for none."""
    return reduce(lambda chain, item: chain.when(item[1], F.lit(item[0])), list(rules.items())[1:], F.when(next(iter(rules.values())), F.lit(next(iter(rules)))))


def vector_rules(column: str, size: int, low: float | None = None, high: float | None = None) -> dict[tuple[str, str], Column]:
    """Shape, nulls, finite and, with bounds, range."""
    v = F.col(column)
    rules = {
        ("size", column): v.isNull() | (F.size(v) != size),
        ("null", column): v.isNull() | F.exists(v, lambda x: x.isNull()),
        ("finite", column): F.exists(v, lambda x: x.isNotNull() & (F.isnan(x) | (F.abs(x) == float("inf")))),
    }
    if low is not None:
        rules["range", column] = F.exists(v, lambda x: (x < low) | (x > high))
    return rules


def schema_table(schema: T.StructType) -> list[tuple[str, str, str]]:
    return [(f.name, f.dataType.simpleString(), str(sorted(f.metadata.items()))) for f in schema]


def schema_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, difference): fields on one side only, of other type or other metadata."""
    spark = left.sparkSession
    kind = "name string, type string, meta string"
    a, b = (spark.createDataFrame(schema_table(x.schema), kind).alias(n) for x, n in ((left, "a"), (right, "b")))
    what = (
        F.when(F.col("b.name").isNull(), "only left").when(F.col("a.name").isNull(), "only right")
        .when(F.col("a.type") != F.col("b.type"), F.concat_ws(" ", F.lit("type"), "a.type", F.lit("is"), "b.type"))
        .when(F.col("a.meta") != F.col("b.meta"), "metadata")
    )
    return a.join(b, F.col("a.name") == F.col("b.name"), "full").select(F.coalesce("a.name", "b.name").alias("name"), what.alias("difference")).where(
        "difference is not null"
    )


def table_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, difference, left_values, right_values): schema differences, each with how many values (not null) either side has there."""

    def values(df: DataFrame, name: str) -> DataFrame:
        counts = F.array(*(F.struct(F.lit(c).alias("name"), F.count(F.col(f"`{c}`")).alias(name)) for c in df.columns))
        return df.agg(counts.alias("a")).select(F.inline("a"))

    found = schema_differences(left, right).join(values(left, "left_values"), "name", "left").join(values(right, "right_values"), "name", "left")
    return found.select("name", "difference", "left_values", "right_values")


def verdict(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """One row: BLOCK if any finding blocks, else WARN if any warns, else CLEAN."""
    rank = F.max(F.when(F.col(severity) == "BLOCK", 2).when(F.col(severity) == "WARN", 1).otherwise(0))
    return findings.agg(F.when(rank == 2, "BLOCK").when(rank == 1, "WARN").otherwise("CLEAN").alias("verdict"), F.count("*").alias("n_findings"))


def field_at(schema: T.StructType, path: str) -> T.StructField:
    """The field at a dotted path; KeyError names the part that isn't there."""
    field, here = None, schema
    for part in path.split("."):
        if not isinstance(here, T.StructType) or part not in here.names:
            raise KeyError(f"{part} of {path}")
        field = here[part]
        here = field.dataType
    return field


def flattened(df: DataFrame) -> DataFrame:
    """Struct columns as columns with dotted names, at any depth."""

    def walk(schema: T.StructType, prefix: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema:
            path = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, path)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)))
        return out

    return df.select(*walk(df.schema, ()))


def refuse_existing(df: DataFrame, new: list[str]) -> None:
    there = sorted(set(df.columns) & set(new))
    if there:
        raise ValueError(f"columns are there already: {', '.join(there)}")


def finite_or_null(x: Column) -> Column:
    return F.when(~not_finite(x), x)


def mismatches(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, field, found, expected) for every field of `expected` that `found` has too and that differs."""
    fields = [c for c in expected.columns if c != key and c in found.columns]
    long = lambda df, name: df.select(key, F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in fields))))
    return long(found, "found").join(long(expected, "expected"), [key, "field"]).where(~F.col("found").eqNullSafe(F.col("expected")))
