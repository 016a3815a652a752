"""Derived columns: a registry, what is missing, and adding several in one pass."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from rowforge.functions import arrays as A
from rowforge.operators.validation import refuse_existing

IDENTITY = "made_by"


@dataclass(frozen=True)
class Derived:
    """A column that others give. `identity` names the artifact and version that makes it."""

    name: str
    inputs: tuple[str, ...]
    identity: str
    build: Callable[..., Column]


REGISTRY = {
    "l2": Derived("l2", ("v",), "l2/1", A.norm),
    "avg": Derived("avg", ("v",), "avg/1", A.mean),
    "max": Derived("max", ("v",), "max/1", lambda v: F.array_max(v)),
    "pooled": Derived("pooled", ("v",), "pooled8/1", lambda v: A.pooled(v, 8)),
}


def add_columns(df: DataFrame, specs: list[Derived]) -> DataFrame:
    """All columns of `specs` in one projection, each stamped with its identity. Columns that are there are an error."""
    refuse_existing(df, [s.name for s in specs])
    return df.select("*", *(s.build(*s.inputs).alias(s.name, metadata={IDENTITY: s.identity}) for s in specs))


def missing(df: DataFrame, specs: list[Derived]) -> list[Derived]:
    """The specs whose column isn't there: all of them or none. A part of them is an error, as is a column of another identity; one without any is a warning."""
    there = [s for s in specs if s.name in df.columns]
    for s in there:
        stamp = df.schema[s.name].metadata.get(IDENTITY)
        if stamp is None:
            warnings.warn(f"{s.name} doesn't say what made it", stacklevel=2)
        elif stamp != s.identity:
            raise ValueError(f"{s.name} was made by {stamp}, not {s.identity}")
    if there and len(there) < len(specs):
        raise ValueError(f"only a part is there: {', '.join(s.name for s in there)}")
    return [] if there else specs


def audit(df: DataFrame, specs: list[Derived]) -> DataFrame:
    """(name, state, filled) of each spec: 'missing', 'unstamped', 'foreign' or 'made', and how many rows have a value.

    Rows, unlike schemas, also tell a column that was made for a part of the table: its state is 'partial'.
    """
    columns, rows = [], F.count("*")
    for s in specs:
        if s.name not in df.columns:
            state, filled = F.lit("missing"), F.expr("0L")
        else:
            stamp, filled = df.schema[s.name].metadata.get(IDENTITY), F.count(s.name)
            known = "unstamped" if stamp is None else "made" if stamp == s.identity else "foreign"
            state = F.when(filled < rows, "partial").otherwise(known)
        columns.append(F.struct(F.lit(s.name).alias("name"), state.alias("state"), filled.alias("filled")))
    return df.agg(F.array(*columns).alias("a")).select(F.inline("a"))


def batch_columns(df: DataFrame, fn: Callable[[pa.Table], dict[str, pa.Array]], schema: T.StructType | None = None) -> DataFrame:
    """Columns from an Arrow batch function, behind those of df. Without a schema the function is run on one row to learn it."""
    if schema is None:
        made = fn(df.limit(1).toArrow())
        schema = from_arrow_schema(pa.schema([(k, v.type) for k, v in made.items()]))
    refuse_existing(df, schema.names)
    out = T.StructType([*df.schema.fields, *schema.fields])
    target = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(pa.Table.from_batches([b]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(made[c].combine_chunks() if isinstance(made[c], pa.ChunkedArray) else made[c] for c in target)], [*b.schema.names, *target]
            )

    return df.mapInArrow(run, out)
