"""Exact deduplication with a heavy-hitter split, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm._shared import filtered, id_filter, materialize


def _digest(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tracked: int = 8192, heavy: int = 1024
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the
    largest id stays (null ids come last, so a group of null ids only keeps all of them);
    rows that repeat the id that stays are all kept. Other columns of the input are not
    used, whatever their names. An empty table gives an empty result.

    approx_top_k keeps a Misra-Gries summary of `tracked` counters per task. A digest is heavy
    if that gives it 1 / `heavy` of all rows or more, so there are at most `heavy` (no digest
    with as many rows escapes, as `tracked` is larger). Their exact counts and winners come from
    one partial aggregation, and only these rows are broadcast; rows with a heavy digest take
    their winner in place and are never shuffled. Of the rest, winners of digests with more than
    one row are aggregated, and only rows that a filter of these digests can't clear meet them.
    """
    digests = materialize(docs.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("text_sha256")))
    top = digests.agg(F.expr(f"approx_top_k(text_sha256, {int(heavy)}, {int(tracked)})").alias("top"), F.count("*").alias("rows"))
    named = top.select(F.explode("top").alias("t"), "rows").where(F.col("t.count") * heavy >= F.col("rows")).select(F.col("t.item").alias("text_sha256"))
    best = F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    winners = materialize(digests.join(F.broadcast(named), "text_sha256", "left_semi").groupBy("text_sha256").agg(*best))
    split = digests.join(F.broadcast(winners), "text_sha256", "left")
    rest = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = materialize(rest.groupBy("text_sha256").agg(*best).where("group_size > 1"))
    words = id_filter(groups, "text_sha256")
    alone = filtered(rest, "text_sha256", words, inside=False).select("*", F.col("doc_id").alias("keep_id"), F.expr("1L").alias("group_size"))
    met = filtered(rest, "text_sha256", words, inside=True).join(groups.hint("merge"), "text_sha256", "left")
    met = met.select("doc_id", "text_sha256", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.expr("1L")).alias("group_size"))
    found = split.where("group_size is not null").select(alone.columns).unionByName(alone).unionByName(met)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The input's rows that stay, with the input's columns.

    A row goes by its id and its text: one that repeats an id with another text, or has none,
    goes only if its own text has another winner. Ids must be unique for one row a group to
    stay. Texts that an id filter clears aren't shuffled.
    """
    id_type = dict(docs.dtypes)[id_col]
    gone = materialize(exact_groups(docs, id_col, text_col, **options).where("not kept").select("doc_id", "text_sha256").distinct())
    words = id_filter(gone, "doc_id")
    key = F.col(f"`{id_col}`")
    some = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("doc_id"), _digest(f"`{text_col}`").alias("text_sha256"))
    clear = filtered(some.where("doc_id is not null"), "doc_id", words, inside=False)
    doubtful = filtered(some, "doc_id", words, inside=True).unionByName(some.where("doc_id is null"))
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id").cast(id_type)) & (F.col("d.text_sha256") == F.col("g.text_sha256"))
    left = doubtful.alias("d").join(gone.hint("merge").alias("g"), same, "left_anti")
    return clear.select("row.*").unionByName(left.select("d.row.*"))
