"""Allow and block rules for URLs: host suffixes and path prefixes, met by short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.llm._shared import joined_by_count, materialize

#: Rules, and bytes of their text, up to which a rule table is broadcast; larger ones are joined by digest.
BROADCAST_RULES = 100_000
BROADCAST_BYTES = 16 << 20
#: Pairs (labels of a host, characters of a path) of a rule table that expressions are limited to; with more pairs all are made.
SHAPES = 2_000
#: Hex digits of a digest that make its short prefix: 4 bytes.
SHORT = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case; path: from there up to ?, # or the end. Without :// and for null both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def _labels(host: Column) -> Column:
    return F.when(host == "", 0).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1)


def compiled(rules: DataFrame) -> DataFrame:
    """(short, digest, labels, chars, rule, weight, verdict), one row per host and path; of rows that repeat both, block wins."""
    host = F.translate("host", _UPPER, _UPPER.lower())
    bad = rules.where(F.expr("coalesce(host, '') = '' or path is null or coalesce(verdict, '') not in ('allow', 'block')"))
    if not bad.isEmpty():
        raise ValueError("a rule needs a host, a path that may be empty, and allow or block")
    once = rules.select(host.alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return materialize(
        once.select(
            F.substring(digest, 1, SHORT).alias("short"), digest.alias("digest"), _labels(F.col("host")).alias("labels"), F.length("path").alias("chars"),
            F.concat("host", "path").alias("rule"), F.struct(F.length("host") + F.length("path"), F.length("host")).alias("weight"), "verdict",
        )
    )


def _expressions(rules: DataFrame, host: Column, path: Column) -> Column:
    """Pairs of labels and path characters to make of a URL: those that rules have, or all if rules have too many."""
    labels, chars = _labels(host), F.length(path)
    shapes = sorted(map(tuple, rules.select("labels", "chars").distinct().limit(SHAPES + 1).collect()))
    if len(shapes) > SHAPES:
        longest = rules.agg(F.max("labels"), F.max("chars")).first()
        suffixes = F.sequence(F.lit(1), F.least(labels, F.lit(longest[0])))
        prefixes = F.sequence(F.lit(0), F.least(chars, F.lit(longest[1])))
        every = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("labels"), p.alias("chars")))))
        return F.when(labels > 0, every).otherwise(F.slice(every, 1, 0))
    held = F.array(*(F.struct(F.lit(s).alias("labels"), F.lit(c).alias("chars")) for s, c in shapes or [(1, 0)]))
    return F.filter(held, lambda x: (x["labels"] <= labels) & (x["chars"] <= chars))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", *, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per input row.

    `rules` has host, path and verdict ('allow' or 'block'). A rule fits a URL whose host is the
    rule's or a subdomain of it, and whose path starts with the rule's, at whatever character. Of
    those that fit the longest (host and path together) decides, then the one with the longer
    host, and block where both verdicts are given for the same host and path. `rule` is host and
    path of the one that decided, null where none fits; the verdict is then `default`: the list
    doesn't know the URL.

    Each URL becomes expressions of a host suffix and a path prefix, only in the sizes that
    occur among the rules. Expressions meet rules by the first four bytes of a SHA-256, then by
    all of it and by both sizes. A rule table beyond BROADCAST_RULES rows or BROADCAST_BYTES is
    joined by digest, the rules that many URLs meet in place; else it's broadcast. Only ids,
    hosts, paths and rows with a rule are shuffled.

    Null and empty URLs and those without :// have an empty host and path, which no rule fits.
    Rows that repeat an id, and null ids, are judged row by row. Only id and URL are read, so
    other columns may have any names. Empty tables of pages or rules give no rows, or defaults.
    """
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = materialize(
        pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("__row", F.monotonically_increasing_id())
    )
    held = compiled(rules)
    made = rows.select("__row", "host", "path", F.explode(_expressions(held, F.col("host"), F.col("path"))).alias("e")).select(
        "__row",
        F.col("e.labels").alias("labels"),
        F.col("e.chars").alias("chars"),
        _digest(F.expr("substring_index(host, '.', -e.labels)"), F.expr("left(path, e.chars)")).alias("digest"),
    )
    size = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0))).first()
    same = ["digest", "labels", "chars"]
    if size[0] <= BROADCAST_RULES and size[1] <= BROADCAST_BYTES:
        found = made.withColumn("short", F.substring("digest", 1, SHORT)).join(F.broadcast(held), ["short", *same])
    else:
        asked = made.groupBy(same).agg(F.count("*").alias("n"))
        found = joined_by_count(made.select("__row", "digest", F.col("labels").alias("l"), F.col("chars").alias("c")), held.join(asked, same), "digest").where("l = labels and c = chars")
    best = found.groupBy("__row").agg(F.max(F.struct("weight", "rule", "verdict")).alias("best"))
    return rows.join(best, "__row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
