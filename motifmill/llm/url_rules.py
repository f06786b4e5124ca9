"""Allow and block rules on urls by a sort-merge range join.

A url's canonical key is its host with the labels reversed, then its path. Each of its host's suffixes with the path is a
key of its own, so that a rule (host, path) is exactly the interval of the keys that begin with it, and intervals nest or
are apart. Keys and rules are sorted together in range partitions; a sweep keeps the stack of the rules whose interval is
open, and the top of the stack is a key's longest rule. The rules that are open where a range begins are found by an
equi-join on its first key.

Only as many labels as the deepest rule has and as many characters of the path as the longest one has can matter, so urls
are cut down to these and equal ones are swept once; a host that has most urls is a few keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

#: What holds for urls that no rule fits.
DEFAULT = "allow"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; empty for null or without '://'."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; empty for null or without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _rules(rules: DataFrame) -> DataFrame:
    """(rhost, path, rule, verdict, size): one row a rule; of contradicting ones the block counts."""
    host, path = (F.coalesce(F.col(c), F.lit("")) for c in ("host", "path"))
    named = rules.select(F.translate(host, *LOWER).alias("h"), path.alias("path"), "verdict")
    rhost = F.when(F.col("h") == "", F.lit(None)).otherwise(reversed_host(F.col("h")))
    size = F.length("h") + F.length("path")
    return named.groupBy(F.concat("h", "path").alias("rule"), "h", "path").agg(F.max("verdict").alias("verdict")).select(rhost.alias("rhost"), "path", "rule", "verdict", size.alias("size"))


def _levels(host: Column, deepest: Column) -> Column:
    """The reversed suffixes of a host of one to `deepest` labels, and null, the suffix that all hosts have."""
    labels = F.reverse(F.split(host, r"\."))
    upto = F.least(F.size(labels), deepest)
    suffixes = F.transform(F.sequence(F.lit(0), upto), lambda k: F.when(k > 0, F.array_join(F.slice(labels, 1, k), ".")))
    return suffixes


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events in the order of (range, reversed host, path, rules first): each key's longest rule, the top of the stack."""
    stack: list[tuple[str, str, str, int]] = []
    range_, level = None, None
    for batch in batches:
        found: list[list] = [[], [], [], []]
        columns = [batch.column(c).to_pylist() for c in ("range", "rhost", "path", "is_key", "rule", "verdict", "size", "host", "head")]
        for part, rhost, path, is_key, rule, verdict, size, host, head in zip(*columns, strict=True):
            if part != range_ or rhost != level:
                range_, level = part, rhost
                stack.clear()
            while stack and not path.startswith(stack[-1][0]):
                stack.pop()
            if not is_key:
                stack.append((path, rule, verdict, size))
            elif stack:
                for c, v in zip(found, (host, head, stack[-1][3], (stack[-1][1], stack[-1][2])), strict=True):
                    c.append(v)
        if found[0]:
            best = pa.StructArray.from_arrays([pa.array([b[k] for b in found[3]], pa.string()) for k in (0, 1)], ["rule", "verdict"])
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int32()), best], ["host", "head", "size", "best"])


def fitting_rules(urls: DataFrame, rules: DataFrame, deepest: int) -> DataFrame:
    """(host, head, rule, verdict): the longest rule of each distinct (host, head) that has one; _rules() as rules."""
    key = F.explode(_levels(F.col("host"), F.lit(deepest))).alias("rhost")
    keys = urls.select(key, F.col("head").alias("path"), F.lit(True).alias("is_key"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("size"), "host", "head")
    opened = rules.select("rhost", "path", F.lit(False).alias("is_key"), "rule", "verdict", "size", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("head"))
    order = ["rhost", "path", "is_key", "host"]
    events = stored(keys.unionByName(opened).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "url-ranges")
    # a rule that begins in an earlier range and fits this range's first key is open where the range begins
    first = events.groupBy("range").agg(F.min(F.struct(*order)).alias("at")).select("range", "at.rhost", F.col("at.path").alias("first"), "at.is_key")
    earlier = (F.col("path") < F.col("first")) | ((F.col("path") == F.col("first")) & F.col("is_key"))
    open_ = first.join(opened.drop("is_key").withColumnRenamed("rhost", "r"), F.col("rhost").eqNullSafe(F.col("r"))).where(F.col("first").startswith(F.col("path")) & earlier)
    carried = open_.select("rhost", "path", F.lit(False).alias("is_key"), "rule", "verdict", "size", "host", "head", "range")
    swept = events.unionByName(carried).repartition("range").sortWithinPartitions("range", *order)
    got = swept.mapInArrow(_sweep, "host string, head string, size int, best struct<rule:string,verdict:string>")
    best = got.groupBy("host", "head").agg(F.max(F.struct("size", "best")).alias("m"))
    return best.select("host", "head", "m.best.rule", "m.best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages (all columns) plus host, path, rule and verdict.

    rules: host, path, verdict ('allow' or 'block'). A rule fits its host and all subdomains if the url's path starts with
    the rule's; the longest (host and path together) wins, of equally long ones the greater text; of rules with the same host
    and path and different verdicts the block counts. rule is the host and path of the winner, null where none fits; the
    verdict then is the default. A null path or host of a rule is empty; an empty host fits every url.

    Null urls and those without '://' have an empty host and path, which only rules of an empty host can fit. Every row is
    judged, repeated rows and null ids too; empty tables of pages or rules are no exception. Where a column has one of the
    new names already, the new one gets a leading underscore."""
    added: list[str] = []
    for c in ("host", "path", "rule", "verdict"):
        added.append(fresh(pages, c, *added))
    inner = [fresh(pages, c, *added) for c in ("__host", "__head")]
    known = stored(_rules(rules), "url-rules")
    bounds = known.agg(F.max(F.size(F.split("rhost", r"\."))), F.max(F.length("path"))).first()
    deepest, longest = max(0, bounds[0] or 0), bounds[1] or 0
    url = F.col(f"`{url_col}`")
    placed = pages.withColumns({added[0]: host_of(url), added[1]: path_of(url)})
    # of the host the labels that rules can tell apart, of the path the characters
    host, head = F.substring_index(F.col(added[0]), ".", -deepest) if deepest else F.lit(""), F.substring(F.col(added[1]), 1, longest)
    placed = placed.withColumns(dict(zip(inner, (host, head), strict=True)))
    urls = placed.select(F.col(inner[0]).alias("host"), F.col(inner[1]).alias("head")).distinct()
    found = fitting_rules(urls, known, deepest).select(F.col("host").alias(inner[0]), F.col("head").alias(inner[1]), F.col("rule").alias(added[2]), F.col("verdict").alias(added[3]))
    got = placed.join(found, inner, "left").withColumn(added[3], F.coalesce(F.col(added[3]), F.lit(default)))
    return got.select(*(F.col(f"`{c}`") for c in (*pages.columns, *added)))
