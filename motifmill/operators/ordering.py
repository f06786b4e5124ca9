"""Ranks and running sums over a whole table's order without gathering it in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir.

    A local session that names none (tests) gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="motifmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/motifmill/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    # places and ranks are numbers that rise: their differences are written
    df.write.option("compression", "zstd").option("parquet.writer.version", "v2").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_running(df: DataFrame, order: list[str], position: str = "pos", sums: dict[str, Column] | None = None) -> DataFrame:
    """df plus its 0-based position in the order, and inclusive running sums of the given columns.

    Rows are dealt out by ranges of the order and numbered where they stand; each range is shifted by the totals of the
    ranges before it, a table of one row a partition. Only sums need a window over a range, and with it a second shuffle.
    Ties are in no fixed order: order by a key."""
    sums = sums or {}
    taken = {c.lower() for c in df.columns} | {position.lower(), *(k.lower() for k in sums)}
    tag = "__"
    while any(c.startswith(tag) for c in taken):
        tag += "_"
    at, part, n = f"{tag}at", f"{tag}part", f"{tag}n"
    # the id is the partition's number, then the row's number in it
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    ranged = ranged.withColumn(part, F.shiftright(at, 33))
    totals = ranged.groupBy(part).agg(F.count("*").alias(n), *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{tag}{k}") for k, c in sums.items()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shift = totals.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n), *(F.coalesce(F.sum(f"{tag}{k}").over(before), F.lit(0)).alias(f"{tag}{k}") for k in sums))
    got = ranged.join(F.broadcast(shift), part).withColumn(position, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(n))
    upto = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    for k, c in sums.items():
        got = got.withColumn(k, F.sum(c).over(upto) + F.col(f"{tag}{k}"))
    return got.drop(at, part, n, *(f"{tag}{k}" for k in sums))


def with_last(df: DataFrame, order: list[str], values: dict[str, Column], strictly: bool = False) -> DataFrame:
    """df with the last value of each column at or before each row in the order that is not null; null where there is none.
    strictly: before the row.

    Rows are dealt out by ranges of the order. What a range begins with is the last value of the ranges before it, a table
    of one row a range, so that a look-up of the nearest row before needs no join and no window over the whole order."""
    taken = {c.lower() for c in df.columns} | {k.lower() for k in values}
    tag = "__"
    while any(c.startswith(tag) for c in taken):
        tag += "_"
    at, part = f"{tag}at", f"{tag}part"
    own = {f"{tag}{n}": k for n, k in enumerate(values)}
    rows = df.withColumns({t: values[k] for t, k in own.items()})
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    ranged = ranged.withColumn(part, F.shiftright(at, 33))
    final = ranged.groupBy(part).agg(*(F.max_by(F.col(t), F.when(F.col(t).isNotNull(), F.col(at))).alias(t) for t in own))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carried = final.select(part, *(F.last(t, ignorenulls=True).over(before).alias(f"{t}_") for t in own))
    upto = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -int(strictly))
    got = ranged.join(F.broadcast(carried), part)
    return got.withColumns({k: F.coalesce(F.last(t, ignorenulls=True).over(upto), F.col(f"{t}_")) for t, k in own.items()}).drop(at, part, *own, *(f"{t}_" for t in own))


def as_of(points: DataFrame, rows: DataFrame, key: str, values: list[str], after: bool = False) -> DataFrame:
    """points with `found`, the values of the nearest row at or before their key (after: at or after it); null where there is none.

    Points are sorted in among the rows, and each takes the last row carried along the order, so that no join and no range of
    keys is opened. key: a number in both. Of rows with equal keys one is taken; points and rows with a null key find nothing
    and are not found."""
    sign = -1 if after else 1
    held = [c for c in points.columns if c != key]
    payload, point = F.struct(*values), F.struct(*held) if held else F.lit(0)
    row_kind, point_kind = rows.select(payload.alias("r")).schema["r"].dataType, points.select(point.alias("p")).schema["p"].dataType
    there = rows.where(F.col(key).isNotNull()).select((F.col(key) * sign).alias("k"), F.lit(0).alias("kind"), payload.alias("row"), F.lit(None).cast(point_kind).alias("point"))
    asked = points.select((F.col(key) * sign).alias("k"), F.lit(1).alias("kind"), F.lit(None).cast(row_kind).alias("row"), point.alias("point"))
    got = with_last(there.unionByName(asked), ["k", "kind"], {"found": F.col("row")}).where("kind = 1")
    named = [F.col(f"point.{c}").alias(c) for c in held]
    return got.select((F.col("k") * sign).alias(key), *named, F.when(F.col("k").isNotNull(), F.col("found")).alias("found"))
