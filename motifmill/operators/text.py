"""Small full-text questions: contexts, runs of the transform, tags and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks in a block.
RANKS = 1 << 14


def context(text: Column, pos: Column, width: Column, around: int) -> Column:
    """An occurrence of `width` characters with up to `around` characters on either side."""
    start = F.greatest(pos - around, F.lit(0))
    return F.substring(text, start + 1, pos - start + width + around)


def bwt_runs(ranked: DataFrame) -> DataFrame:
    """(symbol, n_runs): runs of equal characters in the transform (sa_rank, before); runs of end markers are left out.

    Ranks are dealt out once, in blocks of RANKS; only a block's first rank meets the last one of the block before."""
    rows = ranked.select("sa_rank", "before")
    last = F.lag("before").over(Window.partitionBy(F.floor(F.col("sa_rank") / RANKS)).orderBy("sa_rank"))
    inner = rows.withColumn("last", last).where((F.col("sa_rank") % RANKS != 0) & (F.col("before") != "") & (F.col("before") != F.col("last")))
    ends = rows.where(F.col("sa_rank") % RANKS == RANKS - 1).select((F.col("sa_rank") + 1).alias("sa_rank"), F.col("before").alias("last"))
    heads = rows.where(F.col("sa_rank") % RANKS == 0).join(ends, "sa_rank", "left").where("before <> '' and (last is null or before <> last)")
    return inner.select("before").unionByName(heads.select("before")).groupBy(F.col("before").alias("symbol")).agg(F.count("*").alias("n_runs"))


def tagged(column: str, tag: str) -> Column:
    """All stretches between <tag> and </tag>, as an array."""
    return F.regexp_extract_all(column, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def chunks(text: Column, size: int) -> Column:
    """A text cut into parts of `size` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))
