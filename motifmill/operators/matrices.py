"""Pairwise matrices of samples from sparse count rows.

Input rows are (row_id, sample, freq). A pair's distance also counts rows where one side is absent. That part is what a
sample has in all rows less what it has in rows shared with the other, so only samples that are present together meet."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import lgamma


def to_samples(rows: DataFrame, run_map: DataFrame, minfreq: int = 0) -> DataFrame:
    """(row_id, sample, freq) from (row_id, run, freq) and (run, sample): of several runs of a sample the last one holds."""
    joined = rows.where(F.col("freq") >= minfreq).join(run_map, "run")
    return joined.groupBy("row_id", "sample").agg(F.max_by("freq", "run").alias("freq"))


def _entropy_of(samples: int) -> Callable:
    """Rows (row_id, freqs) to (row_id, entropy).

    The logarithm is the C library's and a row's terms are added one after the other: an evenly spread row has entropy 1,
    which is a threshold, and the last bit decides on which side of it the row falls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = math.log2(samples) if samples > 1 else math.nan
        for batch in batches:
            lists = batch.column("freqs")
            mass = np.asarray(pc.list_flatten(lists).to_numpy(zero_copy_only=False), np.float64) + 1
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            value, at = np.unique(mass, return_inverse=True)
            terms = np.bincount(row, mass * np.array([math.log2(x) for x in value.tolist()])[at], batch.num_rows)
            n = np.bincount(row, minlength=batch.num_rows)
            total = np.bincount(row, mass, batch.num_rows) + (samples - n)
            got = [(math.log2(m) - t / m) / top if k and m else None for m, t, k in zip(total.tolist(), terms.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(got, pa.float64())], ["row_id", "entropy"])

    return run


def row_entropy(rows: DataFrame, samples: int, sizes: DataFrame | None = None) -> DataFrame:
    """(row_id, entropy): smoothed entropy over all samples, from 0 to 1; with sizes (sample, size) of freq / size.

    With a single sample there is no entropy (not a number)."""
    freq = F.col("freq").cast("double")
    if sizes is not None:
        rows, freq = rows.join(sizes, "sample"), F.col("freq") / F.col("size")
    # a row has one number for each sample at most
    got = rows.groupBy("row_id").agg(F.sort_array(F.collect_list(freq)).alias("freqs"))
    return got.mapInArrow(_entropy_of(samples), f"row_id {rows.schema['row_id'].dataType.simpleString()}, entropy double")


def thresholds_by_step(step: float) -> list[float]:
    """0, step, 2 step, ... with the last one 1."""
    n = int(1 / step + 0.5)
    n += (n - 1) * step < 1
    return [*(i * step for i in range(n - 1)), 1.0]


def bucket(entropy: Column, limits: list[float]) -> Column:
    """The smallest threshold at or above the entropy, null beyond the largest."""
    out = F.lit(None).cast("double")
    for limit in sorted(limits, reverse=True):
        out = F.when(entropy <= limit, F.lit(float(limit))).otherwise(out)
    return out


def size_normalised(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with freq / size in place of freq."""
    return rows.join(sizes, "sample").select("row_id", "sample", (F.col("freq") / F.col("size")).alias("freq"))


def pair_matrices(rows: DataFrame, entropies: DataFrame, limits: list[float], samples: DataFrame) -> DataFrame:
    """(max_entropy, s, t, cnt, log_d, sqrt_d, lgamma_d) for all s <= t and thresholds, cumulative over thresholds.

    cnt counts rows with both samples; the distances sum over rows with either, squared differences of ln(1 + f) and
    sqrt(f), and lgamma(f + g + 1) - lgamma(f + 1) - lgamma(g + 1) - (f + g + 1). samples: (sample), a small dimension."""
    held = rows.join(entropies.select("row_id", bucket(F.col("entropy"), limits).alias("max_entropy")).where("max_entropy is not null"), "row_id")
    value = held.select("row_id", "max_entropy", "sample", F.col("freq").alias("f"), F.log1p("freq").alias("l"), F.sqrt("freq").alias("q"))
    left, right = (value.select("row_id", "max_entropy", *(F.col(c).alias(f"{c}{k}") for c in ("sample", "f", "l", "q"))) for k in (1, 2))
    both = left.join(right, ["row_id", "max_entropy"]).where("sample1 <= sample2")
    f1, f2 = F.col("f1"), F.col("f2")
    shared = both.groupBy("max_entropy", F.col("sample1").alias("s"), F.col("sample2").alias("t")).agg(
        F.count("*").alias("cnt"),
        F.sum((F.col("l1") - F.col("l2")) ** 2 - F.col("l1") ** 2 - F.col("l2") ** 2).alias("log_c"),
        F.sum((F.col("q1") - F.col("q2")) ** 2 - f1 - f2).alias("sqrt_c"),
        F.sum(lgamma(f1 + f2 + 1) - lgamma(f1 + 1) - lgamma(f2 + 1) - (f1 + f2 + 1) + (f1 + 1) + (f2 + 1)).alias("lgamma_c"),
    )
    alone = value.groupBy("max_entropy", "sample").agg(F.sum(F.col("l") ** 2).alias("l2"), F.sum("f").alias("f"), F.sum(F.col("f") + 1).alias("g"))
    # every pair of the sample dimension, by thresholds: S * S * K rows, whatever the number of input rows
    ends = samples.agg(F.sort_array(F.collect_list("sample")).alias("all"))
    grid = ends.select(F.explode("all").alias("s"), "all").select("s", F.explode("all").alias("t")).where("s <= t").withColumn("max_entropy", F.explode(F.array(*[F.lit(float(x)) for x in limits])))
    one = grid.join(alone.select("max_entropy", F.col("sample").alias("s"), F.col("l2").alias("l2s"), F.col("f").alias("fs"), F.col("g").alias("gs")), ["max_entropy", "s"], "left")
    two = one.join(alone.select("max_entropy", F.col("sample").alias("t"), F.col("l2").alias("l2t"), F.col("f").alias("ft"), F.col("g").alias("gt")), ["max_entropy", "t"], "left")
    full = two.join(shared, ["max_entropy", "s", "t"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    apart = F.col("s") < F.col("t")
    cells = full.select(
        "max_entropy",
        "s",
        "t",
        F.coalesce("cnt", F.lit(0)).alias("cnt"),
        F.when(apart, zero("l2s") + zero("l2t") + zero("log_c")).otherwise(0.0).alias("log_d"),
        F.when(apart, zero("fs") + zero("ft") + zero("sqrt_c")).otherwise(0.0).alias("sqrt_d"),
        F.when(apart, zero("lgamma_c") - zero("gs") - zero("gt")).otherwise(0.0).alias("lgamma_d"),
    )
    upto = Window.partitionBy("s", "t").orderBy("max_entropy").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("max_entropy", "s", "t", *(F.sum(c).over(upto).alias(c) for c in ("cnt", "log_d", "sqrt_d", "lgamma_d")))


KINDS = {"count": "cnt", "log": "log_d", "sqrt": "sqrt_d", "lgamma": "lgamma_d"}


def matrix_lines(matrices: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """(max_entropy, line_no, line): each threshold's header, then a line for each sample, the part below the diagonal 0.

    rows: (max_entropy, n_rows), how many rows a threshold has. A line is as long as there are samples."""
    number = (lambda c: c.cast("long").cast("string")) if kind == "count" else (lambda c: F.format_string("%f", c.cast("double")))
    cells = matrices.select("max_entropy", "s", "t", F.col(KINDS[kind]).alias("x"))
    mirrored = cells.unionByName(cells.where("s <> t").select("max_entropy", F.col("t").alias("s"), F.col("s").alias("t"), F.lit(0).cast(cells.schema["x"].dataType).alias("x")))
    line = mirrored.groupBy("max_entropy", "s").agg(F.sort_array(F.collect_list(F.struct("t", number(F.col("x")).alias("x")))).alias("row"))
    line = line.select("max_entropy", F.row_number().over(Window.partitionBy("max_entropy").orderBy("s")).alias("line_no"), F.concat(F.lit(" "), F.array_join(F.transform("row", lambda c: c["x"]), " ")).alias("line"))
    head = rows.select("max_entropy", F.lit(0).alias("line_no"), F.format_string("Matrix for <max_entropy>=<%f> was computed from %d substrings: ", "max_entropy", "n_rows").alias("line"))
    return head.unionByName(line)


def write_matrices(matrices: DataFrame, rows: DataFrame, folder: str, suffix: str) -> None:
    """Four folders of text, count/log/sqrt/lgamma.suffix, thresholds rising, lines in order; an existing one is an error."""
    for kind in KINDS:
        matrix_lines(matrices, rows, kind).orderBy("max_entropy", "line_no").select("line").write.mode("errorifexists").text(f"{folder}/{kind}.{suffix}")
