"""Mining of substrings that are frequent within samples and informative across them.

Sequences are cut into runs of bases; equal runs of a sample are counted once. Every position gives one window of at
most `depth` bases; windows are summed first and only the distinct ones are opened into their prefixes, so the work on
occurrences is one row a position whatever the depth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.sequences import entropy_term, reverse_complement, smoothed_entropy
from .intervals import frequent_paths
from .ordering import stored


@dataclass(frozen=True)
class MiningOptions:
    """fmin: least occurrences in a sample. depth: longest substring. pmin, pmax: samples (pmax 0: no bound). emin, emax:
    entropy in bits (emax 0: no filter). mindepth: shortest substring."""

    fmin: int = 2
    depth: int = 5
    pmin: int = 2
    pmax: int = 0
    emin: float = 0.0
    emax: float = 0.0
    mindepth: int = 0


def runs(sequences: DataFrame) -> DataFrame:
    """(sample, run, w) of both strands from (sample, seq)."""
    run = F.explode(F.split("seq", "[^ACGT]+")).alias("run")
    once = sequences.select("sample", run).where("run <> ''").groupBy("sample", "run").agg(F.count("*").alias("w"))
    return once.unionByName(once.select("sample", reverse_complement(F.col("run")).alias("run"), "w"))


def nodes(sequences: DataFrame, fmin: int, depth: int, prefix: str = "") -> DataFrame:
    """(sample, path, freq, left_char): substrings with at least fmin occurrences in a sample.

    left_char is the base before all occurrences, 0 if none has a base before it, else N. prefix keeps the substrings
    that start with it and the prefix's own beginnings."""
    p = F.posexplode(F.sequence(F.lit(1), F.length("run")))
    at = runs(sequences).select("sample", "run", "w", p.alias("i", "p"))
    window = at.select("sample", F.substring("run", F.col("p"), F.lit(depth)).alias("window"), F.when(F.col("p") > 1, F.substring("run", F.col("p") - 1, F.lit(1))).alias("left"), "w")
    summed = window.groupBy("sample", "window", "left").agg(F.sum("w").alias("w"))
    if prefix:
        summed = summed.where(F.col("window").startswith(prefix[:1]))
    opened = summed.select("sample", "left", "w", F.explode(F.transform(F.sequence(F.lit(1), F.length("window")), lambda k: F.substring("window", F.lit(1), k))).alias("path"))
    if prefix:
        opened = opened.where(F.col("path").startswith(prefix) | F.lit(prefix).startswith(F.col("path")))
    found = opened.groupBy("sample", "path").agg(F.sum("w").alias("freq"), F.coalesce(F.sum(F.when(F.col("left").isNotNull(), F.col("w"))), F.lit(0)).alias("based"), F.min("left").alias("low"), F.max("left").alias("high"))
    left = F.when(F.col("based") == 0, "0").when((F.col("based") == F.col("freq")) & (F.col("low") == F.col("high")), F.col("low")).otherwise("N")
    return found.where(F.col("freq") >= fmin).select("sample", "path", "freq", left.alias("left_char"))


def merged(found: DataFrame, samples: int) -> DataFrame:
    """(path, n_samples, total_freq, entropy, left_char) over all samples; `samples` counts those without a hit too."""
    got = found.groupBy("path").agg(F.count("*").alias("n_samples"), F.sum("freq").alias("total_freq"), F.sum(entropy_term(F.col("freq"))).alias("terms"), F.min("left_char").alias("low"), F.max("left_char").alias("high"))
    left = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("N")
    return got.select("path", "n_samples", "total_freq", smoothed_entropy(F.col("total_freq"), F.col("terms"), samples).alias("entropy"), left.alias("left_char"))


def branching(all_nodes: DataFrame) -> DataFrame:
    """merged nodes plus n_children, child_samples and whether they branch to the right and to the left.

    A node does not branch to the right if its only child has the same number of samples."""
    kids = all_nodes.where("length(path) > 1").select(F.expr("substring(path, 1, length(path) - 1)").alias("parent"), "n_samples").groupBy("parent").agg(F.count("*").alias("n_children"), F.max("n_samples").alias("child_samples"))
    got = all_nodes.join(kids, all_nodes.path == kids.parent, "left").drop("parent")
    right = ~((F.coalesce("n_children", F.lit(0)) == 1) & (F.col("child_samples") == F.col("n_samples")))
    return got.select(*all_nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("child_samples", F.lit(0)).alias("child_samples"), F.coalesce(right, F.lit(True)).alias("right_branching"), (~F.col("left_char").isin(*"ACGT")).alias("left_branching"))


def chosen(options: MiningOptions) -> Column:
    """The filter on branching() that mining's output passes."""
    keep = F.col("right_branching") & F.col("left_branching") & (F.length("path") >= options.mindepth) & (F.col("n_samples") >= options.pmin)
    if options.pmax:
        keep = keep & (F.col("n_samples") <= options.pmax)
    if options.emax > 0:
        keep = keep & F.col("entropy").between(options.emin, options.emax)
    return keep


def mine(sequences: DataFrame, options: MiningOptions) -> DataFrame:
    """(path, n_samples, total_freq, entropy, freqs): maximal informative substrings; freqs lists (sample, freq) by sample."""
    found = stored(nodes(sequences, options.fmin, options.depth), "nodes")
    samples = sequences.select("sample").distinct().count()
    kept = branching(merged(found, samples)).where(chosen(options))
    freqs = found.join(kept.select("path"), "path", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("sample", "freq"))).alias("freqs"))
    return kept.join(freqs, "path").select("path", "n_samples", "total_freq", "entropy", "freqs")


def row_text(mined: DataFrame, decimals: int = 6) -> DataFrame:
    """(path, line): 'path entropy sample:freq ...'."""
    pairs = F.array_join(F.transform("freqs", lambda x: F.concat(x["sample"], F.lit(":"), x["freq"].cast("string"))), " ")
    return mined.select("path", F.concat_ws(" ", "path", F.format_string(f"%.{decimals}f", F.round("entropy", decimals)), pairs).alias("line"))


def parse_rows(lines: DataFrame, column: str = "line") -> DataFrame:
    """(path, entropy, sample, freq) from rows of text: fields with a colon are pairs, an entropy field has none.

    A sample's name goes up to the last colon and may hold dots and colons itself; what is no number becomes null."""
    part = F.split(F.trim(F.col(column)), " +")
    has = ~F.element_at(part, 2).contains(":")
    opened = lines.select(F.element_at(part, 1).alias("path"), F.when(has, F.element_at(part, 2).try_cast("double")).alias("entropy"), F.explode(F.slice(part, F.when(has, 3).otherwise(2), F.size(part))).alias("pair"))
    freq = F.substring_index("pair", ":", -1)
    return opened.select("path", "entropy", F.expr("substring(pair, 1, length(pair) - length(substring_index(pair, ':', -1)) - 1)").alias("sample"), freq.try_cast("long").alias("freq"))


def write_rows(mined: DataFrame, folder: str, decimals: int = 6, gzip: bool = False) -> None:
    """Rows of text in the order in which a walk leaves the substrings (a longer one before its beginning)."""
    rows = row_text(mined, decimals).orderBy(F.concat("path", F.lit("~"))).select("line")
    rows.write.mode("errorifexists").option("compression", "gzip" if gzip else "none").text(folder)


def write_rows_observed(all_nodes: DataFrame, found: DataFrame, options: MiningOptions, samples: int, folder: str, decimals: int = 6, gzip: bool = False) -> dict:
    """Writes the mined rows of branching() nodes and returns the run's summary, observed by the job that makes the rows.

    total_paths counts all merged nodes, outputs and occs the rows written and their samples; min_entropy and max_entropy are
    over nodes of several samples; n1, n2, ... are how many rows have so many samples. found: nodes(); samples: their number.
    The nodes are merged once: what is counted is counted as the rows pass by."""
    seen, written = Observation(), Observation()
    several = F.when(F.col("n_samples") > 1, F.col("entropy"))
    watched = all_nodes.observe(seen, F.count("*").alias("total_paths"), F.min(several).alias("min_entropy"), F.max(several).alias("max_entropy"))
    kept = watched.where(chosen(options)).select("path", "entropy", "n_samples")
    by_samples = [F.count_if(F.col("n_samples") == k).alias(f"n{k}") for k in range(1, samples + 1)]
    kept = kept.observe(written, F.count("*").alias("outputs"), F.coalesce(F.sum("n_samples"), F.lit(0)).alias("occs"), *by_samples)
    kept = stored(kept, "mined")  # sorting would read what passes by twice
    freqs = found.join(kept.select("path"), "path", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("sample", "freq"))).alias("freqs"))
    write_rows(kept.join(freqs, "path"), folder, decimals, gzip)
    return seen.get | written.get


def deep_nodes(sequences: DataFrame, fmin: int) -> DataFrame:
    """nodes() without a depth bound, from the intervals of common prefixes of each sample's suffixes."""
    both = runs(sequences).withColumnsRenamed({"run": "text", "w": "copies"})
    found = frequent_paths(both, "sample", fmin)
    left = F.when(F.col("left") == "", "0").otherwise(F.coalesce("left", F.lit("N")))
    return found.select("sample", "path", "freq", left.alias("left_char"))


def add_up(parts: DataFrame, fmin: int) -> DataFrame:
    """nodes of a collection from the nodes (fmin 1) of its parts: counts add up before the frequency filter."""
    got = parts.groupBy("sample", "path").agg(F.sum("freq").alias("freq"), F.min("left_char").alias("low"), F.max("left_char").alias("high"))
    return got.where(F.col("freq") >= fmin).select("sample", "path", "freq", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("N").alias("left_char"))
