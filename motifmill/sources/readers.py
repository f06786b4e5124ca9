"""Readers of sequence collections and the formats around them; each is a DataFrame over Spark's own text source."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import stored, with_running
from . import formats

#: What stands for a gap in an alignment.
GAPS = " =-_"


def records(spark: SparkSession, path: str, sep: str = "\n", skip: int = 0, limit: int | None = None) -> DataFrame:
    """(nth, value): the records between separators, numbered in the order of files and of places in them.

    Files are split as Spark likes: a split's records are numbered by themselves and shifted by the splits before it.
    skip leaves out the first records, limit keeps so many of the others."""
    lines = spark.read.text(path, lineSep=sep).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = stored(lines.withColumn("at", F.monotonically_increasing_id()), "records")
    got = with_running(lines, ["file", "block", "at"], "nth").select("nth", "value")
    return got.where((F.col("nth") >= skip) & (F.lit(True) if limit is None else F.col("nth") < skip + limit))


def parse_fasta(records_: DataFrame, column: str = "value") -> DataFrame:
    """All columns but the given one, and (name, seq), from records whose '>' may stand before the title.

    The title's first word names, the lines after it are the sequence."""
    lines = F.split(F.regexp_replace(column, "\r", ""), "\n")
    name = F.regexp_extract(F.element_at(lines, 1), r"^>?([^ \t]*)", 1)
    body = F.array_join(F.slice(lines, 2, F.size(lines)), "")
    others = [c for c in records_.columns if c != column]
    return records_.where(F.trim(F.col(column)) != "").select(*others, name.alias("name"), body.alias("seq"))


def read_fasta(spark: SparkSession, path: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """(name, seq): a record starts where '>' begins a line, so titles may hold that sign."""
    if not skip and limit is None:
        return parse_fasta(spark.read.text(path, lineSep="\n>"))
    return parse_fasta(records(spark, path, "\n>", skip, limit)).select("name", "seq")


def read_fasta_quality(spark: SparkSession, path: str, quality_path: str) -> DataFrame:
    """(name, seq, qual): the sequences of one file with the rows of another that has a record for each in the same order."""
    seq, qual = (parse_fasta(records(spark, x, "\n>")) for x in (path, quality_path))
    return seq.join(qual.select("nth", F.col("seq").alias("qual")), "nth").select("name", "seq", "qual")


def parse_fastq(lines: DataFrame, order: str = "line_no", column: str = "value") -> DataFrame:
    """(name, seq, qual) from numbered lines: four lines a record, whose first begins with '@'."""
    record = lines.groupBy(F.floor(F.col(order) / 4).alias("record"))
    pick = lambda k: F.max(F.when(F.col(order) % 4 == k, F.regexp_replace(column, "\r", "")))
    got = record.agg(pick(0).alias("head"), pick(1).alias("seq"), pick(3).alias("qual")).where("head like '@%'")
    return got.select(F.regexp_extract("head", r"^@([^ \t]*)", 1).alias("name"), "seq", "qual")


def read_fastq(spark: SparkSession, path: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """(name, seq, qual) of the four-line records; files are split and lines numbered over the splits."""
    return parse_fastq(records(spark, path, "\n", 4 * skip, None if limit is None else 4 * limit), "nth")


def read_lines(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """(seq): every non-empty line a sequence."""
    lines = spark.read.text(path).where("value <> ''")
    return lines.select((F.lower("value") if lower else F.col("value")).alias("seq"))


def read_reads(spark: SparkSession, path: str, quality_path: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """(nth, seq, qual): one read a line, with the qualities of another file's lines, or of every second line if that is the
    same file. A line that begins like a FASTA or FASTQ title is an error."""
    if quality_path == path:
        lines = records(spark, path, "\n", 2 * skip, None if limit is None else 2 * limit)
        pick = lambda k: F.max(F.when(F.col("nth") % 2 == k, F.col("value")))
        got = lines.groupBy(F.floor(F.col("nth") / 2).alias("nth")).agg(pick(0).alias("seq"), pick(1).alias("qual"))
    else:
        got = records(spark, path, "\n", skip, limit).withColumnRenamed("value", "seq")
        if quality_path:
            got = got.join(records(spark, quality_path, "\n", skip, limit).withColumnRenamed("value", "qual"), "nth")
        else:
            got = got.withColumn("qual", F.lit(None).cast("string"))
    title = F.col("seq").startswith(">") | F.col("seq").startswith("@")
    return got.select("nth", F.when(title, F.raise_error(F.lit("a title where a read should be"))).otherwise(F.col("seq")).alias("seq"), "qual")


def read_null_separated(spark: SparkSession, path: str) -> DataFrame:
    """(seq): sequences that end with a zero byte each."""
    return spark.read.text(path, lineSep="\0").where("value <> ''").select(F.col("value").alias("seq"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(name): the word before a tab on each non-blank line; a repeated name is an error."""
    names = spark.read.text(path).select(F.trim(F.substring_index("value", "\t", 1)).alias("name")).where("name <> ''")
    again = names.groupBy("name").count().where("count > 1").first()
    if again:
        raise ValueError(f"sample {again['name']} is listed twice")
    return names


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(name, size) from tab-separated lines."""
    return spark.read.csv(path, sep="\t", schema="name string, size double")


def read_run_map(spark: SparkSession, path: str) -> DataFrame:
    """(run, sample): the number of each line, from 0, and the sample on it."""
    return records(spark, path).where("trim(value) <> ''").select(F.col("nth").alias("run"), F.trim("value").cast("long").alias("sample"))


def read_patterns(spark: SparkSession, path: str, weight_width: int = 0, tab: bool = False) -> DataFrame:
    """(pattern, weight): a pattern a line, whose first characters (a fixed number, or up to the first tab) are its weight.

    Without either, and where a weight is no number, it is 1. Empty lines are left out."""
    value = F.col("value")
    cut = F.instr(value, "\t") if tab else F.lit(weight_width)
    weight = F.substring(value, F.lit(1), cut - 1 if tab else cut).try_cast("long")
    lines = spark.read.text(path).where("value <> ''")
    return lines.select(F.substring(value, cut + 1, F.length(value)).alias("pattern"), F.coalesce(weight, F.lit(1)).alias("weight"))


def read_fixed_width_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(nth, pattern) of files that begin with '# number=N length=L' and hold N rows of L bytes without separators, numbered over
    the files in the order of their names. Splits go straight to their rows."""
    formats.register(spark)
    return spark.read.format("fixed_width").load(path)


def strain_texts(lines: DataFrame, order: list[str], column: str, chunk: int = 1000) -> DataFrame:
    """(strain, chunk, text): the columns of an alignment, whose line has strain k's character at place 2 k.

    Characters are upper-cased and gaps left out; each strain's text comes in chunks, so no task holds a whole one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, upto = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            widths, joined = {len(x) for x in rows}, "".join(rows)
            width, found = max(widths, default=0), []
            for strain, k in enumerate(range(0, width, 2)):
                text = joined[k::width] if len(widths) == 1 else "".join([x[k] for x in rows if len(x) > k])
                for gap in GAPS:
                    text = text.replace(gap, "")
                if text:
                    found.append((strain, upto[strain], text))
                    upto[strain] += len(text)
            strain, at, text = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(strain, pa.int32()), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(text, pa.string())], ["strain", "part", "at", "text"])

    # lines are sorted once, as they are; each range writes every strain's characters as pieces, counted within the range
    kept = lines.where((F.length(column) > 0) & ~F.col(column).startswith(">")).select(*order, column)
    ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order).select(column)
    pieces = stored(ordered.mapInArrow(run, "strain int, part int, at long, text string"), "strains").withColumn("n", F.length("text"))
    before = Window.partitionBy("strain").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a strain and range
    shift = pieces.groupBy("strain", "part").agg(F.sum("n").alias("n")).select("strain", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = pieces.join(shift, ["strain", "part"]).withColumn("first", F.col("at") + F.col("shift"))
    own = own.select("strain", "first", "text", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor((F.col("first") + F.col("n") - 1) / chunk))).alias("chunk"))
    start = F.greatest(F.col("first"), F.col("chunk") * chunk)
    cut = F.substring("text", (start - F.col("first") + 1).cast("int"), ((F.col("chunk") + 1) * chunk - start).cast("int"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(start.alias("start"), cut.alias("cut")))), lambda x: x["cut"]), "")
    return own.groupBy("strain", "chunk").agg(F.upper(whole).alias("text"))
