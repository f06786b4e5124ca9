"""The registered queries of the mining, matrix, text and rank operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as seq
from ..operators import alignment, intervals, matrices, mining, ranks, sampling, suffixes, text
from ..operators.ordering import as_of, scratch, stored, with_running
from ..sources import formats, readers
from .oracle import BLOCK, DEPTH, FMIN, LIMITS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", seq.normalize(F.col("text")).alias("seq"))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("sample"), seq.dense(F.col("text")).alias("seq"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return mining.nodes(_sequences(spark, d), FMIN, DEPTH)


def _merged(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "documents").agg(F.count_distinct("source")).first()[0]
    return mining.merged(_nodes(spark, d), samples)


@query
def normalize_sequences(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d)


@query
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d).select("doc_id", seq.reverse_complement(F.col("seq")).alias("seq"))


@query
def strand_join(spark: SparkSession, d: str) -> DataFrame:
    return _normal(spark, d).select("doc_id", seq.strand_join(F.col("seq")).alias("seq"))


@query
def color_code(spark: SparkSession, d: str) -> DataFrame:
    bases = F.translate("seq", "0123.", "NNNNN")
    return _normal(spark, d).select("doc_id", seq.color_code(bases).alias("colors"))


@query
def trie_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("sample", "path", "freq")


@query
def left_char(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("sample", "path", "left_char")


@query
def nodes_prefix(spark: SparkSession, d: str) -> DataFrame:
    return mining.nodes(_sequences(spark, d), FMIN, DEPTH, "AC").select("sample", "path", "freq")


@query
def index_check(spark: SparkSession, d: str) -> DataFrame:
    normal = _normal(spark, d)
    total = normal.agg(F.sum(F.length("seq")).alias("total"))
    symbol = normal.select(F.explode(F.split("seq", "")).alias("symbol")).where("symbol <> ''")
    return symbol.groupBy("symbol").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("symbol", "n", "total")


@query
def merge_support(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("path", "n_samples", "total_freq")


@query
def merge_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select("path", F.round("entropy", 6).alias("entropy"))


@query
def right_branching(spark: SparkSession, d: str) -> DataFrame:
    return mining.branching(_merged(spark, d)).select("path", "n_children", "child_samples", "right_branching")


@query
def left_branching(spark: SparkSession, d: str) -> DataFrame:
    return mining.branching(_merged(spark, d)).select("path", "left_char", "left_branching")


def _mined(spark: SparkSession, d: str, **options) -> DataFrame:
    return mining.branching(_merged(spark, d)).where(mining.chosen(mining.MiningOptions(fmin=FMIN, depth=DEPTH, **options)))


def _short(df: DataFrame) -> DataFrame:
    return df.select("path", "n_samples", "total_freq", F.round("entropy", 6).alias("entropy"))


@query
def mine_maximal(spark: SparkSession, d: str) -> DataFrame:
    return _short(_mined(spark, d, emin=1.0, emax=4.25))


@query
def mine_sample_specific(spark: SparkSession, d: str) -> DataFrame:
    return _short(_mined(spark, d, pmin=1, pmax=1))


@query
def mine_mindepth(spark: SparkSession, d: str) -> DataFrame:
    return _short(_mined(spark, d, mindepth=5))


@query
def freq_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d).groupBy("n_samples").agg(F.count("*").alias("n_paths"))


@query
def mine_summary(spark: SparkSession, d: str) -> DataFrame:
    out = mining.chosen(mining.MiningOptions())
    several = F.when(F.col("n_samples") > 1, F.col("entropy"))
    return mining.branching(_merged(spark, d)).agg(
        F.count("*").alias("total_paths"),
        F.sum(out.cast("long")).alias("outputs"),
        F.sum(F.when(out, F.col("n_samples"))).alias("occs"),
        F.round(F.min(several), 6).alias("min_entropy"),
        F.round(F.max(several), 6).alias("max_entropy"),
    )


@query
def mine_observed(spark: SparkSession, d: str) -> DataFrame:
    """The summary and histogram that the job which writes the mined rows has observed."""
    samples = table(spark, d, "documents").agg(F.count_distinct("source")).first()[0]
    found = stored(_nodes(spark, d), "nodes")
    options = mining.MiningOptions(fmin=FMIN, depth=DEPTH)
    got = mining.write_rows_observed(mining.branching(mining.merged(found, samples)), found, options, samples, scratch(spark, "mined-rows"))
    row = (got["total_paths"], got["outputs"], got["occs"], got["min_entropy"], got["max_entropy"], sum(got[f"n{k}"] for k in range(2, samples + 1) if k % 2 == 0))
    made = spark.createDataFrame([row], "total_paths long, outputs long, occs long, low double, high double, even_outputs long")
    return made.select("total_paths", "outputs", "occs", F.round("low", 6).alias("min_entropy"), F.round("high", 6).alias("max_entropy"), "even_outputs")


@query
def row_format(spark: SparkSession, d: str) -> DataFrame:
    mined = mining.mine(_sequences(spark, d), mining.MiningOptions(fmin=FMIN, depth=DEPTH))
    return mining.row_text(mined, 4)


@query
def row_parse(spark: SparkSession, d: str) -> DataFrame:
    return mining.parse_rows(row_format(spark, d)).select("path", "sample", "freq")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("row_id"), F.col("event_type").alias("sample")).agg(F.count("*").alias("freq"))


def _dims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("sample")).distinct()


@query
def run_to_sample(spark: SparkSession, d: str) -> DataFrame:
    halves = table(spark, d, "events").select(F.col("user_id").alias("row_id"), "event_type", (F.col("event_id") % 2).alias("half"))
    runs = halves.groupBy("row_id", F.concat_ws("/", "event_type", "half").alias("run")).agg(F.count("*").alias("freq"))
    run_map = halves.select(F.concat_ws("/", "event_type", "half").alias("run"), F.col("event_type").alias("sample")).distinct()
    return matrices.to_samples(runs, run_map)


def _entropies(spark: SparkSession, d: str) -> DataFrame:
    return matrices.row_entropy(_counts(spark, d), _dims(spark, d).count())


@query
def norm_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _entropies(spark, d).select("row_id", F.round("entropy", 6).alias("entropy"))


@query
def size_norm_entropy(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "events").groupBy(F.col("event_type").alias("sample")).agg(F.avg("value").alias("size"))
    got = matrices.row_entropy(_counts(spark, d), _dims(spark, d).count(), sizes)
    return got.select("row_id", F.round("entropy", 6).alias("entropy"))


@query
def entropy_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _entropies(spark, d).select("row_id", matrices.bucket(F.col("entropy"), list(LIMITS)).alias("max_entropy"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return matrices.pair_matrices(_counts(spark, d), _entropies(spark, d), list(LIMITS), _dims(spark, d))


@query
def count_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("max_entropy", "s", "t", "cnt")


@query
def log_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("max_entropy", "s", "t", F.round("log_d", 6).alias("log_d"))


@query
def sqrt_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("max_entropy", "s", "t", F.round("sqrt_d", 6).alias("sqrt_d"))


@query
def lgamma_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("max_entropy", "s", "t", F.round("lgamma_d", 4).alias("lgamma_d"))


@query
def threshold_rows(spark: SparkSession, d: str) -> DataFrame:
    limits = F.explode(F.array(*[F.lit(float(x)) for x in LIMITS])).alias("max_entropy")
    got = _entropies(spark, d).select("entropy", limits)
    return got.groupBy("max_entropy").agg(F.sum((F.col("entropy") <= F.col("max_entropy")).cast("long")).alias("n_rows"))


def _talk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "text")


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    """(pattern, weight): the benchmark's words of three letters or more, and how often they are there."""
    word = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pattern")
    return table(spark, d, "benchmark").select(word).where("length(pattern) >= 3").groupBy("pattern").agg(F.count("*").alias("weight"))


TURN = ["conv_id", "turn"]


def _found(spark: SparkSession, d: str) -> suffixes.Found:
    return suffixes.find(_talk(spark, d), _patterns(spark, d), TURN)


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).occurrences()


@query
def pattern_count(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    listed = found.occurrences().select("pattern", *TURN).distinct().groupBy("pattern").agg(F.count("*").alias("n_texts"))
    return found.bounds.where("n > 0").select("pattern", "n").join(listed, "pattern")


@query
def pattern_locate(spark: SparkSession, d: str) -> DataFrame:
    return _occurrences(spark, d)


@query
def passage_locate(spark: SparkSession, d: str) -> DataFrame:
    """Whole benchmark passages in the documents."""
    passages = table(spark, d, "benchmark").select("item_id", F.col("text").alias("pattern"))
    found = suffixes.find(table(spark, d, "documents").select("doc_id", "text"), passages, ["doc_id"]).occurrences()
    return found.join(passages, "pattern").select("item_id", "doc_id", "pos")


@query
def locate_multi(spark: SparkSession, d: str) -> DataFrame:
    return _occurrences(spark, d).select("conv_id", "turn", "pos").distinct()


@query
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return _occurrences(spark, d).select("pattern", "conv_id").distinct()


@query
def kwic(spark: SparkSession, d: str) -> DataFrame:
    got = _occurrences(spark, d).join(_talk(spark, d), ["conv_id", "turn"])
    return got.select("pattern", "conv_id", "turn", "pos", text.context(F.col("text"), F.col("pos").cast("int"), F.length("pattern"), 10).alias("shown"))


@query
def display_sequence(spark: SparkSession, d: str) -> DataFrame:
    return _talk(spark, d).select("conv_id", "turn", F.concat("text", F.lit("$")).alias("shown"))


@query
def display_range(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.length("text") >= 50, F.substring("text", 11, 40))
    return table(spark, d, "documents").select("doc_id", shown.alias("shown"), F.substring("text", 1, 40).alias("head"))


def _asked(spark: SparkSession, d: str, name: str, total: int) -> DataFrame:
    """(event_id, name): a place below `total` for every event, spread by a multiplication."""
    return table(spark, d, "events").select("event_id", F.pmod(F.col("event_id") * 1_000_003, F.lit(max(1, total))).alias(name))


@query
def position_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The document and the place in it of any positions of all texts laid end to end, one for each event."""
    ranges = stored(seq_ranges(spark, d).where("first <= last").select(F.col("first").alias("pos"), "doc_id", "last"), "ranges")
    total = ranges.agg(F.max("last") + 1).first()[0] or 0
    got = as_of(_asked(spark, d, "pos", total), ranges.withColumn("first", F.col("pos")), "pos", ["doc_id", "first"])
    return got.select("event_id", "pos", "found.doc_id", (F.col("pos") - F.col("found.first")).alias("offset"))


@query
def character_at(spark: SparkSession, d: str) -> DataFrame:
    """The character at a rank of all sorted characters of the conversations, a rank for each event."""
    counts = stored(character_counts(spark, d), "characters")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return ranks.symbol_at(_asked(spark, d, "rank", total), counts, "rank").select("event_id", "rank", "symbol")


@query
def ones_around(spark: SparkSession, d: str) -> DataFrame:
    """The nearest ones at or before, and at or after, a position for each event; -1 where there is none."""
    bits = stored(_bits(spark, d).select("pos", "bit"), "bits")
    ones = bits.where("bit = 1").select("pos", F.col("pos").alias("one"))
    asked = _asked(spark, d, "pos", bits.count())
    before = as_of(asked, ones, "pos", ["one"]).select("event_id", "pos", F.coalesce("found.one", F.lit(-1)).alias("one_before"))
    after = as_of(asked, ones, "pos", ["one"], after=True).select("event_id", F.coalesce("found.one", F.lit(-1)).alias("one_after"))
    return before.join(after, "event_id")


@query
def rectangle_counts(spark: SparkSession, d: str) -> DataFrame:
    """Line items in a rectangle of places and part keys, one for each supplier."""
    placed = stored(with_running(_items(spark, d), ITEM, "pos").select("pos", "l_partkey"), "sequence")
    n = placed.count()
    s = F.col("s_suppkey")
    low, least = F.pmod(s * 7_919, F.lit(max(1, n))), F.pmod(s * 31, F.lit(150))
    sides = table(spark, d, "supplier").select(s.alias("name"), low.alias("low"), (low + n // 3).alias("high"), least.alias("least"), (least + 200 + s).alias("most"))
    return ranks.rectangle_counts(placed, "l_partkey", sides).select(F.col("name").alias("s_suppkey"), "n")


@query
def seq_ranges(spark: SparkSession, d: str) -> DataFrame:
    size = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("size"))
    got = with_running(size, ["doc_id"], "nth", {"upto": F.col("size")})
    return got.select("doc_id", (F.col("upto") - F.col("size")).alias("first"), (F.col("upto") - 1).alias("last"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(F.col("line").contains("tion")).select("line").distinct()


@query
def grep_count(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(F.col("line").contains("tion")).groupBy("conv_id").agg(F.count("*").alias("n_lines"))


def _suffixes(spark: SparkSession, d: str, kept: list[str]) -> DataFrame:
    return suffixes.named_order(_talk(spark, d), TURN, kept=kept)[0]


@query
def bwt(spark: SparkSession, d: str) -> DataFrame:
    return _suffixes(spark, d, ["before"]).select("sa_rank", F.col("before").alias("symbol"))


@query
def bwt_runs(spark: SparkSession, d: str) -> DataFrame:
    return text.bwt_runs(_suffixes(spark, d, ["before"]))


@query
def suffix_rank(spark: SparkSession, d: str) -> DataFrame:
    order, named = suffixes.named_order(_talk(spark, d), TURN, kept=[])
    return suffixes.with_keys(order.select("tid", "g", "sa_rank"), named, TURN)


@query
def display_from_rank(spark: SparkSession, d: str) -> DataFrame:
    """Forty characters from each rank on."""
    order, named = suffixes.named_order(_talk(spark, d), TURN, kept=["pos"])
    return suffixes.shown_from(order, named, 40).select("sa_rank", "shown")


@query
def lcp_array(spark: SparkSession, d: str) -> DataFrame:
    return suffixes.common_prefixes(*suffixes.named_order(_talk(spark, d), TURN, common=True)).select("sa_rank", "lcp")


@query
def document_nodes(spark: SparkSession, d: str) -> DataFrame:
    return intervals.document_graph(_talk(spark, d), TURN, BLOCK)[0]


@query
def document_edges(spark: SparkSession, d: str) -> DataFrame:
    return intervals.document_graph(_talk(spark, d), TURN, BLOCK)[1]


@query
def weighted_found(spark: SparkSession, d: str) -> DataFrame:
    """The summed weights of the patterns that begin at each place."""
    return _occurrences(spark, d).join(_patterns(spark, d), "pattern").groupBy("conv_id", "turn", "pos").agg(F.sum("weight").alias("weight"))


@query
def pattern_draw(spark: SparkSession, d: str) -> DataFrame:
    """A hundred patterns drawn in proportion to their weights."""
    return ranks.systematic_positions(_patterns(spark, d), ["pattern"], "weight", 100)


@query
def random_patterns(spark: SparkSession, d: str) -> DataFrame:
    """A thousand patterns drawn at random in proportion to their weights."""
    return ranks.random_draws(_patterns(spark, d), ["pattern"], "weight", 1000, 0xDEADBEEF)


@query
def greedy_samples(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.coalesce("n_chars", F.lit(0)).alias("weight"))
    return ranks.greedy_samples(weights, 8, 0.5)


@query
def optimal_samples(spark: SparkSession, d: str) -> DataFrame:
    """How many samples the cheapest path takes and what it costs to go from the sample before to every weighted place."""
    weights = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.coalesce("n_chars", F.lit(0)).alias("weight"))
    samples = stored(sampling.optimal_samples(weights, 8), "samples")
    cost = as_of(weights, samples.withColumn("sample", F.col("pos")), "pos", ["sample"])
    cost = cost.agg(F.sum(F.col("weight") * (F.col("pos") - F.col("found.sample"))).cast("long").alias("cost"))
    return samples.agg(F.count("*").alias("n_samples")).join(F.broadcast(cost))  # one row each


def _bits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return ranks.bit_ranks(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], F.col("l_returnflag") == "R")


@query
def bit_rank(spark: SparkSession, d: str) -> DataFrame:
    return _bits(spark, d).select("pos", "rank1", "rank0")


@query
def bit_select(spark: SparkSession, d: str) -> DataFrame:
    return ranks.select_bits(_bits(spark, d))


@query
def zero_select(spark: SparkSession, d: str) -> DataFrame:
    return ranks.select_bits(_bits(spark, d), 0)


@query
def select_next(spark: SparkSession, d: str) -> DataFrame:
    got = ranks.select_next(stored(_bits(spark, d).select("pos", "bit", "rank1"), "bits"))
    return got.select("pos", F.coalesce("next", F.lit(-1)).alias("next_one"))


@query
def zero_next(spark: SparkSession, d: str) -> DataFrame:
    got = ranks.select_next(stored(_bits(spark, d).select("pos", "bit", "rank0"), "bits"), 0)
    return got.select("pos", F.coalesce("next", F.lit(-1)).alias("next_zero"))


ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*ITEM)


def _line_numbers(spark: SparkSession, d: str) -> list[int]:
    """The alphabet of line numbers, a handful."""
    return [r[0] for r in table(spark, d, "lineitem").select("l_linenumber").distinct().collect()]


@query
def symbol_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranks.symbol_ranks(_items(spark, d), ITEM, "l_returnflag").select("pos", "l_returnflag", "sym_rank")


@query
def symbol_select(spark: SparkSession, d: str) -> DataFrame:
    return ranks.symbol_ranks(_items(spark, d), ITEM, "l_linenumber").select("l_linenumber", F.col("sym_rank").alias("k"), "pos")


@query
def symbol_next(spark: SparkSession, d: str) -> DataFrame:
    got = ranks.symbol_next(stored(symbol_rank(spark, d), "symbols"), "l_returnflag")
    return got.select("pos", F.coalesce("next", F.lit(-1)).alias("next"))


@query
def rank_below(spark: SparkSession, d: str) -> DataFrame:
    return ranks.prefix_ranks(_items(spark, d), ITEM, "l_linenumber", _line_numbers(spark, d)).select("pos", "below")


@query
def largest_up_to(spark: SparkSession, d: str) -> DataFrame:
    got = ranks.largest_up_to(_items(spark, d), ITEM, "l_linenumber", 4, _line_numbers(spark, d))
    return got.select("pos", F.coalesce("largest", F.lit(-1)).alias("largest"), F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))


@query
def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    placed = stored(with_running(_items(spark, d), ITEM, "pos").select("pos", "l_returnflag"), "sequence")
    return ranks.run_lengths(placed, "l_returnflag")


@query
def character_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each character of the conversations, how often it is there, and how many characters are smaller."""
    return ranks.symbol_counts(_talk(spark, d).select(F.explode(F.split("text", "")).alias("c")).where("c <> ''"), "c")


@query
def symbol_counts(spark: SparkSession, d: str) -> DataFrame:
    return ranks.symbol_counts(table(spark, d, "lineitem"), "l_linenumber")


@query
def symbol_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at")).agg(F.min("l_returnflag").alias("flag"))
    return ranks.runs(rows, ["l_suppkey"], "at", "flag")


def _middle(spark: SparkSession, d: str) -> DataFrame:
    """The line items of the middle half of all places that have line numbers 2 to 4."""
    rows = with_running(_items(spark, d), ITEM, "pos")
    n = table(spark, d, "lineitem").count()
    return ranks.in_range(rows, "pos", n // 4, 3 * n // 4, "l_linenumber", 2, 4)


@query
def range_report(spark: SparkSession, d: str) -> DataFrame:
    return _middle(spark, d).select("pos", "l_linenumber")


@query
def range_count(spark: SparkSession, d: str) -> DataFrame:
    return _middle(spark, d).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@query
def hamming(spark: SparkSession, d: str) -> DataFrame:
    listed = seq.mismatch_list(F.col("p_name"), F.reverse("p_name"))
    return table(spark, d, "part").select("p_partkey", F.size(listed).alias("n"))


@query
def mismatch_rows(spark: SparkSession, d: str) -> DataFrame:
    listed = seq.mismatches(F.col("p_name"), F.reverse("p_name"))
    return table(spark, d, "part").select("p_partkey", listed.alias("listed"))


@query
def edit_script(spark: SparkSession, d: str) -> DataFrame:
    """Edit operations, CIGAR, script and distance; held against a brute-force check in the tests."""
    return alignment.aligned(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type")


@query
def deep_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Substrings of prose bases without a depth bound."""
    sequences = table(spark, d, "documents").select(F.col("source").alias("sample"), seq.normalize(F.col("text")).alias("seq"))
    return mining.deep_nodes(sequences, 3)


@query
def post_order(spark: SparkSession, d: str) -> DataFrame:
    """The mined substrings numbered as a walk leaves them: a longer one before its beginning."""
    paths = _mined(spark, d).select("path", F.concat("path", F.lit("~")).alias("by"))
    return with_running(paths, ["by"], "nth").select("path", "nth")


@query
def page_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = text.tagged("html", "p")
    return table(spark, d, "pages").select("page_id", tags.alias("t")).select("page_id", F.size("t").cast("long").alias("n"), F.get("t", F.lit(0)).alias("first"))


@query
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"), 1000)).alias("chunk", "part")).withColumn("chunk", F.col("chunk").cast("long"))


def _written(lines: DataFrame, what: str) -> str:
    """The path of a new text file of these lines (column value)."""
    path = scratch(lines.sparkSession, what)
    lines.select("value").write.text(path)
    return path


def _named(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, name, text) of the conversations, without titles' signs and line breaks that end a file's line."""
    name = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", name.alias("name"), "role", F.regexp_replace("text", "[>@\r]", "").alias("text"))


@query
def fasta_records(spark: SparkSession, d: str) -> DataFrame:
    """Written as a file whose titles hold '>' themselves, and read back."""
    value = F.concat(F.lit(">"), "name", F.lit(" a->b "), "role", F.lit("\n"), "text")
    return readers.read_fasta(spark, _written(_named(spark, d).select(value.alias("value")), "fasta"))


@query
def fasta_qualities(spark: SparkSession, d: str) -> DataFrame:
    one = _named(spark, d).orderBy("conv_id", "turn")
    paths = [_written(one.select(F.concat(F.lit(">"), "name", F.lit("\n"), body).alias("value")), "fasta") for body in (F.col("text"), F.reverse("text"))]
    return readers.read_fasta_quality(spark, *paths)


@query
def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    flat = F.translate("text", "\n", " ")
    value = F.concat(F.lit("@"), "name", F.lit(" x\n"), flat, F.lit("\n+\n@"), F.reverse(flat))
    return readers.read_fastq(spark, _written(_named(spark, d).select(value.alias("value")), "fastq"))


@query
def fasta_source(spark: SparkSession, d: str) -> DataFrame:
    """The same records through the data source, whose splits cut through records."""
    formats.register(spark)
    value = F.concat(F.lit(">"), "name", F.lit(" a->b "), "role", F.lit("\n"), "text")
    return spark.read.format("fasta").option("splitBytes", 100_000).load(_written(_named(spark, d).select(value.alias("value")), "fasta"))


@query
def fastq_source(spark: SparkSession, d: str) -> DataFrame:
    formats.register(spark)
    flat = F.translate("text", "\n", " ")
    value = F.concat(F.lit("@"), "name", F.lit(" x\n"), flat, F.lit("\n+\n"), F.reverse(flat))
    return spark.read.format("fastq").option("splitBytes", 100_000).load(_written(_named(spark, d).select(value.alias("value")), "fastq"))


@query
def fixed_width_file(spark: SparkSession, d: str) -> DataFrame:
    """Orders as patterns of 18 digits, written in their order by the data source and read back by places."""
    formats.register(spark)
    path = scratch(spark, "fixed-width")
    digits = F.concat(*(F.lpad(F.col(c).cast("string"), 9, "0") for c in ("o_orderkey", "o_custkey")))
    rows = table(spark, d, "orders").select(digits.alias("pattern"))
    rows = rows.repartitionByRange("pattern").sortWithinPartitions("pattern")
    rows.write.format("fixed_width").option("length", 18).mode("append").save(path)
    return spark.read.format("fixed_width").option("splitBytes", 1_000_000).load(path)


@query
def reads_window(spark: SparkSession, d: str) -> DataFrame:
    """Fifty reads after the first twenty, each with the quality on the line after it."""
    flat = F.translate("text", "\n", " ")
    lines = _named(spark, d).orderBy("conv_id", "turn").select(F.concat(flat, F.lit("\n"), F.reverse(flat)).alias("value"))
    path = _written(lines, "reads")
    return readers.read_reads(spark, path, path, skip=20, limit=50)


@query
def lower_lines(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_lines(spark, _written(table(spark, d, "conversations").select(F.col("text").alias("value")), "lines"), lower=True)


@query
def run_map_lines(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' nations as a run map: the line number is the run, what stands there its sample."""
    lines = table(spark, d, "supplier").orderBy("s_suppkey").select(F.col("s_nationkey").cast("string").alias("value"))
    return readers.read_run_map(spark, _written(lines, "run-map"))


@query
def pattern_file(spark: SparkSession, d: str) -> DataFrame:
    lines = _patterns(spark, d).select(F.concat(F.col("weight").cast("string"), F.lit("\t"), "pattern").alias("value"))
    return readers.read_patterns(spark, _written(lines, "patterns"), tab=True)


@query
def null_separated(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "collection")
    table(spark, d, "conversations").select("text").write.option("lineSep", "\0").text(path)
    return readers.read_null_separated(spark, path)


@query
def sample_names(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "supplier").select(F.concat("s_name", F.lit("\t"), F.col("s_nationkey").cast("string"), F.lit("\n")).alias("value"))
    return readers.read_samples(spark, _written(lines, "names"))


@query
def size_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "supplier").select(F.concat("s_name", F.lit("\t"), F.col("s_acctbal").cast("string")).alias("value"))
    return readers.read_sizes(spark, _written(lines, "sizes"))


@query
def strain_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Line items as an alignment of three strains, the third with gaps."""
    third = F.when(F.col("l_linenumber") % 3 == 0, "-").otherwise(F.lower("l_returnflag"))
    lines = table(spark, d, "lineitem").select(*ITEM, F.concat_ws(" ", "l_returnflag", "l_linestatus", third).alias("line"))
    return readers.strain_texts(lines, ITEM, "line")


@query
def library_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", seq.library_name(F.col("url")).alias("name"))


@query
def events_by_time(spark: SparkSession, d: str) -> DataFrame:
    """Events numbered in the order of their times."""
    return with_running(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], "nth").select("event_id", "nth")


@query
def minfreq_rows(spark: SparkSession, d: str) -> DataFrame:
    runs = _counts(spark, d).withColumnRenamed("sample", "run")
    return matrices.to_samples(runs, _dims(spark, d).select(F.col("sample").alias("run"), "sample"), 3)


@query
def step_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """How many rows thresholds at steps of 0.07 hold."""
    limits = F.explode(F.array(*[F.lit(x) for x in matrices.thresholds_by_step(0.07)])).alias("max_entropy")
    got = _entropies(spark, d).select("entropy", limits).groupBy("max_entropy")
    return got.agg(F.sum((F.col("entropy") <= F.col("max_entropy")).cast("long")).alias("n_rows")).select(F.round("max_entropy", 6).alias("max_entropy"), "n_rows")


@query
def matrix_file(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the count matrices' file."""
    return matrices.matrix_lines(_pairs(spark, d), threshold_rows(spark, d), "count")


@query
def norm_matrices(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "events").groupBy(F.col("event_type").alias("sample")).agg(F.avg("value").alias("size"))
    rows = matrices.size_normalised(_counts(spark, d), sizes)
    got = matrices.pair_matrices(rows, _entropies(spark, d), list(LIMITS), _dims(spark, d))
    return got.select("max_entropy", "s", "t", F.round("log_d", 6).alias("log_d"), F.round("sqrt_d", 6).alias("sqrt_d"))


@query
def incremental_nodes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("sample"), seq.dense(F.col("text")).alias("seq"))
    parts = [mining.nodes(docs.where(F.col("doc_id") % 2 == k).select("sample", "seq"), 1, DEPTH) for k in (0, 1)]
    return mining.add_up(parts[0].unionByName(parts[1]), FMIN)


@query
def value_before(spark: SparkSession, d: str) -> DataFrame:
    got = ranks.value_before(stored(_bits(spark, d).select("pos", "bit", "rank1"), "bits"))
    return got.select("pos", F.coalesce("last_one", F.lit(-1)).alias("last_one"))


@query
def inverse_suffix_array(spark: SparkSession, d: str) -> DataFrame:
    """The rank of every place of all texts laid end to end, each with its end."""
    return ranks.inverse(_suffixes(spark, d, []).select("sa_rank", F.col("g").alias("value")), "sa_rank", "value")


@query
def merged_suffix_rank(spark: SparkSession, d: str) -> DataFrame:
    """The order of all suffixes and its transform, when the later half of the conversations is merged into the written order
    of the earlier half."""
    talk = _talk(spark, d)
    half = talk.agg(F.expr("percentile(conv_id, 0.5)")).first()[0]
    early = F.coalesce(F.col("conv_id") <= half, F.lit(True))  # nulls come first
    order, named = suffixes.named_order(talk.where(early), TURN, kept=[])
    order, named = suffixes.merged_order(stored(order.select("g", "sa_rank"), "suffix-order"), named, talk.where(~early), TURN, kept=["before"])
    return suffixes.with_keys(order.select("tid", "g", "sa_rank", F.col("before").alias("symbol")), named, TURN)


@query
def sized_parts(spark: SparkSession, d: str) -> DataFrame:
    size = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("size"))
    got = with_running(size, ["doc_id"], "nth", {"upto": F.col("size")})
    return got.select("doc_id", F.floor((F.col("upto") - F.col("size")) / 100_000).alias("part"))


@query
def top_paths(spark: SparkSession, d: str) -> DataFrame:
    """The hundred most frequent mined substrings."""
    return _mined(spark, d).orderBy(F.desc("total_freq"), "path").limit(100).select("path", "total_freq")


@query
def integer_logs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", seq.bit_length(n).alias("bits"), seq.floor_log2(n).alias("low"), seq.ceil_log2(n).alias("high"), seq.next_multiple(n, 16).alias("multiple"))


@query
def pattern_trim(spark: SparkSession, d: str) -> DataFrame:
    cut = seq.trimmed(seq.normalize(F.col("text")), 20)
    return table(spark, d, "benchmark").select("item_id", cut.alias("pattern"), seq.reverse_complement(cut).alias("reversed"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    ref = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return _occurrences(spark, d).select("pattern", "pos", ref.alias("ref"), F.length("pattern").alias("width"))


@query
def tab_rows(spark: SparkSession, d: str) -> DataFrame:
    found = _placed(spark, d).withColumn("strand", F.lit("F"))
    return found.select("pattern", "ref", "pos", alignment.tab_line("pattern", "ref", "pos", "width", "strand").alias("line"))


@query
def sam_rows(spark: SparkSession, d: str) -> DataFrame:
    found = _placed(spark, d).withColumn("cigar", F.concat(F.col("width").cast("string"), F.lit("M"))).withColumn("reverse", F.lit(False))
    return found.select("pattern", "ref", "pos", alignment.sam_line("pattern", "ref", "pos", "cigar", "pattern", "reverse").alias("line"))


@query
def sequence_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """The suffix array of each conversation turn by itself."""
    return suffixes.own_orders(_talk(spark, d), TURN)


@query
def weighted_positions(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("weight"))
    return ranks.systematic_positions(weights, ["doc_id"], "weight", 100)
