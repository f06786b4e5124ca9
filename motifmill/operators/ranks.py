"""Rank, select and range questions on bit and symbol sequences kept as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import as_of, stored, with_running


def bit_ranks(rows: DataFrame, order: list[str], bit: Column) -> DataFrame:
    """rows plus pos, bit, and rank1, rank0: ones and zeros up to the row, itself included."""
    got = with_running(rows.withColumn("bit", bit.cast("int")), order, "pos", {"rank1": F.col("bit")})
    return got.withColumn("rank0", F.col("pos") + 1 - F.col("rank1"))


def select_bits(ranked: DataFrame, bit: int = 1) -> DataFrame:
    """(k, pos): the position of the k-th one (or zero)."""
    return ranked.where(F.col("bit") == bit).select(F.col(f"rank{bit}").alias("k"), "pos")


def select_next(ranked: DataFrame, bit: int = 1) -> DataFrame:
    """(pos, next): the first one (or zero) at or after each position, null if there is none: a join on its number."""
    there = select_bits(ranked, bit).withColumnRenamed("pos", "next")
    own = (F.col("bit") == bit).cast("int")
    return ranked.select("pos", (F.col(f"rank{bit}") - own + 1).alias("k")).hint("merge").join(there, "k", "left").select("pos", "next")


def symbol_ranks(rows: DataFrame, order: list[str], symbol: str) -> DataFrame:
    """rows plus pos, their place in the whole sequence, and sym_rank: occurrences of the row's symbol up to it.

    A second order, by symbol and place, gives the rank: a row's place in it less where its symbol begins."""
    placed = stored(with_running(rows, order, "pos"), "sequence")
    sorted_ = stored(with_running(placed, [symbol, "pos"], "nth"), "by-symbol")
    first = sorted_.groupBy(symbol).agg(F.min("nth").alias("first"))
    return sorted_.join(first, symbol).withColumn("sym_rank", F.col("nth") - F.col("first") + 1).drop("nth", "first")


def symbol_next(ranked: DataFrame, symbol: str) -> DataFrame:
    """(pos, next): from each place the next one with the same symbol, null for its last."""
    after = ranked.select(symbol, (F.col("sym_rank") - 1).alias("sym_rank"), F.col("pos").alias("next"))
    return ranked.select("pos", symbol, "sym_rank").hint("merge").join(after, [symbol, "sym_rank"], "left").select("pos", "next")


def prefix_ranks(rows: DataFrame, order: list[str], symbol: str, symbols: list) -> DataFrame:
    """rows plus pos and below: how many rows up to each one have a smaller symbol. symbols: a small alphabet."""
    named = {f"upto_{k}": F.when(F.col(symbol) == x, 1).otherwise(0) for k, x in enumerate(sorted(symbols))}
    got = with_running(rows, order, "pos", named)
    below = sum((F.when(F.col(symbol) > x, F.col(f"upto_{k}")).otherwise(0) for k, x in enumerate(sorted(symbols))), F.lit(0))
    return got.withColumn("below", below).drop(*named)


def largest_up_to(rows: DataFrame, order: list[str], symbol: str, most: int, symbols: list) -> DataFrame:
    """rows plus pos and largest: the largest symbol <= most among all rows up to this one, null if there is none, and
    its rank: how many rows up to this one have it. symbols: a small alphabet."""
    held = [x for x in sorted(symbols) if x <= most]
    named = {f"upto_{k}": F.when(F.col(symbol) == x, 1).otherwise(0) for k, x in enumerate(held)}
    got = with_running(rows, order, "pos", named)
    pick = lambda value: F.coalesce(*(F.when(F.col(f"upto_{k}") > 0, value(k, x)) for k, x in reversed(list(enumerate(held)))), F.lit(None))
    return got.withColumn("largest", pick(lambda k, x: F.lit(x))).withColumn("rank", pick(lambda k, x: F.col(f"upto_{k}"))).drop(*named)


def run_lengths(ranked: DataFrame, symbol: str) -> DataFrame:
    """(run, symbol, first, length): the stretches of equal neighbours of a whole sequence (pos, symbol), numbered from 1.

    Sides of joins with a row for each place are shuffled here and elsewhere: written tables are far smaller as files than in
    memory, and would be judged small enough to go to all through the driver."""
    last = ranked.select((F.col("pos") + 1).alias("pos"), F.col(symbol).alias("last"))
    heads = ranked.select("pos", symbol).hint("merge").join(last, "pos", "left").where(F.col("last").isNull() | (F.col("last") != F.col(symbol))).select(F.col("pos").alias("first"), symbol)
    numbered = stored(with_running(heads, ["first"], "run").withColumn("run", F.col("run") + 1), "runs")
    end = ranked.agg(F.max("pos") + 1).first()[0]
    after = numbered.select((F.col("run") - 1).alias("run"), F.col("first").alias("end"))
    return numbered.hint("merge").join(after, "run", "left").select("run", symbol, "first", (F.coalesce("end", F.lit(end)) - F.col("first")).alias("length"))


def in_range(rows: DataFrame, pos: str, low: int, high: int, symbol: str, least: int, most: int) -> DataFrame:
    """The rows in a range of positions and of symbols."""
    return rows.where(F.col(pos).between(low, high) & F.col(symbol).between(least, most))


def rectangle_counts(placed: DataFrame, symbol: str, rectangles: DataFrame, fan: int = 16) -> DataFrame:
    """(name, n): how many places of a whole sequence lie in each rectangle, low <= pos <= high and least <= symbol <= most.

    placed: pos (0, 1, ... without gaps) and a symbol of any alphabet; rectangles: name, low, high, least, most. A rectangle is
    a sum of four corners, the places before a position with symbols up to a value. A corner's positions are blocks of fan^k
    places, at most fan - 1 of each size. All blocks of all sizes are sorted once by their symbols, corners among
    them: a corner counts the rows before it in its block, and how many come before a block is known from its number. Rows are
    multiplied by the number of sizes, the logarithm of the sequence's length, whatever the number of rectangles. An empty
    rectangle, and one with a null side, has none."""
    n = placed.count()
    levels = 1
    while fan**levels < n:
        levels += 1
    sizes = F.array(*[F.lit(fan**k).cast("long") for k in range(levels + 1)])
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    rows = placed.select(level, "pos", F.col(symbol).alias("symbol"))
    kind = placed.schema[symbol].dataType
    # a block's number among those of all sizes
    nth_block = lambda block: (F.shiftleft(F.col("level").cast("long"), 56) + block).alias("block")
    rows = rows.select(nth_block(F.floor(F.col("pos") / sizes[F.col("level")])), "symbol", F.lit(0).alias("kind"), F.lit(None).cast(rectangles.schema["name"].dataType).alias("name"), F.lit(0).alias("sign"))
    clipped = rectangles.where("low <= high and least <= most").select("name", F.least(F.greatest(F.col("low"), F.lit(0)), F.lit(n)).cast("long").alias("low"), F.least(F.greatest(F.col("high") + 1, F.lit(0)), F.lit(n)).cast("long").alias("high"), "least", "most")
    # symbols below the least: the corner stands before the rows that have it
    corner = lambda x, y, kind_, sign: F.struct(F.col(x).alias("end"), F.col(y).cast(kind).alias("symbol"), F.lit(kind_).alias("kind"), F.lit(sign).alias("sign"))
    corners = clipped.select("name", F.explode(F.array(corner("high", "most", 1, 1), corner("low", "most", 1, -1), corner("high", "least", -1, -1), corner("low", "least", -1, 1))).alias("c"))
    corners = corners.where("c.end > 0").select("name", "c.*", level)
    size = sizes[F.col("level")]
    digit = F.floor(F.col("end") / size) % fan
    blocks = corners.where(digit > 0).select("name", "symbol", "kind", "sign", "level", F.explode(F.sequence(F.floor(F.col("end") / size) - digit, F.floor(F.col("end") / size) - 1)).alias("block"))
    asked = blocks.select(nth_block(F.col("block")), "symbol", "kind", "name", "sign")
    # of the rows before a corner those are no corners that are not before it among the corners alone
    got = with_running(rows.unionByName(asked), ["block", "symbol", "kind"], "nth").where("kind <> 0")
    got = with_running(got, ["nth"], "corner").withColumn("upto", F.col("nth") - F.col("corner")).withColumn("level", F.shiftright("block", 56).cast("int"))
    before = F.col("level") * n + F.col("block").bitwiseAND(F.lit((1 << 56) - 1)) * size
    counts = got.groupBy("name").agg(F.sum(F.col("sign") * (F.col("upto") - before)).alias("n"))
    return rectangles.select("name").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def symbol_at(points: DataFrame, counts: DataFrame, rank: str) -> DataFrame:
    """points with symbol, the one that stands at a rank (from 0) of all symbols in order; null beyond the last.

    counts: symbol_counts()."""
    got = as_of(points, counts.select(F.col("below").alias(rank), "symbol", (F.col("below") + F.col("n")).alias("end")), rank, ["symbol", "end"])
    return got.select(*points.columns, F.when(F.col(rank) < F.col("found.end"), F.col("found.symbol")).alias("symbol"))


def runs(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """(group, n_runs): stretches of equal neighbouring values in each group."""
    last = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    return rows.withColumn("new", (last.isNull() | (last != F.col(value))).cast("int")).groupBy(*group).agg(F.sum("new").alias("n_runs"))


def symbol_counts(rows: DataFrame, symbol: str) -> DataFrame:
    """(symbol, n, below): how often each symbol is there, and how many symbols are smaller. One row a symbol."""
    counts = rows.groupBy(F.col(symbol).alias("symbol")).agg(F.count("*").alias("n"))
    return with_running(counts, ["symbol"], "nth", {"upto": F.col("n")}).select("symbol", "n", (F.col("upto") - F.col("n")).alias("below"))


def greedy_samples(rows: DataFrame, rate: int, share: float) -> DataFrame:
    """rows (pos, weight) chosen as samples: every k-th position, then the heaviest others up to one in `rate`.

    share is the part of the samples that goes by weight; equal weights take the larger position, weight 0 none."""
    n = rows.count()
    want = -(-n // rate)
    step = n if share >= 1 else max(1, int(min(n, rate / (1 - share))))
    regular = rows.where(F.col("pos") % step == 0)
    left = max(0, want - regular.count())
    heavy = rows.where((F.col("pos") % step != 0) & (F.col("weight") > 0)).select("*", (-F.col("weight")).alias("by"), (-F.col("pos")).alias("then"))
    heavy = with_running(heavy, ["by", "then"], "nth").where(F.col("nth") < left).drop("by", "then", "nth")
    return regular.withColumn("regular", F.lit(True)).unionByName(heavy.withColumn("regular", F.lit(False)))


def value_before(ranked: DataFrame) -> DataFrame:
    """(pos, last_one): the last one at or before each position, null if there is none: a join on the one's number."""
    ones = select_bits(ranked).withColumnRenamed("pos", "last_one")
    return ranked.select("pos", F.col("rank1").alias("k")).hint("merge").join(ones, "k", "left").select("pos", "last_one")


def inverse(permutation: DataFrame, index: str, value: str) -> DataFrame:
    """(value, index): the inverse of a permutation is its columns' exchange."""
    return permutation.select(F.col(value).alias(index), F.col(index).alias(value))


def systematic_positions(rows: DataFrame, order: list[str], weight: str, draws: int) -> DataFrame:
    """(draw, order): rows drawn in proportion to a whole-number weight, at evenly spaced points of the running weight."""
    got = with_running(rows, order, "nth", {"upto": F.col(weight).cast("long")})
    total = rows.agg(F.coalesce(F.sum(F.col(weight).cast("long")), F.lit(0))).first()[0]
    # draw k takes the row where the running weight first reaches (2 k + 1) / (2 draws) of the total; whole numbers throughout
    reached = lambda upto: F.call_function("div", 2 * draws * upto + total, F.lit(2 * total).cast("long")) - 1
    placed = got.where(F.col(weight) > 0).select((reached(F.col("upto") - F.col(weight)) + 1).alias("first"), reached(F.col("upto")).alias("last"), *order)
    return placed.where("first <= last").select(F.explode(F.sequence("first", "last")).alias("draw"), *order)


def _mixed(x: Column) -> Column:
    """A number below 2^32, scrambled."""
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftrightunsigned(x, 16)) * 73_244_475) % (1 << 32)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 16))


def random_draws(rows: DataFrame, order: list[str], weight: str, draws: int, seed: int) -> DataFrame:
    """(draw, order): rows drawn with replacement in proportion to a whole-number weight, the same for the same seed.

    A draw is a point of the running weight below its total (which must be below 2^31), looked up as the last row that begins at
    or before it. Rows of weight 0 are never drawn; without any weight there is no draw."""
    placed = stored(with_running(rows.where(F.col(weight) > 0), order, "nth", {"upto": F.col(weight)}), "weights")
    total = placed.agg(F.max("upto")).first()[0] or 0
    spot = F.shiftrightunsigned(_mixed(((F.col("id") + 1) * 2_654_435_761 + seed) % (1 << 32)) * total, 32)
    points = rows.sparkSession.range(draws if total else 0).select(F.col("id").alias("draw"), spot.alias("at"))
    got = as_of(points, placed.select((F.col("upto") - F.col(weight)).alias("at"), *order), "at", order)
    return got.select("draw", *(F.col("found")[c].alias(c) for c in order))
