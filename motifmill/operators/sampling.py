"""Optimal samples: the k places of a sequence from which all weighted places are reached most cheaply going forward.

A place costs its weight times its distance from the sample at or before it; place 0 is always a sample. The k samples of
least cost are a path of k links whose costs fulfil the quadrangle inequality, so a price for each link makes the cheapest path
have as many links as wanted. For one price, a place's cheapest beginning is the lowest of the lines that the samples before it
lay over the running weight: slopes fall with the place, so a queue of candidates finds it.

Places are cut into blocks. A block begins with the lines that the one before hands on. All blocks are worked side by side with
a guess first, the lines that the last places of the block before make by themselves; blocks and prices whose guess was wrong are
worked again. A block's lines relative to its first one don't depend on what is far before it, so these are few; when nothing
changes the result is exact. A path is told by its legs, the stretches within a block, from one row a block and line handed on."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import stored, with_running

#: Places in a block.
BLOCK_PLACES = 1 << 14
#: Places of the block before from which a block's first lines are guessed.
RUN_UP = 1 << 10
#: Prices of a link that are tried in one pass over the places.
PRICES = 15


def _nodes(rows: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Places that may be samples, numbered, with the weight and the moment (weight times place) before each; and how many.

    Place 0 comes first, with weight 0 if it has no row; an end behind the last place comes last."""
    size = rows.agg(F.max("pos") + 1).first()[0]
    ends = rows.sparkSession.createDataFrame([(0, 0), (size, 0)], "pos long, weight long")
    own = rows.where("weight > 0").select(F.col("pos").cast("long").alias("pos"), F.col("weight").cast("long").alias("weight")).unionByName(ends)
    own = own.groupBy("pos").agg(F.sum("weight").cast("long").alias("weight"))
    moment = F.col("weight").cast("decimal(19,0)") * F.col("pos").cast("decimal(19,0)")
    got = with_running(own, ["pos"], "nth", {"upto": F.col("weight"), "moment": moment})
    got = got.select(F.floor(F.col("nth") / block).alias("block"), "nth", "pos", "weight", (F.col("upto") - F.col("weight")).alias("upto"), (F.col("moment") - moment).cast("decimal(38,0)").alias("moment"))
    got = stored(got, "places")
    return got, got.count()


def _advance(nodes: list[tuple], lines: list[list[int]], scale: int, price: int, path: list | None = None) -> tuple[list[list[int]], int]:
    """Lines (pos, height, nth) after a block's places, and the cost of the last one, from those before it. path takes the
    number of the place before each."""
    queue, cost = deque(lines), 0
    for nth, pos, weight, upto, moment in nodes:
        if nth:
            while len(queue) > 1 and queue[1][1] - scale * queue[1][0] * upto <= queue[0][1] - scale * queue[0][0] * upto:
                queue.popleft()
            cost = scale * moment + price + queue[0][1] - scale * queue[0][0] * upto
            if path is not None:
                path.append((nth, queue[0][2]))
        height = cost + scale * (pos * upto - moment)
        # the last line goes if the new one is as low where it meets the line before it
        while len(queue) > 1:
            (p0, h0, _), (p1, h1, _) = queue[-2], queue[-1]
            if (h1 - h0) * (pos - p1) < (height - h1) * (p1 - p0):
                break
            queue.pop()
        queue.append([pos, height, nth])
    following = nodes[-1][3] + nodes[-1][2]
    while len(queue) > 1 and queue[1][1] - scale * queue[1][0] * following <= queue[0][1] - scale * queue[0][0] * following:
        queue.popleft()
    return list(queue), cost


def _listed(places: pd.DataFrame) -> list[tuple]:
    places = places.sort_values("nth")
    return [(int(a), int(b), int(c), int(d), int(e)) for a, b, c, d, e in zip(places.nth, places.pos, places.weight, places.upto, places.moment, strict=True)]


def _relative(lines: list[list[int]]) -> list[list[int]]:
    return [[p, h - lines[0][1], n] for p, h, n in lines]


def _block(prices: list[int], scale: int, size: int) -> Callable:
    """For each price: the lines that a block of `size` places began with (taken), those it hands on, how far these lie above
    (gain), and the cost of its last place. Without lines handed to it, a block begins with those of the places before it that are
    among its rows, for all prices; else only prices with lines are worked."""

    def run(places: pd.DataFrame, handed: pd.DataFrame | None = None) -> pd.DataFrame:
        nodes, block = _listed(places), int(places.block.iloc[0])
        before = [x for x in nodes if x[0] < block * size]
        nodes = nodes[len(before) :]
        given = dict(zip(handed.price, handed.lines, strict=True)) if handed is not None else {}
        rows = []
        for price in map(int, given) if given else prices:
            if given:
                taken = json.loads(given[str(price)])
            elif not before:
                taken = []
            else:
                nth, pos = before[0][:2]
                taken = _relative(_advance(before[1:], [[pos, 0, nth]], scale, price)[0]) if len(before) > 1 else [[pos, 0, nth]]
            lines, cost = _advance(nodes, taken, scale, price)
            rows.append((block, str(price), json.dumps(taken), json.dumps(_relative(lines)), str(lines[0][1]), str(cost)))
        return pd.DataFrame(rows, columns=["block", "price", "taken", "lines", "gain", "cost"])

    return run


RESULT = "block long, price string, taken string, lines string, gain string, cost string"


def _settled(nodes: DataFrame, prices: list[int], scale: int, size: int, blocks: int) -> DataFrame:
    """_block() of every block with the lines that the block before it hands on."""
    first = nodes.where((F.col("nth") % size >= max(size - RUN_UP, 0)) & (F.col("block") < blocks - 1)).withColumn("block", F.col("block") + 1)
    # a block is a fixed number of places, so a group is bounded
    work = _block(prices, scale, size)
    got = stored(nodes.unionByName(first).groupBy("block").applyInPandas(lambda places: work(places), RESULT), "lines")
    # a round settles at least one more block
    while True:
        handed = got.select((F.col("block") + 1).alias("block"), "price", "lines")
        wrong = got.join(handed.withColumnRenamed("lines", "given"), ["block", "price"]).where("taken <> given").select("block", "price")
        wrong = stored(wrong, "wrong")
        if wrong.isEmpty():
            return got
        own, lines = nodes.join(wrong.select("block").distinct(), "block"), handed.join(wrong, ["block", "price"])
        again = own.groupBy("block").cogroup(lines.groupBy("block")).applyInPandas(lambda places, handed: work(places, handed), RESULT)
        got = stored(got.join(wrong, ["block", "price"], "left_anti").unionByName(again), "lines")


def _costs(got: DataFrame, blocks: int) -> dict[int, int]:
    """Price to the cost of the whole path: what the blocks' lines rise by, and the last block's cost. Sums of one row a block."""
    number = lambda c: F.col(c).cast("decimal(38,0)")
    part = F.when(F.col("block") < blocks - 1, number("gain")).otherwise(number("cost"))
    return {int(r["price"]): int(r["total"]) for r in got.groupBy("price").agg(F.sum(part).alias("total")).collect()}


def _backs(places: pd.DataFrame, taken: str, price: int, scale: int) -> tuple[int, dict[int, int]]:
    """A block's first place, and the place before each of its places on its cheapest path."""
    path: list[tuple[int, int]] = []
    _advance(_listed(places), json.loads(taken), scale, price, path)
    return int(places.nth.min()), dict(path)


def _leg(at: int, first: int, back: dict[int, int]) -> list[int]:
    """The places from `at` back to the last one outside the block, or to 0."""
    out = [at]
    while at >= first and at:
        at = back[at]
        out.append(at)
    return out


def _legs(price: int, scale: int) -> Callable:
    """(entry, outside, links): where the path leaves a block, for each of its places that a later block may go back to."""

    def run(places: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        first, back = _backs(places, got.taken.iloc[0], price, scale)
        legs = [_leg(nth, first, back) for _, _, nth in json.loads(got.lines.iloc[0]) if nth >= first]
        return pd.DataFrame([(leg[0], leg[-1], len(leg) - 1) for leg in legs], columns=["entry", "outside", "links"])

    return run


def _places(price: int, scale: int, most: int) -> Callable:
    """(link, nth): the places of the legs from given entries, whose steps count from the path's end."""

    def run(places: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int]] = []
        if len(got):
            first, back = _backs(places, got.taken.iloc[0], price, scale)
            for entry, steps in zip(got.entry.tolist(), got.steps.tolist(), strict=True):
                leg = _leg(entry, first, back)
                rows += [(most - steps - k, nth) for k, nth in enumerate(leg[:-1] if entry else leg)]
        return pd.DataFrame(rows, columns=["link", "nth"], dtype="int64")

    return run


def _path(nodes: DataFrame, got: DataFrame, price: int, scale: int, size: int, n: int) -> DataFrame:
    """(link, nth): the places of the cheapest path for a price, from 0; the end has the last link.

    Only the legs' ends are put together, a few rows a block."""
    own, got = nodes.groupBy("block"), got.where(F.col("price") == str(price)).select("block", "taken", "lines")
    legs = own.cogroup(got.groupBy("block")).applyInPandas(_legs(price, scale), "entry long, outside long, links long")
    ends = {r["entry"]: (r["outside"], r["links"]) for r in legs.collect()}
    at, steps = n - 1, 0
    starts = [(at // size, at, 0)]
    while at:
        at, links = ends[at]
        steps += links
        starts.append((at // size, at, steps))
    begun = got.join(F.broadcast(nodes.sparkSession.createDataFrame(starts, "block long, entry long, steps long")), "block")
    return stored(own.cogroup(begun.groupBy("block")).applyInPandas(_places(price, scale, steps), "link long, nth long"), "path")


def _between(low: int, high: int) -> list[int]:
    """Prices between two others: at even distances, or at even ratios if one is several times the other."""
    far, first = high > 4 * (low + 1), max(low, 1)
    steps = [k / (PRICES + 1) for k in range(1, PRICES + 1)]
    return sorted({p for p in (int(first * (high / first) ** x) if far else low + int((high - low) * x) for x in steps) if low < p < high} or {low + 1})


def optimal_samples(rows: DataFrame, rate: int, block: int = BLOCK_PLACES) -> DataFrame:
    """(pos): the samples of least cost, one in `rate` of the places, or every place with a weight (and place 0) if these are fewer.

    rows: pos (0 or more, once each) and a whole-number weight; places without a row, and null or negative weights, weigh
    nothing and are not chosen. An empty table has no samples."""
    rows = rows.where("pos is not null")
    size = rows.agg(F.max("pos")).first()[0]
    if size is None:
        return rows.select(F.col("pos").cast("long").alias("pos"))
    nodes, n = _nodes(rows, block)
    links = min(-(-(size + 1) // rate), n - 1)
    blocks = -(-n // block)
    # costs count in units of `scale`, and a link costs one unit less or more: ties go to the longest, the shortest path
    scale = 2 * n
    total = nodes.agg(F.max("upto")).first()[0]
    low, high = 1, total * (size + 1) + 1  # prices with enough links on the longest path, with too few
    if links == n - 1:
        return nodes.where(F.col("nth") < n - 1).select("pos")
    tried = sorted({max(1, total * rate * rate * k // (16 * (size + 1))) for k in range(1, PRICES + 1)})  # around the price if all weighed the same
    # links change only at whole prices, so the greatest price whose longest path has enough links has a shortest one with too few
    # or as many: the search needs the longest paths alone
    while high - low > 1:
        tried = [p for p in tried if low < p < high] or _between(low, high)
        cost = _costs(_settled(nodes, [scale * p - 1 for p in tried], scale, block, blocks), blocks)
        longest = {p: -cost[scale * p - 1] % scale for p in tried}
        low = max([low, *(p for p in tried if longest[p] >= links)])
        high = min([high, *(p for p in tried if longest[p] < links)])
        tried = []
    got = _settled(nodes, [scale * low - 1, scale * low + 1], scale, block, blocks)
    long, short = (_path(nodes, got, scale * low + s, scale, block, n) for s in (-1, 1))
    extra = -_costs(got, blocks)[scale * low - 1] % scale - links
    # where a link of the shorter path spans one of the longer path, the beginning of one goes on as the end of the other
    a = long.select((F.col("link") - extra).alias("link"), F.col("nth").alias("a")).join(long.select((F.col("link") - extra - 1).alias("link"), F.col("nth").alias("a2")), "link")
    b = short.select("link", F.col("nth").alias("b")).join(short.select((F.col("link") - 1).alias("link"), F.col("nth").alias("b2")), "link")
    cut = a.join(b, "link").where("b <= a and a2 <= b2").agg(F.min("link")).first()[0]
    chosen = short.where(F.col("link") <= cut).unionByName(long.where(F.col("link") > cut + extra)).where(F.col("nth") < n - 1)
    return nodes.join(chosen, "nth").select("pos")
