"""The suffix tree's inner nodes as intervals of common prefixes, and the graph of nodes and documents.

The order of the suffixes is cut into ranges of equal size. A range's nodes are found by a stack in one pass over its
common prefixes; what is open where a range begins is known from the ranges before it: each tells the least common prefix
it holds and the nodes that are open at its end, as many as the longest of them has beginnings that branch. Documents are
counted in the same pass: a node has as many as it has suffixes, less the pairs of neighbouring suffixes of one document
whose deepest common node is in it."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import stored, with_last, with_running
from .suffixes import common_prefixes, named_order, numbered, ordered, suffix_rows

#: Suffixes in a range, about, where there are more than the session's shuffle partitions can take.
RANGE_ROWS = 4_000_000
#: Suffixes in a block whose documents are listed at a time.
BLOCK_ROWS = 1 << 14
#: Digits that a sample's number is written with.
LEAD = 8


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: its least common prefix and the nodes (depth, first) open at its end, the first of them without first."""
    stack: list[tuple[int, int]] = []
    part, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ats, lcps = batch.column("sa_rank").to_pylist(), batch.column("lcp").to_pylist()
        part, last = batch.column("part")[0].as_py(), (batch.column("tid")[-1].as_py(), batch.column("pos")[-1].as_py())
        for at, lcp in zip(ats, lcps, strict=True):
            first = at - 1
            while stack and stack[-1][0] > lcp:
                first = stack.pop()[1]
            if not stack or stack[-1][0] < lcp:
                stack.append((lcp, first))
    if part is not None:
        depth, first = zip(*stack, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([list(depth)], pa.list_(pa.int64())), pa.array([list(first)], pa.list_(pa.int64())), pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["part", "depth", "first", "tid", "pos"])


def _begun(ends: list, size: int) -> dict[int, tuple[list[tuple[int, int]], tuple[int, int]]]:
    """(nodes open where a range begins, the last suffix before it) of each range."""
    stack, last, out = [(0, 0)], (0, 0), {}
    for r in sorted(ends, key=lambda r: r["part"]):
        out[r["part"]] = (list(stack), last)
        least, first = r["depth"][0], r["part"] * size - 1
        while stack and stack[-1][0] > least:
            first = stack.pop()[1]
        if not stack or stack[-1][0] < least:
            stack.append((least, first))
        stack += list(zip(r["depth"][1:], r["first"][1:], strict=True))
        last = (r["tid"], r["pos"])
    return out


def _carried(ends: list, opened: list, size: int) -> list[tuple]:
    """(part, depths, twice): what the ranges before have counted of the nodes that are open where a range begins.

    opened: (part, depth, first, twice) of the nodes that are open at a range's end, counted in that range alone."""
    counted: dict[int, dict] = {}
    for r in opened:
        counted.setdefault(r["part"], {})[r["depth"], r["first"]] = r["twice"]
    stack: list[tuple[int, int, int]] = [(0, 0, 0)]
    out = []
    for r in sorted(ends, key=lambda r: r["part"]):
        out.append((r["part"], [d for d, _, _ in stack], [n for _, _, n in stack]))
        least, first, ended = r["depth"][0], r["part"] * size - 1, 0
        while stack and stack[-1][0] > least:
            _, first, n = stack.pop()
            ended += n
        if not stack or stack[-1][0] < least:
            stack.append((least, first, 0))
        stack[-1] = (*stack[-1][:2], stack[-1][2] + ended)  # what has ended counts for the node above it
        stack += [(d, f, 0) for d, f in zip(r["depth"][1:], r["first"][1:], strict=True)]
        own = counted.get(r["part"], {})
        stack = [(d, f, n + own.get((d, f), 0)) for d, f, n in stack]
    return out


def _walk(begun, final: int) -> Callable:
    """Rows of a sorted range to nodes: those that end in it, and what has been counted of those that go on."""
    names = ["part", "depth", "first", "last", "twice", "up_depth", "up_first", "tid", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth: list[int] | None = None
        first: list[int] = []
        twice: list[int] = []
        out: list[tuple] = []
        part = 0

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * (len(names) - 1)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(out), part, np.int32)), *(pa.array(c, pa.int64()) for c in columns)], names)

        def close(at: int, lcp: int) -> None:
            """Ends the nodes deeper than lcp before the suffix at `at`."""
            begin = at - 1
            while depth and depth[-1] > lcp:
                d, begin, n = depth.pop(), first.pop(), twice.pop()
                if depth and depth[-1] >= lcp:
                    up = depth[-1], first[-1]
                    twice[-1] += n
                    out.append((d, begin, at - 1, n, *up, *last))
                elif lcp >= 0:
                    out.append((d, begin, at - 1, n, lcp, begin, *last))
                    depth.append(lcp)
                    first.append(begin)
                    twice.append(n)
                else:
                    out.append((d, begin, at - 1, n, None, None, *last))
            if lcp >= 0 and (not depth or depth[-1] < lcp):
                depth.append(lcp)
                first.append(begin)
                twice.append(0)

        at = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if depth is None:
                part = batch.column("part")[0].as_py()
                stack, last = begun.value[part]
                depth, first, twice = [d for d, _ in stack], [f for _, f in stack], [0] * len(stack)
            for at, lcp, before, tid, pos in zip(*(batch.column(c).to_pylist() for c in ("sa_rank", "lcp", "before", "tid", "pos")), strict=True):
                if at:
                    close(at, lcp)
                if before is not None:
                    twice[bisect_right(first, before) - 1] += 1
                last = (tid, pos)
            if len(out) > 50_000:
                yield made()
                out.clear()
        if at is not None:
            if at + 1 == final:
                close(final, -1)
            else:
                out += [(d, f, None, n, None, None, None, None) for d, f, n in zip(depth, first, twice, strict=True)]
        yield made()

    return run


def with_before(rows: DataFrame) -> DataFrame:
    """(doc, sa_rank, lcp, tid, pos) with before, the place of the suffix before it that is of the same document, null for the first."""
    seen = with_last(rows.select("doc", "sa_rank", "lcp", "tid", "pos"), ["doc", "sa_rank"], {"before": F.struct("doc", "sa_rank")}, strictly=True)
    return seen.withColumn("before", F.when(F.col("before.doc") == F.col("doc"), F.col("before.sa_rank")))


def nodes(rows: DataFrame, size: int | None = None) -> DataFrame:
    """(depth, first, last, n_docs, up_depth, up_first, tid, pos): the intervals first..last of suffixes that share depth
    characters and no more, the interval above each (null above the root), how many documents they are of, and the text and
    place of one of the suffixes.

    rows: sa_rank, lcp, doc, tid, pos of all suffixes, and before where with_before() has told it. A range holds `size` of them.
    Texts that end alike differ by their ends, as in the order; an empty table has no node."""
    spark = rows.sparkSession
    total = rows.count()
    size = size or max(1, -(-total // max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))))
    parts = max(1, -(-total // size))
    seen = (rows if "before" in rows.columns else with_before(rows)).select("doc", "sa_rank", "lcp", "tid", "pos", "before")
    seen = seen.withColumn("part", F.floor(F.col("sa_rank") / size).cast("int"))
    placed = stored(seen.repartitionById(parts, F.col("part")).sortWithinPartitions("sa_rank"), "prefix-ranges")
    again = lambda *c: placed.select("part", "sa_rank", "lcp", *c).repartitionById(parts, F.col("part")).sortWithinPartitions("sa_rank")
    ends = again("tid", "pos").mapInArrow(_ends, "part int, depth array<long>, first array<long>, tid long, pos long").collect()  # a row a range
    begun = spark.sparkContext.broadcast(_begun(ends, size))
    columns = ", ".join(f"{c} long" for c in ("depth", "first", "last", "twice", "up_depth", "up_first", "tid", "pos"))
    found = stored(again("before", "tid", "pos").mapInArrow(_walk(begun, total), f"part int, {columns}"), "prefix-intervals")
    opened = found.where("last is null").select("part", "depth", "first", "twice").collect()  # as many as _ends() has told
    carried = spark.createDataFrame(_carried(ends, opened, size), "part int, depths array<long>, counts array<long>")
    # a node that began in an earlier range holds the nodes at least as deep that were open where the range begins
    inside = F.filter(F.arrays_zip("depths", "counts"), lambda x: x["depths"] >= F.col("depth"))
    before = F.when(F.col("first") < F.col("part") * size, F.aggregate(inside, F.lit(0).cast("long"), lambda n, x: n + x["counts"])).otherwise(0)
    closed = found.where("last is not null").join(F.broadcast(carried), "part")
    return closed.select("depth", "first", "last", (F.col("last") - F.col("first") + 1 - F.col("twice") - before).alias("n_docs"), "up_depth", "up_first", "tid", "pos")


def document_graph(texts: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """((path, parent, n_suffixes, n_docs), (path, keys)): the inner nodes of the texts' suffix tree and the documents below each.

    A node is a string that goes on in two ways or more; each text's end is a way of its own. Nodes of at most `block`
    suffixes have no nodes below them; the root is left out. parent is the longest node that the path begins with, empty
    for the root. Where a key is called path, the edges' path is called _path."""
    order, named = named_order(texts, keys, common=True)
    rows = stored(with_before(common_prefixes(order, named).select("sa_rank", "lcp", F.col("tid").alias("doc"), "tid", "pos")), "common-prefixes")
    tree = stored(nodes(rows), "nodes")
    wide = tree.where((F.col("last") - F.col("first") + 1 > block) | (F.col("depth") == 0)).select(F.col("depth").alias("up_depth"), F.col("first").alias("up_first"))
    kept = stored(tree.where("depth > 0").hint("merge").join(wide, ["up_depth", "up_first"], "left_semi"), "kept-nodes")
    shown = kept.hint("merge").join(named.select("tid", "text"), "tid").select("depth", "first", "last", F.substring("text", (F.col("pos") + 1).cast("int"), F.col("depth").cast("int")).alias("path"), "up_depth", "n_docs")
    shown = stored(shown, "node-paths")
    out = shown.select("path", F.substring("path", F.lit(1), F.col("up_depth").cast("int")).alias("parent"), (F.col("last") - F.col("first") + 1).alias("n_suffixes"), "n_docs")
    edge = "_path" if "path" in keys else "path"
    return out, _below(rows, shown, named.select("tid", *(f"k{n}" for n in range(len(keys)))), keys, edge)


def _members(held: pa.Table, wide: pa.Table) -> pa.Table:
    """(path, k0, k1, ...) of the suffixes of a block (sa_rank, before, k0, k1, ...) that are the first of their text in a node
    (path, first, last) that the block meets."""
    held = held.sort_by("sa_rank")
    low = held.column("sa_rank")[0].as_py() if len(held) else 0
    before = held.column("before").fill_null(-1).to_numpy()
    first, last = wide.column("first").to_numpy(), wide.column("last").to_numpy()
    found, sizes = [np.zeros(0, np.int64)], np.zeros(len(wide), np.int64)
    for k, (f, begin, end) in enumerate(zip(first.tolist(), np.maximum(first - low, 0).tolist(), (last - low + 1).tolist(), strict=True)):
        found.append(np.flatnonzero(before[begin:end] < f) + begin)
        sizes[k] = len(found[-1])
    kept = held.drop_columns(["block", "sa_rank", "before"]).take(pa.array(np.concatenate(found)))
    return kept.add_column(0, "path", wide.column("path").take(pa.array(np.repeat(np.arange(len(wide)), sizes))))


def _below(rows: DataFrame, shown: DataFrame, named: DataFrame, keys: list[str], edge: str) -> DataFrame:
    """(edge, keys): the documents of each node of shown (path, first, last).

    The order is cut into blocks, and a node meets those it reaches into: at most as many reach over a block's end as nodes are
    open there. What is listed is told once for each document and node, by the document's place before; neither suffixes of
    nodes nor what is listed are shuffled."""
    block = lambda c: F.floor(F.col(c) / BLOCK_ROWS)
    held = rows.select("tid", "sa_rank", "before").hint("merge").join(named, "tid").drop("tid").withColumn("block", block("sa_rank"))
    wide = shown.select("path", "first", "last", F.explode(F.sequence(block("first"), block("last"))).alias("block"))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    names = [f"k{n}" for n in range(len(keys))]
    held = held.select("block", "sa_rank", "before", *names)
    got = held.groupBy("block").cogroup(wide.groupBy("block")).applyInArrow(_members, ", ".join(["path string", *(f"{n} {kinds[n]}" for n in names)]))
    return got.select(F.col("path").alias(edge), *(F.col(n).alias(c) for n, c in zip(names, keys, strict=True)))


def frequent_paths(texts: DataFrame, sample: str, least: int) -> DataFrame:
    """(sample, path, freq, left): every string that occurs `least` times in a sample, and the character before all of its
    occurrences (empty if none has one, null if they differ). texts: sample, text and, where it has that column, copies.

    Equal texts of a sample are one with a number of copies, so that work goes by different texts; a string has the copies of
    the suffixes that begin with it, a difference of running sums. The suffixes of each sample are ordered by themselves; the nodes of that order are the strings that branch, and the
    strings between a node and the one above have the node's occurrences. Different characters before a node are counted as
    documents are. No round for each character, and no bound of depth."""
    index = with_running(texts.select(F.col(sample).alias("name")).where("name is not null").distinct(), ["name"], "nth").select("name", F.lpad(F.hex("nth"), LEAD, "0").alias("lead"))
    copies = F.sum("copies") if "copies" in texts.columns else F.count("*")
    once = texts.where(F.col(sample).isNotNull()).groupBy(F.col(sample).alias("name"), "text").agg(copies.cast("long").alias("copies"))
    named = numbered(once, ["name", "copies"])
    named = stored(named.join(index, named.k0 == index.name).drop("name"), "sample-texts")
    order = ordered(suffix_rows(named), lead=LEAD, common=True)
    code = F.coalesce(F.ascii(F.nullif("before", F.lit(""))), F.lit(0)).cast("long").alias("doc")
    weighted = common_prefixes(order, named).select("sa_rank", "lcp", code, "tid", "pos", "left").hint("merge").join(named.select("tid", F.col("k1").alias("copies")), "tid")
    rows = stored(with_running(weighted, ["sa_rank"], "nth", {"upto": F.col("copies")}).drop("nth"), "common-prefixes")
    found = nodes(rows.select("sa_rank", "lcp", "doc", "tid", "pos")).where(F.col("depth") > 0)
    ends = rows.select(F.col("sa_rank").alias("last"), "upto")
    starts = rows.select(F.col("sa_rank").alias("first"), (F.col("upto") - F.col("copies")).alias("less"))
    found = found.hint("merge").join(ends, "last").hint("merge").join(starts, "first").select("depth", "up_depth", (F.col("upto") - F.col("less")).alias("freq"), "n_docs", "tid", "pos")
    after = rows.select((F.col("sa_rank") - 1).alias("sa_rank"), F.col("lcp").alias("next"))
    up = F.greatest("lcp", F.coalesce("next", F.lit(0)))
    # what only one suffix goes on to
    single = rows.where(F.col("copies") >= least).hint("merge").join(after, "sa_rank", "left").where(F.col("left") > up)
    found = found.unionByName(single.select(F.col("left").alias("depth"), up.alias("up_depth"), F.col("copies").alias("freq"), F.lit(1).cast("long").alias("n_docs"), "tid", "pos"))
    shown = found.where(F.col("freq") >= least).hint("merge").join(named.select("tid", F.col("k0").alias("sample"), "text"), "tid")
    before = F.when(F.col("pos") > 0, F.substring("text", F.col("pos").cast("int"), F.lit(1))).otherwise("")
    whole = F.substring("text", (F.col("pos") + 1).cast("int"), F.col("depth").cast("int"))
    shown = shown.select("sample", whole.alias("whole"), "freq", F.when(F.col("n_docs") == 1, before).alias("left"), F.explode(F.sequence(F.col("up_depth") + 1, F.col("depth"))).alias("k"))
    return shown.select("sample", F.substring("whole", F.lit(1), F.col("k").cast("int")).alias("path"), "freq", "left")
