"""Hard negatives for contrastive training by Four-Russians scoring of integer vectors.

Vectors are scaled to integers. Of each anchor every group of eight dimensions gets a table of its 256 subset sums; of each
candidate every group and bit gives one byte, so that a bit plane of a candidate is one look-up a group. A score is the
planes' sums, shifted and added from the sign's plane down: exact, for any vectors.

Anchors are the asked rows: they are dealt into blocks of bounded size and meet all candidates, which are packed once and
dealt into slices of bounded size. A task scores one block of anchors against one slice and hands on what can still be among
the best, a number of rows for each anchor that does not depend on the slice; windows with a limit merge those. The
candidates' labels and scores decide in a second pass which rows lie in the band that an anchor's positives leave open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Anchors in a block and candidates in a slice, at most about.
ANCHORS, SLICE_ROWS = 8_192, 65_536
#: Candidates that are packed into one row, and anchors whose tables are in use at a time.
PACK, TABLES = 1_024, 64
#: Partitions that blocks and slices meet in, at most; beyond that many meetings a task has several, one after the other.
MEETINGS = 8_192
#: Scaled components from this size on are not scored, so that sums of 2,048 products fit 64 bits.
LARGEST = 1 << 26
PACKED = "n int, planes int, ids binary, labels binary, bytes binary"


def packed_planes(x: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes: bit k of byte (p, g, r) is bit p of component 8 * g + k of row r, in two's complement.

    The last plane is the sign's. x: (rows, dims) integers."""
    rows, dims = x.shape
    planes = 1 + int(max(x.max(initial=0), -1 - x.min(initial=0))).bit_length()
    wide = np.zeros((rows, -(-dims // 8) * 8), np.int64)
    wide[:, :dims] = x
    bits = np.stack([(wide >> p & 1).astype(np.uint8) for p in range(planes)])
    return np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little").transpose(0, 2, 1))


def subset_tables(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of eight components. anchors: (n, dims) integers."""
    n, dims = anchors.shape
    wide = np.zeros((n, -(-dims // 8) * 8), np.int64)
    wide[:, :dims] = anchors
    part = wide.reshape(n, -1, 8).transpose(1, 2, 0)
    tables = np.zeros((part.shape[0], 256, n), np.int64)
    for k in range(8):  # the subsets with k as their greatest element
        tables[:, 1 << k : 2 << k] = tables[:, : 1 << k] + part[:, k : k + 1]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products by look-ups, shifts and additions."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    groups = min(len(tables), planes.shape[1])  # what one of both lacks counts as 0
    for p in range(len(planes) - 1, -1, -1):
        total += total
        plane = np.zeros_like(total)
        for g in range(groups):
            plane += tables[g][planes[p, g]]
        if p == len(planes) - 1:
            total -= plane
        else:
            total += plane
    return total


def scored(anchors: np.ndarray, planes: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(anchors of a step, their scores (rows, anchors)), in the narrowest integers that hold all sums."""
    for at in range(0, len(anchors), TABLES):
        some = anchors[at : at + TABLES]
        most = int(np.abs(some).sum(1).max(initial=0)) << len(planes)
        yield slice(at, at + len(some)), scores(subset_tables(some).astype(np.int32 if most < 2**31 else np.int64), planes)


def _component(x: Column, scale: int) -> Column:
    return F.floor(F.lit(float(scale)) * x.cast("double"))


def integer_rows(vectors: DataFrame, label: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, v): the rows that take part, their vectors as integers."""
    v = F.col(f"`{vec_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < float(LARGEST)))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"), fine.alias("fine"))
    return rows.where("id is not null and label is not null and fine").select("id", "label", F.transform("v", lambda x: _component(x, scale)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """List values as rows, short ones filled up with 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    for batch in batches:
        for at in range(0, batch.num_rows, PACK):
            part = batch.slice(at, PACK)
            planes = packed_planes(_matrix(part.column("v")))
            ids, labels = (part.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "label"))
            values = [part.num_rows, len(planes), ids, labels, planes.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["n", "planes", "ids", "labels", "bytes"])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row["bytes"], np.uint8).reshape(row["planes"], -1, row["n"])


class _Best:
    """The first k (score, id) of each key, scores descending, ids ascending; rows are merged when there are many."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.rows, self.room = k, [], 0, 1 << 20

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        self.parts.append((key, score, ident))
        self.rows += len(key)
        if self.rows > self.room:
            self.parts = [self.first()]
            self.rows = len(self.parts[0][0])
            self.room = max(1 << 20, 2 * self.rows)

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        key, score, ident = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ident, -score, key))
        key, score, ident = key[order], score[order], ident[order]
        nth = np.arange(len(key)) - np.searchsorted(key, key, "left")
        return key[nth < self.k], score[nth < self.k], ident[nth < self.k]


def top_of(score: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each column, ties by smaller id; (rows, columns) arrays."""
    rows = len(score)
    low = np.iinfo(np.int64).min
    masked = np.where(allowed, score, low).astype(np.int64)
    if rows > 4 * k:
        bar = np.partition(masked, rows - k, axis=0)[rows - k]
        row, col = np.nonzero(allowed & (masked >= bar))
    else:
        row, col = np.nonzero(allowed)
    order = np.lexsort((ids[row], -masked[row, col], col))
    row, col = row[order], col[order]
    nth = np.arange(len(col)) - np.searchsorted(col, col, "left")
    return row[nth < k], col[nth < k]


def _tiles(anchors: DataFrame, packed: DataFrame, blocks: int, slices: int) -> DataFrame:
    """Each block of anchors with each slice of packed rows (`at` numbers the meetings): first the anchors, kind 0."""
    columns = [c.split() for c in PACKED.split(", ")]
    none = [F.lit(None).cast(t).alias(c) for c, t in columns]
    sent = anchors.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "key", "id", "label", "v", "bands", *none)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("id", "long"), ("label", "long"), ("v", "array<bigint>"), ("bands", "array<bigint>"))]
    home = F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int").alias("slice")
    asked = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), home, F.lit(1).alias("kind"), *nothing, *(c for c, _ in columns))
    both = sent.unionByName(asked).withColumn("at", F.col("block") * slices + F.col("slice")).drop("block", "slice")
    parts = min(blocks * slices, MEETINGS)
    return both.repartitionById(parts, (F.col("at") % parts).cast("int")).sortWithinPartitions("at", "kind", "key")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, dict]]:
    """(anchors, one packed row) for each packed row of each meeting."""
    gathered, anchors, now = [], None, None
    for batch in batches:
        ats = batch.column("at").to_numpy()
        for at in np.unique(ats).tolist():
            if at != now:
                gathered, anchors, now = [], None, at
            here = batch.filter(pa.array(ats == at))
            kind = here.column("kind").to_numpy()
            if (kind == 0).any():
                gathered.append(here.filter(pa.array(kind == 0)).select(["key", "id", "label", "v", "bands"]))
            for row in here.filter(pa.array(kind == 1)).select(["n", "planes", "ids", "labels", "bytes"]).to_pylist():
                if anchors is None and gathered:
                    anchors = pa.Table.from_batches(gathered).combine_chunks()
                if anchors is not None:
                    yield anchors, row


def _column(table: pa.Table, name: str) -> pa.Array:
    got = table[name].combine_chunks()
    return got.chunk(0) if isinstance(got, pa.ChunkedArray) else got


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for anchors, row in _met(batches):
            ids, labels, planes = _unpacked(row)
            keys, own, of = (_column(anchors, c).to_numpy() for c in ("key", "id", "label"))
            for step, score in scored(_matrix(_column(anchors, "v")), planes):
                r, c = top_of(score, ids, (labels[:, None] == of[step]) & (ids[:, None] != own[step]), k)
                best.add(keys[step][c], score[r, c].astype(np.int64), ids[r])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.first()], ["key", "score", "id"])

    return run


def _negatives(k: int, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for anchors, row in _met(batches):
            ids, labels, planes = _unpacked(row)
            keys, of = (_column(anchors, c).to_numpy() for c in ("key", "label"))
            bands = _matrix(_column(anchors, "bands")).reshape(len(keys), wide, 2)
            for step, score in scored(_matrix(_column(anchors, "v")), planes):
                other = labels[:, None] != of[step]
                for j in range(wide):
                    low, high = bands[step, j, 0], bands[step, j, 1]
                    r, c = top_of(score, ids, other & (score >= low) & (score <= high), k)
                    best.add(keys[step][c] * wide + j, score[r, c].astype(np.int64), ids[r])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.first()], ["key", "score", "id"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each key, numbered from 1; tasks' rows are limited before they are shuffled."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, asked: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: int = 256, anchors_in_block: int = ANCHORS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of two vectors whose components x became floor(scale * x); higher ones come first, ties by
    smaller id. asked says which rows are anchors. An anchor's positives are the first rows of its label; for each of them
    rank numbers the first rows of other labels with band[0] * positive_score <= 100 * negative_score <= band[1] *
    positive_score. An anchor without positives, and a positive without such rows, gives none.

    Rows with a null id or label, a null vector, or a component that is null, not finite or scaled to LARGEST or more take
    no part. A vector that is shorter counts as filled up with 0. Rows that repeat an id are rows each, but never positives
    of that id; an anchor row that is repeated is asked again. An empty table gives an empty one."""
    spark = vectors.sparkSession
    rows = integer_rows(vectors, label, id_col, vec_col, scale)
    chosen = integer_rows(vectors.where(asked), label, id_col, vec_col, scale)
    n_rows, n_anchors = rows.count(), chosen.count()
    blocks = max(1, -(-n_anchors // anchors_in_block))
    # slices of bounded size, and as many as keep all cores at work
    slices = max(1, -(-n_rows // slice_rows), min(-(-3 * spark.sparkContext.defaultParallelism // blocks), -(-n_rows // 1024)))
    packed = stored(rows.mapInArrow(_packed, PACKED), "packed-vectors")
    dealt = chosen.repartition(blocks).withColumn("block", F.spark_partition_id()).withColumn("key", F.monotonically_increasing_id())
    anchors = stored(dealt.withColumn("bands", F.array().cast("array<bigint>")), "anchors")
    first = stored(_ranked(_tiles(anchors, packed, blocks, slices).mapInArrow(_positives(positives), "key long, score long, id long"), positives), "positives")
    # of integers: band[0] * p <= 100 * n is n >= ceil(band[0] * p / 100)
    p = F.col("score")
    bounds = F.struct(F.col("rank").alias("nth"), (-F.floor(-p * band[0] / F.lit(100))).cast("long").alias("low"), F.floor(p * band[1] / F.lit(100)).cast("long").alias("high"))
    listed = first.groupBy("key").agg(F.sort_array(F.collect_list(bounds)).alias("b"))
    nothing = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    filled = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.when(i < F.size("b"), F.array(F.get("b", i).getField("low"), F.get("b", i).getField("high"))).otherwise(nothing)))
    with_bands = stored(anchors.drop("bands").join(listed, "key").select("block", "key", "id", "label", "v", filled.alias("bands")), "anchors-with-bands")
    second = _ranked(_tiles(with_bands, packed, blocks, slices).mapInArrow(_negatives(negatives, positives), "key long, score long, id long"), negatives)
    second = second.select(F.floor(F.col("key") / positives).alias("key"), (F.pmod("key", F.lit(positives)) + 1).alias("nth"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = first.join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select("key", F.col("rank").cast("long").alias("nth"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(second, ["key", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
