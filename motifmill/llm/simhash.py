"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined by meet-in-the-middle ball hashing.

Two fingerprints at distance d <= 2r share a variant within distance r of either, so each distinct fingerprint sends
out all variants in its ball of radius r = ceil(max_bits / 2) and colliding ones are verified. A ball of radius 1 has
65 members: no variant can gather more than 65 distinct fingerprints, whatever the number of copies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, steps, stored, texts
from .components import connected_components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def shingle_hashes(data: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, in blocks. data: UTF-8."""
    words = data.lower().split()  # bytes: lower() touches A-Z, split() splits at \x20 and \x09-\x0D
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = (starts[: 1 - width] if width > 1 else starts, ends[width - 1 :]) if len(words) >= width else (starts[:1], ends[-1:])
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), BLOCK):
        a, b = first[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist()
        yield np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, len(a))


def simhash(text: str | None, width: int = 3) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the shingles' hashes; without words 0."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes((text or "").encode("utf-8", "surrogatepass"), width):
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little") if n else 0


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, tag, fp): one row per row of docs; fp is the fingerprint as a signed long, tag a hash of the text, which
    tells rows with equal ids apart. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            prints = np.array([simhash(t, width) for t in texts(batch, text_col).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("tag"), pa.array(prints.view(np.int64))], [id_col, "tag", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_tag(text_col).alias("tag"), text_col).mapInArrow(run, f"`{id_col}` {kind}, tag long, fp long")


def text_tag(text_col: str) -> Column:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.xxhash64(text, F.length(text))


def ball(radius: int) -> list[int]:
    """The masks of all changes of at most `radius` bits, as signed longs."""
    masks = [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def fingerprint_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links that join what a chain of pairs within max_bits joins. prints: distinct fingerprints (fp).

    Within a variant's bucket the members are chained in order. For even max_bits members of one bucket are within
    max_bits of each other, so the chain of verified neighbours loses no reachability; an odd max_bits would need
    all pairs of a bucket and is refused."""
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    masks = F.array(*[F.lit(m) for m in ball(max_bits // 2)])
    sent = prints.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("variant"))
    chained = sent.select(F.col("fp").alias("a"), F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("b")).where("b is not null")
    return chained.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id, tag, root) for every row of docs; root names the component by a fingerprint.

    component_id is the least id that links within max_bits reach. Null texts count as empty; empty texts have
    fingerprint zero and link like others; rows with a null id get a component but never name it unless the whole
    component has null ids. Repeated rows each keep their row. Other columns are not read. Equal fingerprints are
    merged before anything is shuffled by variant, so a huge group of copies costs one fingerprint."""
    rows = stored(with_fingerprints(docs, id_col, text_col, width), "simhash")
    prints = rows.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    roots = connected_components(fingerprint_links(prints.select("fp")), "a", "b", "simhash-links")
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "tag", "root")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """docs without the near copies: of each component one row stays, that with the least id (and text hash).

    Of rows that repeat both id and text the one stays whose JSON form of all columns is least. Rows with a null id cannot
    be ordered and stay; null texts count as empty. All columns are kept as they are, whatever their names. An empty table
    stays empty. Only the rows to leave out are joined with the texts."""
    got = stored(simhash_components(docs, id_col, text_col, width, max_bits).where(F.col(id_col).isNotNull()), "simhash-groups")
    own, tag, nth = fresh(docs, "id_"), fresh(docs, "tag_"), fresh(docs, "nth")
    got = got.select(F.col(f"`{id_col}`").alias(own), F.col("tag").alias(tag), "root")
    # stored, so that the join with the rows of a huge group is one that Spark can split
    first = stored(got.groupBy("root").agg(F.min(F.struct(F.col(own).alias("id"), F.col(tag).alias("tag"))).alias("first")), "simhash-first")
    gone = got.join(first, "root").where((F.col(own) != F.col("first.id")) | (F.col(tag) != F.col("first.tag"))).select(own, tag).distinct()
    left = docs.join(gone, (F.col(f"`{id_col}`") == F.col(own)) & (text_tag(text_col) == F.col(tag)), "left_anti")
    repeated = stored(got.groupBy(own, tag).agg(F.count("*").alias(nth)).where(f"`{nth}` > 1").select(own, tag), "simhash-repeats")
    if repeated.isEmpty():
        return left
    same = (F.col(f"`{id_col}`") == F.col(own)) & (text_tag(text_col) == F.col(tag))
    order = Window.partitionBy(f"`{id_col}`", text_tag(text_col)).orderBy(F.to_json(F.struct(*[f"`{c}`" for c in docs.columns])))
    again = left.join(repeated, same, "left_semi").withColumn(nth, F.row_number().over(order)).where(f"`{nth}` = 1").drop(nth)
    return left.join(repeated, same, "left_anti").unionByName(again)
