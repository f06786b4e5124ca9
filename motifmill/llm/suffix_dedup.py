"""Removal of byte strings that an earlier document has: candidate contexts by content-defined anchors, sorted as
suffixes by deep-shallow sorting.

Every string of `length` bytes picks an anchor from its own bytes alone: the least hash of its 20-byte grams. Equal
strings have equal anchors, so only anchors that occur in two different texts matter (exact copies are found by their
texts' SHA-256 before any sorting); a run of windows with one anchor is sent as one context. Contexts of an anchor are
sorted: multikey sorting to a shallow depth, where a block of strings that are equal so far is parted by its next eight
bytes at once (one many-way step in place of quicksort's three-way ones), then blind tries where a block still holds different
strings. Equal contexts collapse to the least document, and what differs is compared window by window the same way.

Contexts of an anchor with many of them are cut by a second and a third anchor (the least of other hashes of the same grams),
which again depend on the window alone and join the key: most of such a key's contexts are equal. Where an anchor has very
many, its keys are divided by documents too; each part collapses its contexts, and what the parts of a key leave is sorted
together. Every context is cut once at most, where its text is read, and sorted twice at most, whatever an anchor's count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import SHARD_LOAD, broadcast_rows, contains, filled, one_by_one, shard_of
from .common import flat_ranges, fresh, mix64, steps, stored

LENGTH = 50
GRAM = 20
#: Bytes that the multikey quicksort sorts by before blind tries take over.
SHALLOW = 56
#: Contexts of an anchor from which on they are cut. From PARTS times as many on they are divided by documents, into PARTS times
#: more parts with each level of counts.
CROWD, PARTS, MOST_LEVELS = 500, 8, 8
SECOND, THIRD = 0x9FB21C651E98DF25, 0xD1B54A32D192ED03
#: Context rows that are sorted together, cut between anchors.
CHUNK_ROWS = 40_000
PROBES = 6
STEP = 4 << 20


def words8(data: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word at each position; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(15, np.uint8)))
    out = np.empty(len(data), np.uint64)
    for k in range(8):
        n = (len(data) - k + 7) // 8
        if n > 0:
            out[k::8] = padded[k : k + 8 * n].view(">u8")
    return out


def runs_of(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(anchor, document, first window, last window + 1) of each run; positions count within data (texts in a row).

    seed: another one gives other anchors."""
    ends = np.cumsum(sizes)
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    word = words8(data)
    with np.errstate(over="ignore"):
        gram = word[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) + mix64(word[8 : n - GRAM + 9])
        gram = mix64((gram + word[GRAM - 8 : n - 7] * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(seed))
    least, span, wide = gram, 1, length - GRAM + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    # window s is whole if it ends in the document it starts in
    valid = np.zeros(n - length + 2, np.int8)
    firsts, lasts = (ends - sizes)[sizes >= length], ends[sizes >= length] - length + 1
    np.add.at(valid, firsts, 1)
    np.add.at(valid, lasts, -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[firsts] = True
    new[lasts[lasts < len(new)]] = True
    at = np.flatnonzero(new)
    to = np.append(at[1:], len(least))
    keep = valid[at]
    at, to = at[keep], to[keep]
    return least[at], np.searchsorted(ends, at, side="right"), at, to


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def blind_trie_order(strings: list[bytes]) -> list[list[int]]:
    """The strings' numbers in sorted order, equal strings together.

    A node is [depth, child by byte (-1: the string ends)]; inner bytes are not stored, so an insertion descends by
    branching bytes alone, compares with one leaf and branches where they differ."""
    leaves: list[list[int]] = []
    root: list | int | None = None
    for i, s in enumerate(strings):
        if root is None:
            leaves.append([i])
            root = 0
            continue
        node = root
        while not isinstance(node, int):
            kids = node[1]
            node = kids.get(s[node[0]] if node[0] < len(s) else -1)
            if node is None:
                node = next(iter(kids.values()))
        other = strings[leaves[node][0]]
        if other == s:
            leaves[node].append(i)
            continue
        depth = _lcp(s, other)
        parent, key, node = None, None, root
        while not isinstance(node, int) and node[0] < depth:
            parent, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        leaves.append([i])
        byte = s[depth] if depth < len(s) else -1
        if not isinstance(node, int) and node[0] == depth:
            node[1][byte] = len(leaves) - 1
            continue
        inner = [depth, {byte: len(leaves) - 1, other[depth] if depth < len(other) else -1: node}]
        if parent is None:
            root = inner
        else:
            parent[1][key] = inner
    out, todo = [], [] if root is None else [root]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out.append(leaves[node])
        else:
            todo.extend(node[1][k] for k in sorted(node[1], reverse=True))
    return out


def _differing(word: np.ndarray, starts: np.ndarray, sizes: np.ndarray, block: np.ndarray, depth: int) -> np.ndarray:
    """Whether each block, whose strings are equal up to `depth`, holds different ones: all are compared with its first one, by
    eight bytes at a time."""
    crowd = np.bincount(block)
    first = (np.cumsum(crowd) - crowd)[block]
    out = np.zeros(len(crowd), bool)
    rows = np.flatnonzero(first != np.arange(len(first)))
    other = sizes[rows] != sizes[first[rows]]
    out[block[rows[other]]] = True
    rows = rows[~other]
    while True:
        rows = rows[(sizes[rows] > depth) & ~out[block[rows]]]
        if not len(rows):
            return out
        apart = word[starts[rows] + depth] ^ word[starts[first[rows]] + depth]
        left = np.minimum(sizes[rows] - depth, 8).astype(np.uint64)
        out[block[rows[apart >> (np.uint64(8) * (np.uint64(8) - left)) != 0]]] = True
        depth += 8


def deep_shallow_sort(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the strings data[start : start + size] sorted within their groups; new marks the first of equal ones."""
    n = len(starts)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = words8(padded)
    order = np.argsort(group, kind="stable")
    block = np.zeros(n, np.int64)  # the number of the block of strings that are equal so far
    block[1:] = np.cumsum(np.diff(group[order]) != 0)
    for depth in range(0, shallow, 8):  # one digit of eight bytes at a time; what is alone in its block is done
        crowd = np.bincount(block)
        open_ = np.flatnonzero(crowd[block] > 1)
        if not len(open_):
            break
        rows = order[open_]
        left = np.clip(sizes[rows] - depth, 0, 8)
        digit = word[np.minimum(starts[rows] + depth, len(word) - 1)]
        digit = np.where(left == 8, digit, np.where(left == 0, np.uint64(0), digit & ~((np.uint64(1) << (np.uint64(8) * (8 - np.maximum(left, 1)).astype(np.uint64))) - np.uint64(1))))
        resort = np.lexsort((left, digit, block[open_]))
        order[open_] = rows[resort]
        changed = np.ones(n, bool)
        changed[1:] = np.diff(block) != 0
        d, k, b = digit[resort], left[resort], block[open_]
        inner = np.ones(len(open_), bool)
        inner[1:] = (np.diff(b) != 0) | (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        changed[open_] = inner
        block = np.cumsum(changed) - 1
    new = np.ones(n, bool)
    new[1:] = np.diff(block) != 0
    crowd, first = np.bincount(block), np.flatnonzero(new)
    differs = _differing(word, starts[order], sizes[order], block, -(-shallow // 8) * 8)
    raw = data.tobytes()
    for b in np.flatnonzero(differs).tolist():
        at, to = int(first[b]), int(first[b] + crowd[b])
        rows = order[at:to].copy()
        strings = [raw[s : s + k] for s, k in zip(starts[rows].tolist(), sizes[rows].tolist(), strict=True)]
        for same in blind_trie_order(strings):
            order[at : at + len(same)] = rows[same]
            new[at] = True
            new[at + 1 : at + len(same)] = False
            at += len(same)
    return order, new


def covered_runs(anchor: np.ndarray, doc: np.ndarray, data: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, bytes): parts of contexts that lie in a `length`-byte string of a context of the same anchor from a
    smaller document. data, sizes: the contexts' bytes in a row, and how many each has."""
    starts = np.cumsum(sizes) - sizes
    _, group = np.unique(anchor, return_inverse=True)
    order, new = deep_shallow_sort(data, starts, sizes, group)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], first)
    kind = np.empty(len(sizes), np.int64)
    kind[order] = np.cumsum(new) - 1
    whole = np.flatnonzero(doc > least[kind])
    # one context of each kind; anchors whose kinds have different least documents are compared window by window
    rep = order[first]
    rep_group = group[rep]
    low, high = np.full(rep_group.max() + 1, np.iinfo(np.int64).max), np.full(rep_group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, rep_group, least)
    np.maximum.at(high, rep_group, least)
    mixed = np.flatnonzero((low < high)[rep_group])
    rows, offsets, counts = [whole], [np.zeros(len(whole), np.int64)], [sizes[whole]]
    if len(mixed):
        windows = sizes[rep[mixed]] - length + 1
        of = np.repeat(mixed, windows)
        at = flat_ranges(np.zeros(len(mixed), np.int64), windows)
        order, new = deep_shallow_sort(data, starts[rep[of]] + at, np.full(len(of), length), rep_group[of])
        first = np.flatnonzero(new)
        lowest = np.minimum.reduceat(least[of][order], first)
        hit = np.zeros(len(of), bool)
        hit[order] = lowest[np.cumsum(new) - 1] < least[of][order]
        # neighbouring windows make one part
        hits = np.flatnonzero(hit)
        begin = np.ones(len(hits), bool)
        begin[1:] = (np.diff(hits) != 1) | (np.diff(of[hits]) != 0)
        a = hits[begin]
        b = hits[np.append(np.flatnonzero(begin)[1:] - 1, len(hits) - 1)] if len(hits) else hits
        # they hold for every context of the kind that is of its least document
        parts_of = np.searchsorted(of[a], np.arange(len(rep)), side="left"), np.searchsorted(of[a], np.arange(len(rep)), side="right")
        own = np.flatnonzero(doc == least[kind])
        n = (parts_of[1] - parts_of[0])[kind[own]]
        part = flat_ranges(parts_of[0][kind[own]], n)
        rows.append(np.repeat(own, n))
        offsets.append(at[a][part])
        counts.append((at[b] - at[a] + length)[part])
    return np.concatenate(rows), np.concatenate(offsets), np.concatenate(counts)


def _bytes_of(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(texts' bytes in a row, sizes)."""
    col = batch.column(column).cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, np.diff(offsets).astype(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, tag and text: rows that repeat an id are told apart by their text's hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text, F.length(text)).alias("tag"), text.alias("text"))


def repeated_anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, n): the anchors that occur in two different texts or more, n times. docs: doc, tag, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            anchor, doc, _, _ = runs_of(*_bytes_of(batch, "text"), length)
            tag = batch.column("tag").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(tag[doc])], ["anchor", "tag"])

    found = docs.where("doc is not null").select("tag", "text").mapInArrow(run, "anchor long, tag long")
    return found.groupBy("anchor").agg(F.min("tag").alias("a"), F.max("tag").alias("b"), F.count("*").alias("n")).where("a < b").select("anchor", "n")


def copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, tag, start, size): the whole texts that a row with a smaller id has too, by SHA-256. docs: doc, tag, text."""
    text = docs.where("doc is not null").select("doc", "tag", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("size")).where(f"size >= {length}")
    least = text.groupBy("digest").agg(F.min("doc").alias("least"))
    return text.join(least, "digest").where("doc > least").select("doc", "tag", F.lit(0).cast("long").alias("start"), "size").distinct()


def level_keys(anchor: np.ndarray, level: int | np.ndarray) -> np.ndarray:
    """What stands in the filter for an anchor (level 0) and for its counts beyond CROWD * PARTS ** (level - 1)."""
    with np.errstate(over="ignore"):
        return anchor + np.uint64(0xC2B2AE3D27D4EB4F) * np.asarray(level, np.uint64)


def anchor_filter(anchors: DataFrame, shards: int, crowd: int = CROWD) -> list[Broadcast]:
    """Bloom filter shards of the anchors and their levels of counts, each of SHARD_BITS bits. anchors: anchor, n."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("anchor").to_numpy().view(np.uint64), b.column("shard").to_numpy()) for b in batches if b.num_rows]
        if got:
            keys, shard = np.concatenate([x[0] for x in got]), got[0][1][:1]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array([filled(keys, PROBES)])], ["shard", "bits"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, n = batch.column("anchor").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            for level in range(MOST_LEVELS + 1):
                some = anchor if not level else anchor[n > crowd * PARTS ** (level - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(level_keys(some, level).view(np.int64)), pa.array(shard_of(some, shards))], ["anchor", "shard"])

    split = anchors.select("anchor", "n").mapInArrow(number, "anchor long, shard int").repartitionById(shards, F.col("shard"))
    return broadcast_rows(stored(split.mapInArrow(build, "shard int, bits binary"), "anchor-filter"), shards)


def contexts(docs: DataFrame, shards: list[Broadcast], length: int = LENGTH) -> DataFrame:
    """(key, part, parts, doc, tag, start, ctx): the runs of windows whose anchor the filter has. docs: doc, tag, text.

    The key is the anchor, or the anchor, a second and a third one where it has levels of counts in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP):
            data, sizes = _bytes_of(batch, "text")
            anchor, doc, at, to = runs_of(data, sizes, length)
            shard, level = shard_of(anchor, len(shards)), np.full(len(anchor), -1)
            for k, bits in enumerate(one_by_one(shards)):
                mine = np.flatnonzero(shard == k)
                for n in range(MOST_LEVELS + 1):
                    mine = mine[contains(np.frombuffer(bits, np.uint8), level_keys(anchor[mine], n), PROBES)]
                    level[mine] = n
                    if not len(mine):
                        break
            keep = level >= 0
            anchor, doc, at, to, level = (x[keep] for x in (anchor, doc, at, to, level))
            for seed in (SECOND, THIRD):
                crowded = level > 0
                if crowded.any():
                    n = (to - at)[crowded] + length - 1
                    inner, of, a, b = runs_of(data[flat_ranges(at[crowded], n)], n, length, seed)
                    shift = at[crowded][of] - (np.cumsum(n) - n)[of]
                    new = mix64(anchor[crowded][of] ^ mix64(inner)), doc[crowded][of], a + shift, b + shift, level[crowded][of]
                    anchor, doc, at, to, level = (np.concatenate((x[~crowded], y)) for x, y in zip((anchor, doc, at, to, level), new))
            raw = data.tobytes()
            strings = pa.array([raw[a:b] for a, b in zip(at.tolist(), (to + length - 1).tolist(), strict=True)], pa.binary())
            start = at - (np.cumsum(sizes) - sizes)[doc]
            which = pa.array(doc)
            parts = PARTS ** np.maximum(level.astype(np.int64) - 1, 0)
            part = (mix64(batch.column("doc").to_numpy().view(np.uint64))[doc] % parts.astype(np.uint64)).astype(np.int32) if len(doc) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part), pa.array(parts.astype(np.int32)), batch.column("doc").take(which), batch.column("tag").take(which), pa.array(start), strings], ["key", "part", "parts", "doc", "tag", "start", "ctx"])

    return docs.where("doc is not null").mapInArrow(run, "key long, part int, parts int, doc long, tag long, `start` long, ctx binary")


def _sorted_by_key(rows: DataFrame, keys: list[str], done: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """done() of tables that hold all rows of their keys, keys dealt out by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                last = np.ones(table.num_rows, bool)
                for c in keys:
                    own = table[c].to_numpy()
                    last &= own == own[-1]
                cut = int(np.argmax(last))  # the last key may go on in the next batch
                if cut:
                    yield done(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                waiting = table.num_rows - cut
        if waiting:
            yield done(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _spans(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, bytes) of what other rows of the same key cover."""
    data, sizes = _bytes_of(table.select(["ctx"]).combine_chunks().to_batches()[0], "ctx")
    row, offset, size = covered_runs(table["key"].to_numpy(), table["doc"].to_numpy(), data, sizes, length)
    return row, table["start"].to_numpy()[row] + offset, size


def collapsed(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, part, parts, doc, tag, start, size, ctx): the spans of undivided keys and of contexts that equal an earlier
    document's in their part (ctx null); and of divided keys each part's distinct contexts with their least document (ctx
    given)."""

    def done(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        whole = table["parts"].to_numpy() == 1
        at, spans = np.flatnonzero(whole), [(np.zeros(0, np.int64),) * 3]
        if len(at):
            row, start, size = _spans(table.take(pa.array(at)), length)
            spans.append((at[row], start, size))
        at, left = np.flatnonzero(~whole), np.zeros(0, np.int64)
        if len(at):
            some = table.take(pa.array(at)).combine_chunks()
            data, sizes = _bytes_of(some.select(["ctx"]).to_batches()[0], "ctx")
            doc = some["doc"].to_numpy()
            _, group = np.unique(np.stack((some["key"].to_numpy(), some["part"].to_numpy())), axis=1, return_inverse=True)
            order, new = deep_shallow_sort(data, np.cumsum(sizes) - sizes, sizes, group.reshape(-1))
            least, kind = np.minimum.reduceat(doc[order], np.flatnonzero(new)), np.empty(len(at), np.int64)
            kind[order] = np.cumsum(new) - 1
            later = doc > least[kind]
            spans.append((at[later], some["start"].to_numpy()[later], sizes[later]))
            left = at[~later]
        row, start, size = (np.concatenate(x) for x in zip(*spans))
        which, n = pa.array(np.concatenate((row, left))), len(row)
        taken = [table[c].combine_chunks().take(which) for c in ("key", "part", "parts", "doc", "tag")]
        ctx = pa.concat_arrays([pa.nulls(n, pa.binary()), table["ctx"].combine_chunks().take(pa.array(left))])
        return pa.RecordBatch.from_arrays([*taken, pa.array(np.concatenate((start, table["start"].to_numpy()[left]))), pa.array(np.concatenate((size, np.zeros(len(left), np.int64)))), ctx], ["key", "part", "parts", "doc", "tag", "start", "size", "ctx"])

    return _sorted_by_key(found, ["key", "part"], done, "key long, part int, parts int, doc long, tag long, `start` long, size long, ctx binary")


def spans_of_parts(rest: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, tag, start, size) from what the parts of divided keys have left."""

    def done(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        row, start, size = _spans(table, length)
        which = pa.array(row)
        return pa.RecordBatch.from_arrays([table["doc"].combine_chunks().take(which), table["tag"].combine_chunks().take(which), pa.array(start), pa.array(size)], ["doc", "tag", "start", "size"])

    return _sorted_by_key(rest.select("key", "doc", "tag", "start", "ctx"), ["key"], done, "doc long, tag long, `start` long, size long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(doc, tag, start, size): byte spans that a document with a smaller id has too. docs: doc, tag, text."""
    anchors = stored(repeated_anchors(docs, length), "anchors")
    n, whole = anchors.count(), copies(docs, length)
    if not n:
        return whole
    filters = anchor_filter(anchors, max(1, -(-n * PROBES // SHARD_LOAD)), crowd)
    found = stored(collapsed(contexts(docs, filters, length), length), "contexts")
    rest = spans_of_parts(found.where("ctx is not null"), length)
    return whole.unionByName(found.where("ctx is null").select("doc", "tag", "start", "size")).unionByName(rest)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """docs (all columns) plus kept (binary), n_bytes, n_removed, spans (array of start and end of removed runs).

    Texts are taken as UTF-8 bytes, null as empty (its kept is empty too). A byte goes if a `length`-byte string over it
    also starts in a row with a smaller id; rows with equal ids do not touch each other, rows with a null id neither
    lose nor cause anything. Everything is judged on the input. New columns whose names clash get leading underscores."""
    keyed = _keyed(docs, id_col, text_col)
    # a huge document may have many spans: they are merged per document, bounded by its own length
    spans = repeated_spans(keyed, length, crowd).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text, F.length(text)).alias("tag"))
    joined = left.join(spans, ["doc", "tag"], "left").select("row", "spans")
    schema = joined.schema["row"].dataType
    out = f"row {schema.simpleString()}, kept binary, n_bytes long, n_removed long, spans array<struct<`start`:long,`end`:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            kept, total, removed, runs = [], [], [], []
            column = batch.column("row").field(text_col).cast(pa.binary())
            for data, spans in zip((x.as_py() or b"" for x in column), batch.column("spans").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s, k in sorted((x["start"], x["size"]) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s + k)
                    else:
                        merged.append([s, s + k])
                edges = [0, *(x for m in merged for x in m), len(data)]
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if merged else data)
                total.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                runs.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, kind)], ["row", "kept", "n_bytes", "n_removed", "spans"])

    made = joined.mapInArrow(run, out)
    named = {c: fresh(docs, c) for c in ("kept", "n_bytes", "n_removed", "spans")}
    return made.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in named.items()])


def texts_without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = LENGTH) -> DataFrame:
    """docs with the same columns and rows, the text being what is left, its length in code points in chars_col.

    A cut inside a UTF-8 character drops the rest of it. Null texts stay null."""
    got = without_repeats(docs, id_col, text_col, length)
    names, kept = docs.columns, got.columns[len(docs.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, kept):
            was_null = batch.column(text_col).is_null().to_pylist()
            text = [None if null else (data or b"").decode("utf-8", "ignore") for null, data in zip(was_null, batch.column(kept).to_pylist(), strict=True)]
            new = {text_col: pa.array(text, pa.string())}
            if chars_col in names:
                new[chars_col] = pa.array([None if t is None else len(t) for t in text], pa.int64()).cast(batch.column(chars_col).type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

    return got.select(*[f"`{c}`" for c in names], f"`{kept}`").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
