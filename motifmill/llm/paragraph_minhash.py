"""Repeated passages by MinHash banding of paragraphs.

A text's paragraphs are its lines and, within lines, blocks of sentences. Blocks start with the line, at sentences whose
first words hash lowest among the sentences nearby and, far from any sentence's start, at words that hash lowest among the
words nearby; they end at the first sentence end BLOCK_WORDS words on, or after MOST_WORDS, and further blocks fill what
is left up to the next start. All this depends on the words there alone, so a passage set into other text has the same
blocks in all its places, and the blocks of a line hold all its words. Equal paragraphs are one unit. Units collide
in bands of minima over five-word shingles, colliding units are verified by exact Jaccard, linked units make classes,
and of each class only the first occurrence is kept. In a crowded bucket neighbours are verified first; what they leave
in different classes is then verified in pieces of bounded size, block of units against block, until no pair is open."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import SHARD_LOAD, broadcast_rows, contains, filled, one_by_one, shard_of
from .common import flat_ranges, hand_back, mix64, starts_of, steps, stored, texts, word_ids
from .components import connected_components

WIDTH, THRESHOLD = 5, 0.8
#: Minima in a band, and the chance that a pair at the threshold shares a band.
ROWS, RECALL = 2, 0.99
#: Words of the smallest block (a rest of fewer goes to the block before it), least and most words of a block that its line
#: or the next start does not cut short, and the distance in words within which a sentence must hash lowest to start one.
#: Blocks that overlap stay under the threshold by these.
LEAST_WORDS, BLOCK_WORDS, MOST_WORDS, NEARBY = WIDTH, 12, 24, 5
#: The distance in words within which no sentence starts and a word must hash lowest to start a block.
INSIDE = 8
#: The end of a sentence's last word: a stop, and quotes or brackets that close after it.
STOP = "[.!?][\"'\u201d\u2019\u00bb)\\]}*_]*$"
#: A unit is first compared with so many neighbours before it in its bucket (smaller buckets: with all), and with the first.
NEIGHBOURS = 8
#: Shingles of a block of a crowded bucket, and pairs of equal shingles that are counted at a time.
BLOCK_SHINGLES, COUNTED = 1 << 17, 1 << 22
PROBES = 6
BREAK = "\x1e"
BASE = 0x9E3779B97F4A7C15


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands of so many rows that find a pair at the threshold with the wanted chance."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def _block_starts(begins: np.ndarray, heads: np.ndarray, line_end: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where blocks start: at lines' heads, sentences (begins) of least rank nearby, and words of least rank far from these."""
    n, at = len(rank), np.arange(len(rank))
    own, line = np.where(heads[begins], np.uint64(0), rank[begins]), line_end[begins]
    lowest = np.ones(len(begins), bool)
    for k in range(1, NEARBY + 1):  # sentences have a word at least
        near = (begins[k:] - begins[:-k] <= NEARBY) & (line[k:] == line[:-k])
        lowest[:-k] &= ~near | (own[:-k] < own[k:])
        lowest[k:] &= ~near | (own[k:] <= own[:-k])
    room = line - begins + 1 >= LEAST_WORDS
    is_begin = np.zeros(n, bool)
    is_begin[begins] = True
    since = at - np.maximum.accumulate(np.where(is_begin, at, -1))
    until = np.minimum.accumulate(np.where(is_begin, at, n + INSIDE)[::-1])[::-1] - at
    far = np.flatnonzero((since > INSIDE) & (until > INSIDE) & (line_end - at + 1 >= LEAST_WORDS))
    least = np.ones(len(far), bool)
    for k in range(1, INSIDE + 1):
        least &= (far + k > line_end[far]) | (rank[far] < rank[np.minimum(far + k, n - 1)])
        least &= rank[far] <= rank[far - k]
    return np.sort(np.concatenate((begins[lowest & (room | heads[begins])], far[least])))


def _tiles(starts: np.ndarray, line_end: np.ndarray, any_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last token + 1) of the blocks from each start up to the next one or the line's end, in order."""

    def ends(at: np.ndarray) -> np.ndarray:
        return np.minimum(any_end[np.minimum(at + BLOCK_WORDS - 1, line_end[at])] + 1, at + MOST_WORDS)

    at = starts
    limit = np.minimum(np.append(starts[1:], len(line_end))[: len(starts)], line_end[starts] + 1)
    to, found = ends(at), []
    while len(at):
        rest = limit - to
        to = np.where((rest > 0) & (rest < LEAST_WORDS), limit, to)
        found.append((at, to))
        open_ = to < limit
        at, limit = to[open_], limit[open_]
        to = np.minimum(ends(at), limit)
    if not found:
        return starts, starts
    at, to = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable")
    return at[order], to[order]


def _paragraphs(text: pa.Array) -> tuple[np.ndarray, ...]:
    """(code of each token, document, first and last token + 1, kind, words before it) of lines (0) and blocks (1).

    Tokens are lower-cased words; line breaks are tokens of their own and in no paragraph."""
    marked = pc.replace_substring(pc.utf8_lower(text), "\n", f" {BREAK} ")
    doc, words, index = word_ids(marked, pc.ascii_split_whitespace)
    code = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))[index]
    n = len(index)
    if not n:
        none = np.zeros(0, np.int64)
        return code, none, none, none, none, none, words, index
    is_break = pc.equal(words, BREAK).to_numpy(zero_copy_only=False)[index]
    stop = pc.match_substring_regex(words, STOP).to_numpy(zero_copy_only=False)[index]
    ends_doc = np.append(doc[1:] != doc[:-1], True)
    ends_line = ends_doc | np.append(is_break[1:], True) | is_break
    at = np.arange(n)
    after = lambda ends: np.minimum.accumulate(np.where(ends, at, n)[::-1])[::-1]  # noqa: E731  the first end from each token on
    line_end, any_end = after(ends_line), after(ends_line | stop)
    heads = np.append(True, ends_line[:-1])
    begins = np.flatnonzero((heads | np.append(True, stop[:-1])) & ~is_break)
    with np.errstate(over="ignore"):
        rank = mix64(code * np.uint64(3) + np.append(code[1:], np.uint64(0)))
    starts = _block_starts(begins, heads, line_end, rank)
    lines = np.flatnonzero(ends_line) + 1
    spans = ((np.append(0, lines[:-1]), lines), _tiles(starts, line_end, any_end))
    plain = np.cumsum(~is_break)
    doc_start = starts_of(doc, len(text))[:-1]
    found = []
    for kind, (at, to) in enumerate(spans):
        keep = ~is_break[at]
        if kind:  # a block that is its whole line is there already
            keep &= (to - at >= LEAST_WORDS) & ~(ends_line[to - 1] & heads[at])
        at, to = at[keep], to[keep]
        found.append((doc[at].astype(np.int64), at, to, np.full(len(at), kind), plain[at] - 1 - np.where(doc_start[doc[at]] > 0, plain[doc_start[doc[at]] - 1], 0)))
    return code, *(np.concatenate(x) for x in zip(*found)), words, index


def _unit_hashes(code: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A hash of each token range, from prefix sums of a polynomial modulo 2**64."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.append(np.uint64(1), np.full(len(code), BASE, np.uint64)))
        inverse = np.cumprod(np.append(np.uint64(1), np.full(len(code), pow(BASE, -1, 1 << 64), np.uint64)))
        prefix = np.append(np.uint64(0), np.cumsum(mix64(code) * power[:-1]))
        return mix64((prefix[to] - prefix[at]) * inverse[at] + (to - at).astype(np.uint64))


def _band_keys(code: np.ndarray, at: np.ndarray, to: np.ndarray, kind: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """The bands of each token range: hashes of `rows` minima over its shingles' hashes.

    Lines collide with lines and blocks with blocks, so that a long block is no near copy of its own line; equal ones
    are one unit whatever they are."""
    n = len(code) - WIDTH + 1
    with np.errstate(over="ignore"):
        shingle = np.zeros(n + WIDTH, np.uint64)
        for k in range(WIDTH):
            shingle[:n] = mix64(shingle[:n] * np.uint64(31) + code[k : k + n])
        cuts = np.stack((at, to - WIDTH + 1), 1).reshape(-1)
        made = np.empty((len(at), bands), np.uint64)
        for band in range(bands):
            key = (kind * bands + band).astype(np.uint64)
            for row in range(rows):
                hashed = mix64(shingle + np.uint64((band * rows + row + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
                key = mix64(key * np.uint64(31) + np.minimum.reduceat(hashed, cuts)[::2])
            made[:, band] = key
    return made


def occurrences(docs: DataFrame) -> DataFrame:
    """(unit, doc, kind, start, size): every paragraph, start counting the document's words before it. docs: doc, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            code, doc, at, to, kind, before, _, _ = _paragraphs(texts(batch))
            unit = _unit_hashes(code, at, to).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unit), batch.column("doc").take(pa.array(doc)), pa.array(kind.astype(np.int8)), pa.array(before.astype(np.int32)), pa.array((to - at).astype(np.int32))], ["unit", "doc", "kind", "start", "size"])

    return docs.select("doc", "text").mapInArrow(run, "unit long, doc long, kind byte, `start` int, size int")


def collisions(docs: DataFrame, bands: int) -> DataFrame:
    """(a, b, band): units that share a band, each with its neighbours and with the first of the bucket (band null), and
    the units a of every bucket that holds more than those (b null). docs: text.

    A unit is one row a step and band; buckets are read in order with a window of NEIGHBOURS units, so a bucket's rows
    and pairs grow with its units, never with their square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            code, _, at, to, kind, _, _, _ = _paragraphs(texts(batch))
            at, to, kind = (x[to - at >= WIDTH] for x in (at, to, kind))  # shorter ones have no shingles: only equal ones are alike
            if not len(at):
                continue
            unit = _unit_hashes(code, at, to)
            first = np.sort(np.unique(unit, return_index=True)[1])  # in the order of the text: minima run over rising ranges
            unit, keys = unit[first], _band_keys(code, at[first], to[first], kind[first], bands)
            for band in range(bands):
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, band].view(np.int64)), pa.array(unit.view(np.int64))], ["band", "unit"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, unit, leader, rank = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            old = len(band)
            band, unit = np.append(band, batch.column("band").to_numpy()), np.append(unit, batch.column("unit").to_numpy())
            new = np.ones(len(band), bool)
            new[1:] = (band[1:] != band[:-1]) | (unit[1:] != unit[:-1])
            new[:old] = True
            band, unit = band[new], unit[new]
            head = np.ones(len(band), bool)
            head[1:] = band[1:] != band[:-1]
            first = np.maximum.accumulate(np.where(head, np.arange(len(band)), 0))
            lead, gone, rank = unit[first], rank, np.arange(len(band)) - first
            if old:  # the first bucket may go on from before
                rank[first == first[0]] += gone[0]
                lead[first == first[0]] = np.where(band[first == first[0]] == band[0], leader[0], lead[first == first[0]])
                lead[:old] = leader
            fresh_ = np.arange(len(band)) >= old
            a, b = [lead[fresh_ & (lead != unit)]], [unit[fresh_ & (lead != unit)]]
            for k in range(1, NEIGHBOURS + 1):
                same = np.flatnonzero((band[k:] == band[:-k]) & fresh_[k:]) if len(band) > k else np.zeros(0, np.int64)
                a.append(unit[same])
                b.append(unit[same + k])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64())], ["a", "b", "band"])
            over = np.flatnonzero(fresh_ & (rank > NEIGHBOURS))
            full = np.flatnonzero(fresh_ & (rank == NEIGHBOURS + 1))  # the first row past the window: those before it belong to the bucket too
            a = np.concatenate((unit[over], lead[full], *(unit[full - k] for k in range(1, NEIGHBOURS + 1))))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(np.append(band[over], np.tile(band[full], NEIGHBOURS + 1)))], ["a", "b", "band"])
            band, unit, leader, rank = band[-NEIGHBOURS:], unit[-NEIGHBOURS:], lead[-NEIGHBOURS:], rank[-NEIGHBOURS:]

    rows = docs.select("text").mapInArrow(run, "band long, unit long")
    return rows.repartition("band").sortWithinPartitions("band", "unit").mapInArrow(pair, "a long, b long, band long").distinct()


def unit_filter(units: DataFrame, n: int) -> list[Broadcast]:
    """Bloom filter shards of the units."""
    shards = max(1, -(-n * PROBES // SHARD_LOAD))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(shard_of(batch.column("unit").to_numpy().view(np.uint64), shards))], ["unit", "shard"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("unit").to_numpy().view(np.uint64), b.column("shard")[0].as_py()) for b in batches if b.num_rows]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([got[0][1]], pa.int32()), pa.array([filled(np.concatenate([x[0] for x in got]), PROBES)])], ["shard", "bits"])

    split = units.mapInArrow(number, "unit long, shard int").repartitionById(shards, F.col("shard"))
    return broadcast_rows(stored(split.mapInArrow(build, "shard int, bits binary"), "unit-filter"), shards)


def shingle_sets(docs: DataFrame, wanted: list[Broadcast]) -> DataFrame:
    """(unit, shingles): the distinct shingle hashes of the units that the filter has. docs: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            code, _, at, to, _, _, _, _ = _paragraphs(texts(batch))
            at, to = (x[to - at >= WIDTH] for x in (at, to))
            if not len(at):
                continue
            unit, first = np.unique(_unit_hashes(code, at, to), return_index=True)
            shard, keep = shard_of(unit, len(wanted)), np.zeros(len(unit), bool)
            for k, bits in enumerate(one_by_one(wanted)):
                mine = np.flatnonzero(shard == k)
                keep[mine] = contains(np.frombuffer(bits, np.uint8), unit[mine], PROBES)
            unit, at, to = unit[keep], at[first][keep], to[first][keep]
            n = to - at - WIDTH + 1
            place = flat_ranges(at, n)
            with np.errstate(over="ignore"):
                shingle = np.zeros(len(place), np.uint64)
                for k in range(WIDTH):
                    shingle = mix64(shingle * np.uint64(31) + code[place + k])
            offsets = np.append(0, np.cumsum(n)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingle.view(np.int64)))], ["unit", "shingles"])

    rows = docs.select("text").mapInArrow(run, "unit long, shingles array<long>")
    return rows.dropDuplicates(["unit"]).select("unit", F.array_distinct("shingles").alias("shingles"))


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (each entry's least known peer) after linking the labels a with the labels b."""
    a, b = label[a], label[b]
    while (a != b).any():
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
    return label


def _joined(group: np.ndarray, comp: np.ndarray, size: np.ndarray, shingles: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links between the components of rows of one group that have at least this Jaccard similarity.

    Every pair of a group is looked at unless its rows are linked already; shared shingles are counted along the lists
    of rows that have the same shingle, COUNTED pairs at a time. Rows of a group stand together."""
    n, row = len(group), np.repeat(np.arange(len(group)), size)
    names, own = np.unique(comp, return_inverse=True)
    label = np.arange(len(names))
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, n)))
    with np.errstate(over="ignore"):
        code = mix64(shingles.view(np.uint64) + mix64(of.astype(np.uint64) + np.uint64(1))[row])
    order = np.argsort(code, kind="stable")
    last = np.flatnonzero(np.append(code[order][1:] != code[order][:-1], True))
    after = np.empty(len(code), np.int64)
    place = np.empty(len(code), np.int64)
    after[order] = np.repeat(last, np.diff(np.append(-1, last))) - np.arange(len(code))
    place[order] = np.arange(len(code))
    ends, entries = np.cumsum(np.bincount(row, weights=after, minlength=n)), np.append(0, np.cumsum(size))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED, side="right")))
        now = label[own]
        alive = np.minimum.reduceat(now, heads) < np.maximum.reduceat(now, heads)
        e = np.arange(entries[at], entries[to])
        e = e[(after[e] > 0) & alive[of[row[e]]]]
        if len(e):
            left = np.repeat(row[e], after[e])
            right = row[order[flat_ranges(place[e] + 1, after[e])]]
            width = int((right - left).max()) + 1
            cell = (left - at) * width + right - left
            if (to - at) * width <= 4 * COUNTED:
                shared = np.bincount(cell)
                cell = np.flatnonzero(shared)
                shared = shared[cell]
            else:
                cell, shared = np.unique(cell, return_counts=True)
            left, right = cell // width + at, cell // width + at + cell % width
            alike = (now[left] != now[right]) & (shared >= (size[left] + size[right] - shared) * threshold - 1e-9)
            label = _merged(label, own[left[alike]], own[right[alike]])
        at = to
    moved = np.flatnonzero(label != np.arange(len(label)))
    return names[moved], names[label[moved]]


def crowded_links(crowded: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): components to link, from all pairs of units that share a bucket and not yet a component.

    crowded: band, unit, comp; sets: unit, shingles. A bucket of several components is dealt by the units' hashes into
    blocks of about so many shingles, and each two blocks are joined by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> pa.RecordBatch:
            key = np.stack([rows.column(c).to_numpy() for c in ("band", "lo", "hi")])
            group = np.cumsum(np.append(0, (key[:, 1:] != key[:, :-1]).any(0)))
            lists = rows.column("shingles").combine_chunks()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            found = _joined(group, rows.column("comp").to_numpy(), size, lists.flatten().to_numpy(), threshold)
            return pa.RecordBatch.from_arrays([*map(pa.array, found)], ["a", "b"])

        held, load = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            load += len(batch.column("shingles").flatten())
            if load >= 2 * block_shingles:
                rows = pa.Table.from_batches(held)
                key = np.stack([rows.column(c).to_numpy() for c in ("band", "lo", "hi")])
                cut = int(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))[-1])  # the last piece may go on
                if cut:
                    yield done(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
                    load = sum(len(x.column("shingles").flatten()) for x in held)
        if held:
            yield done(pa.Table.from_batches(held))
        hand_back()

    sized = crowded.join(sets.select("unit", F.size("shingles").cast("long").alias("n")), "unit")
    several = sized.groupBy("band").agg(F.sum("n").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    blocks = several.select("band", F.ceil(F.col("n") / block_shingles).cast("int").alias("blocks"))
    dealt = crowded.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("unit"), "blocks").cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
    pieces = dealt.withColumn("other", F.explode(other)).select("unit", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "comp")
    rows = pieces.join(sets, "unit").select("band", "lo", "hi", "comp", "shingles")
    return rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(run, "a long, b long")


def unit_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root): units linked, at one or more removes, by sharing a band and having at least this Jaccard similarity
    of shingle sets. docs: text."""
    found = stored(collisions(docs, bands_for(threshold)), "collisions")
    pairs, crowded = found.where("b is not null").select("a", "b"), found.where("b is null").select("band", F.col("a").alias("unit"))
    units = stored(pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct(), "colliding")
    n = units.count()
    if not n:
        return connected_components(pairs, "a", "b", "paragraphs")
    sets = stored(shingle_sets(docs, unit_filter(units, n)), "shingles")
    both = pairs.join(sets.select(F.col("unit").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("unit").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    roots = connected_components(both.where(shared >= (F.size("sa") + F.size("sb") - shared) * threshold - 1e-9).select("a", "b"), "a", "b", "paragraphs")
    named = stored(crowded.join(roots, crowded.unit == roots.node, "left").select("band", "unit", F.coalesce("root", "unit").alias("comp")), "crowded")
    later = connected_components(crowded_links(named, sets, threshold), "a", "b", "crowded-links").select(F.col("node").alias("comp"), F.col("root").alias("last"))
    # units that were alone until now have no root yet
    alone = later.join(roots, later.comp == roots.node, "left_anti").select(F.col("comp").alias("node"), F.col("last").alias("root"))
    return roots.join(later, roots.root == later.comp, "left").select("node", F.coalesce("last", "root").alias("root")).unionByName(alone)


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, kind, start, size, class_id, class_size, first_id, kept): every paragraph that occurs again.

    kind is line or block, start and size count words (runs without ASCII white space) of the document, class_id names
    the class of linked paragraphs and class_size its occurrences; the one in the least id (null ids last), at the least
    place, is kept. Lines under WIDTH words repeat only as equal ones; null or empty texts have no rows; repeated rows repeat
    each other. All units that share a bucket are compared, unless they are in one class already."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    roots = unit_classes(rows, threshold)
    found = stored(occurrences(rows), "paragraphs")
    # one row a unit, then a class; both are summed before they are joined, so a frequent paragraph is no burden
    place = F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), F.col("start"), F.col("kind"))
    units = found.groupBy("unit").agg(F.count("*").alias("n"), F.min(place).alias("place"))
    classed = stored(units.join(roots, units.unit == roots.node, "left").select("unit", "n", "place", F.coalesce("root", "unit").alias("class_id")), "classes")
    classes = classed.groupBy("class_id").agg(F.sum("n").alias("class_size"), F.min("place").alias("first")).where("class_size > 1")
    named = classed.select("unit", "class_id").join(classes, "class_id")
    kept = (F.coalesce("doc", F.lit((1 << 63) - 1)) == F.col("first.doc")) & (F.col("start") == F.col("first.start")) & (F.col("kind") == F.col("first.kind"))
    first_id = F.when(F.col("first.doc") < (1 << 63) - 1, F.col("first.doc"))
    return found.join(named, "unit").select(F.col("doc").alias(id_col), F.when(F.col("kind") == 0, "line").otherwise("block").alias("kind"), "start", "size", "class_id", "class_size", first_id.alias("first_id"), kept.alias("kept"))
