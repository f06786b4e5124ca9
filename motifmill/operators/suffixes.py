"""The order of all suffixes of a collection, common prefixes, and patterns found between their bounds in that order.

Texts are numbered in the order of their keys and laid end to end, each with an end of its own, so that one number is a
place. Suffixes are dealt out by ranges of their first GRAM characters and sorted; what still shares a rank is sorted again
by the rank of what follows, twice as far each round. Rows are numbered where they stand: a range learns from a table of one
row a range how many rows come before it and whether its first group begins earlier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import stored, with_last, with_running

#: Characters that suffixes are first ranked by.
GRAM = 32
#: Suffixes of a text that are cut out at a time.
CUT = 50_000
#: How many times as many characters are read after the first ones where these are shared.
MORE = 3
#: Bits of the field that tells whose ranks are asked for.
ASKED_BITS = 1 << 24
#: Characters that two suffixes are first compared over, beyond GRAM; four times as many each time that is not enough.
SPAN = 256
#: What no text holds after a pattern.
LAST = "\U0010ffff"
#: Bits of the filter of patterns' beginnings, and of one of the blocks it is made in.
FILTER_BITS, BLOCK_BITS = 1 << 25, 1 << 16
#: Characters that the filter is asked about at a time, about.
ASKED = 1 << 16
#: Occurrences that are listed at a time.
LISTED = 10_000


def numbered(texts: DataFrame, keys: list[str], text: str = "text", start: int = 0) -> DataFrame:
    """(tid, k0, k1, ..., text, first): texts that are not null, numbered by their keys; first is the place of a text's first
    character. Texts that repeat a key follow each other by text, and are texts each."""
    named = [F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keys)]
    rows = texts.where(F.col(f"`{text}`").isNotNull()).select(*named, F.col(f"`{text}`").alias("text"), (F.length(f"`{text}`") + 1).cast("long").alias("size"))
    got = with_running(rows, [*(f"k{n}" for n in range(len(keys))), "text"], "tid", {"after": F.col("size")})
    return got.select("tid", *(f"k{n}" for n in range(len(keys))), "text", (F.col("after") - F.col("size") + start).alias("first"))


SUFFIX_ROWS = "g long, tid long, pos long, left long, gram string, before string"


class _Texts:
    """The texts of a batch by characters: of text t, character k begins at byte begin[base[t] + k], and size[t] characters follow
    each other; the byte behind the last one is where the next text begins."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.string())
        _, ends, data = column.buffers()
        offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.data = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        starts = np.flatnonzero((self.data[offsets[0] :] & 0xC0) != 0x80) + offsets[0]
        self.begin = np.append(starts, offsets[-1])
        at = np.searchsorted(starts, offsets)
        self.base, self.size = at[:-1], np.diff(at)

    def cut(self, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
        """The characters from low up to but without high of each text."""
        from_, to = self.begin[self.base[text] + low], self.begin[self.base[text] + high]
        ends = np.append(0, np.cumsum(to - from_))
        at = np.arange(ends[-1]) + np.repeat(from_ - ends[:-1], to - from_)
        return pa.StringArray.from_buffers(len(text), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.data[at]))


def _suffix_rows(gram: int, every: int, columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = _Texts(batch.column("text"))
            tid, first = (batch.column(c).to_numpy() for c in ("tid", "first"))
            leads = batch.column("lead").cast(pa.string())
            led = bool(pc.any(pc.not_equal(leads, "")).as_py())
            ends = np.append(0, np.cumsum(texts.size // every + 1))
            for low in range(0, int(ends[-1]), CUT):
                nth = np.arange(low, min(low + CUT, int(ends[-1])))
                text = np.searchsorted(ends, nth, "right") - 1
                pos, size = (nth - ends[text]) * every, texts.size[text]
                made = {"g": lambda: first[text] + pos, "tid": lambda: tid[text], "pos": lambda: pos, "left": lambda: size - pos}
                grams = texts.cut(text, pos, np.minimum(pos + gram, size))
                cells = {c: pa.array(f()) for c, f in made.items() if c in columns}
                cells["gram"] = pc.binary_join_element_wise(leads.take(pa.array(text)), grams, "") if led else grams
                if "before" in columns:
                    cells["before"] = texts.cut(text, np.maximum(pos - 1, 0), pos)
                yield pa.RecordBatch.from_arrays([cells[c] for c in columns], columns)

    return run


def suffix_rows(texts: DataFrame, gram: int = GRAM, every: int = 1, kept: list[str] | None = None) -> DataFrame:
    """(g, tid, pos, left, gram, before) of every suffix, empty ones included, or of every `every`-th: its place, text, place in
    the text, length, first characters, and the character before it (empty for a text's first). kept: those of SUFFIX that
    are asked for.

    A column lead of the texts is put before the first characters: suffixes are then ordered by it first."""
    rows = texts.select("tid", "first", "text", F.col("lead") if "lead" in texts.columns else F.lit("").alias("lead"))
    schema = [c for c in SUFFIX_ROWS.split(", ") if c.split()[0] in (*(kept or SUFFIX), "gram")]
    return rows.mapInArrow(_suffix_rows(gram, every, [c.split()[0] for c in schema]), ", ".join(schema))


def _windows(text: str, lengths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, a hash of the window of that length that begins at each character) for each length that the text has."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    doubled = [codes]  # windows of 1, 2, 4, ... characters
    for length in sorted(n for n in lengths if n <= len(codes)):
        while 2 << (len(doubled) - 1) <= length:
            k = 1 << (len(doubled) - 1)
            doubled.append(doubled[-1][:-k] * np.uint64(pow(base, k, 1 << 64)) + doubled[-1][k:])
        mixed, at = None, 0
        for k in reversed(range(length.bit_length())):
            if length >> k & 1:
                part = doubled[k][at : at + len(codes) - length + 1]
                mixed = part if mixed is None else mixed * np.uint64(pow(base, 1 << k, 1 << 64)) + part
                at += 1 << k
        yield length, mixed


def _bits(hashes: np.ndarray, shift: int) -> np.ndarray:
    """The filter's bits of windows that tell of a suffix `shift` characters on; shift -1: of one anywhere."""
    mixed = hashes + np.uint64((shift + 2) * 0xD6E8FEB86659FD93 % (1 << 64))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(65 - FILTER_BITS.bit_length())).astype(np.int64)


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, shift, bit) of the windows by which the suffixes at multiples of GRAM of the patterns are known: their first GRAM
    characters, or, where less is left, the pattern's last GRAM; whole patterns that are shorter."""
    for batch in batches:
        rows = []
        for text in batch.column("pattern").to_pylist():
            size = min(GRAM, len(text))
            for k in range(0, len(text), GRAM):
                at = min(k, len(text) - size)
                hashes = next(h for _, h in _windows(text[at : at + size], {size}))
                rows += [(size, k - at, int(_bits(hashes, s)[0])) for s in (-1, k - at)]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["length", "shift", "bit"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for bits in batch.column("bits").to_pylist():
            field = np.zeros(BLOCK_BITS, bool)
            field[np.array(bits, np.int64) % BLOCK_BITS] = True
            out.append(np.packbits(field, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "data"])


def _filter(patterns: DataFrame) -> tuple[dict[int, list[int]], bytes]:
    """(shifts of each length up to GRAM, filter of FILTER_BITS bits) of what _beginnings() gives of the patterns, whatever their number."""
    seen = stored(patterns.select("pattern").mapInArrow(_beginnings, "length int, shift int, bit long").distinct(), "beginnings")
    shifts: dict[int, list[int]] = {}
    for length, shift in seen.select("length", "shift").distinct().collect():  # 2 * GRAM rows at most
        shifts.setdefault(length, []).append(shift)
    blocks = seen.groupBy(F.floor(F.col("bit") / BLOCK_BITS).alias("block")).agg(F.collect_set("bit").alias("bits"))
    size = BLOCK_BITS // 8
    field = bytearray(FILTER_BITS // 8)
    for r in blocks.mapInArrow(_packed, "block long, data binary").collect():
        field[r["block"] * size : (r["block"] + 1) * size] = r["data"]
    return shifts, bytes(field)


def _candidates(shifts: dict[int, list[int]], known) -> Callable:
    """suffix_rows() of the suffixes whose first characters may be a pattern's, or those of a pattern after a multiple of GRAM."""
    names = ["g", "tid", "pos", "left", "gram", "before"]
    lengths, more = set(shifts), max(shifts, default=1) - 1
    back = max((s for own in shifts.values() for s in own), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.frombuffer(known.value, np.uint8)

        def in_filter(bit: np.ndarray) -> np.ndarray:
            return (field[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0

        def made(pieces: list[tuple]) -> pa.RecordBatch:
            """Of pieces (tid, first, text, low) the places from low up to low + CUT."""
            begin = [max(0, low - back) for *_, low in pieces]
            parts = [text[b : low + CUT + more] for (_, _, text, low), b in zip(pieces, begin, strict=True)]
            ends = np.cumsum([len(x) for x in parts])
            hit = np.zeros(ends[-1], bool)
            # a window that goes on into the next piece is a candidate by chance at most
            for length, hashes in _windows("".join(parts), lengths):
                some = np.flatnonzero(in_filter(_bits(hashes, -1)))
                for shift in shifts[length]:
                    at = some[in_filter(_bits(hashes[some], shift))] + shift
                    hit[at[at < len(hit)]] = True
            at = np.flatnonzero(hit)
            piece = np.searchsorted(ends, at, "right")
            offset = at - np.append(0, ends)[piece] - np.array([low - b for (*_, low), b in zip(pieces, begin, strict=True)])[piece]
            inside = (offset >= 0) & (offset < CUT)
            piece, offset = piece[inside], offset[inside]
            tid, first, low, size = (np.array(c, np.int64) for c in zip(*((t, f, l, len(x)) for t, f, x, l in pieces), strict=True))
            pos = low[piece] + offset
            spots = [(pieces[k][2], p) for k, p in zip(piece.tolist(), pos.tolist(), strict=True)]
            grams, before = [t[p : p + GRAM] for t, p in spots], [t[p - 1] if p else "" for t, p in spots]
            return pa.RecordBatch.from_arrays([pa.array(first[piece] + pos), pa.array(tid[piece]), pa.array(pos), pa.array(size[piece] - pos), pa.array(grams, pa.string()), pa.array(before, pa.string())], names)

        for batch in batches:
            pieces, held = [], 0
            for tid, first, text in zip(*(batch.column(c).to_pylist() for c in ("tid", "first", "text")), strict=True):
                for low in range(0, len(text), CUT):
                    pieces.append((tid, first, text, low))
                    held += min(len(text) - low, CUT + more)
                    if held >= ASKED:
                        yield made(pieces)
                        pieces, held = [], 0
            if pieces:
                yield made(pieces)

    return run


def _shared(a: pa.Array, b: pa.Array, width: int) -> np.ndarray:
    """Characters that strings of at most `width` share at their beginnings; -1 for equal ones."""
    size = [pc.utf8_length(x).to_numpy(zero_copy_only=False) for x in (a, b)]
    x, y = (np.array(v.to_pylist() or [""], f"<U{width}").view("<u4").reshape(-1, width)[: len(v)] for v in (a, b))
    differ = x != y
    first = np.where(differ.any(1), differ.argmax(1), width) if len(a) else np.zeros(0, np.int64)
    out = np.minimum(first, np.minimum(*size))
    return np.where((out == size[0]) & (size[0] == size[1]), -1, out)


def _groups(kept: list[str], levels: list[str], width: int, mark: str, limit: int) -> Callable:
    """Sorted rows with their number `i` in the partition; h0, h1, ...: the number of the first row that has the same values of
    the first levels; shared: how many characters of a string level (of `width` at most) the first row of the group has in
    common with the row before it (-2: no row before; without a width this is not told); marked: whether that first row has
    mark < limit; next: whether the row after is in the group.

    edge is 1 for a partition's first row, 2 for its last one (3: both); these keep the levels' values (e0, e1, ...)."""
    depth = range(len(levels))
    names = ["part", "i", *(f"h{k}" for k in depth), "shared", "marked", *kept, "next", "edge", *(f"e{k}" for k in depth)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, heads, marked, common, last, held = TaskContext.get().partitionId(), 0, [0] * len(levels), False, -2, None, None

        def finished(columns: list[pa.Array], values: list[pa.Array], following: np.ndarray, final: bool) -> pa.RecordBatch:
            edge = np.zeros(len(following), np.int32)
            edge[0] += columns[1][0].as_py() == 0
            edge[-1] += 2 * final
            ends = [pc.if_else(pa.array(edge > 0), v, pa.scalar(None, v.type)) for v in values]
            return pa.RecordBatch.from_arrays([*columns, pa.array(following), pa.array(edge), *ends], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            here, same, shared, columns = i + np.arange(n), np.ones(n, bool), np.full(n, -1, np.int32), []
            values = [batch.column(c) for c in levels]
            for k, own in enumerate(values):
                before = pa.concat_arrays([own.slice(0, 1) if last is None else last[k], own.slice(0, n - 1)])
                if width and pa.types.is_string(own.type):
                    shared = _shared(before, own, width).astype(np.int32)
                    same &= shared < 0
                else:
                    same &= pc.equal(before, own).to_numpy(zero_copy_only=False)
                if last is None:
                    same[0], shared[0] = False, -2
                at = np.where(same, -1, here)
                at[0] = heads[k] if same[0] else i
                head = np.maximum.accumulate(at)
                heads[k] = int(head[-1])
                columns.append(pa.array(head))
            low = batch.column(mark).to_numpy() < limit
            if same[0]:
                low[0], shared[0] = marked, common
            at = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
            marks, shared = low[at], shared[at]
            marked, common = bool(marks[-1]), int(shared[-1])
            made = [pa.array(np.full(n, part, np.int32)), pa.array(here), *columns, pa.array(shared), pa.array(marks), *(batch.column(c) for c in kept)]
            if held is not None:
                yield finished(held[0], held[1], np.append(held[2], same[0]), False)
            held = made, values, same[1:]
            last = [v.slice(n - 1, 1) for v in values]
            i += n
        if held is not None:
            yield finished(held[0], held[1], np.append(held[2], False), True)

    return run


def _borders(edges: list, depth: int) -> list[tuple]:
    """(part, rows before it, whether its first group began earlier, shared and marked of its first group, the places where the
    groups of its first row begin, whether its last group goes on) of each partition, from the rows at its edges."""
    by_part: dict[int, list] = {}
    for r in sorted(edges, key=lambda r: (r["part"], r["i"])):
        by_part.setdefault(r["part"], []).append(r)
    rows: list[list] = []
    total, values, ranks, marked, common = 0, None, [], False, -2
    for part, own in by_part.items():
        first, final = own[0], own[-1]
        goes_on, at = values is not None, []
        for k in range(depth):
            goes_on = goes_on and first[f"e{k}"] == values[k]
            at.append(ranks[k] if goes_on else total)
        shared, mark = (common, marked) if goes_on else (-2, first["marked"])
        if not goes_on and values is not None and isinstance(values[0], str):
            pairs = enumerate(zip(first["e0"], values[0], strict=False))
            shared = next((j for j, (x, y) in pairs if x != y), min(len(first["e0"]), len(values[0])))
        if rows:
            rows[-1][-1] = goes_on
        rows.append([part, total, goes_on, shared, mark, at, False])
        ranks = [at[k] if final[f"h{k}"] == 0 else total + final[f"h{k}"] for k in range(depth)]
        marked, common = (mark, shared) if final[f"h{depth - 1}"] == 0 else (final["marked"], final["shared"])
        values = [final[f"e{k}"] for k in range(depth)]
        total += final["i"] + 1
    return [tuple(r) for r in rows]


def in_groups(df: DataFrame, order: list[str], levels: list[str], kept: list[str], what: str, width: int = 0, limit: int = 0, told: dict[str, Column] | None = None) -> DataFrame:
    """df's kept columns (and those told of the sorted rows) with idx, their place in the order; r0, r1, ..., the places where their groups of the first levels begin;
    alone, whether nothing else is in the innermost group; shared and marked as in _groups().

    The levels are the first columns of the order; its last one, a place, is what a group is marked by."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    depth = range(len(levels))
    rows = df.select(*dict.fromkeys([*kept, *levels, *order])).repartitionByRange(*order).sortWithinPartitions(*order)
    if told:
        rows = rows.withColumns(told)
        kept, kinds = [*kept, *told], kinds | {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["part int", "i long", *(f"h{k} long" for k in depth), "shared int", "marked boolean", *(f"{c} {kinds[c]}" for c in kept), "next boolean", "edge int", *(f"e{k} {kinds[c]}" for k, c in enumerate(levels))])
    ranged = stored(rows.mapInArrow(_groups(kept, levels, width, order[-1], limit), schema), what)
    edges = ranged.where("edge > 0").drop(*kept).collect()  # two rows a range at most
    shift = df.sparkSession.createDataFrame(_borders(edges, len(levels)), "part int, offset long, goes_on boolean, first_shared int, first_marked boolean, ranks array<long>, into_next boolean")
    inner, initial = f"h{depth[-1]}", F.col("edge").isin(1, 3)
    in_first = F.col(inner) == 0
    begins = F.when(initial, ~F.col("goes_on")).otherwise(F.col(inner) == F.col("i"))
    followed = F.col("next") | ((F.col("edge") >= 2) & F.col("into_next"))
    return ranged.join(F.broadcast(shift), "part").select(
        *kept,
        (F.col("offset") + F.col("i")).alias("idx"),
        *(F.when(F.col(f"h{k}") == 0, F.col("ranks")[k]).otherwise(F.col("offset") + F.col(f"h{k}")).alias(f"r{k}") for k in depth),
        (begins & ~followed).alias("alone"),
        F.when(in_first, F.col("first_shared")).otherwise(F.col("shared")).alias("shared"),
        F.when(in_first, F.col("first_marked")).otherwise(F.col("marked")).alias("marked"),
    )


SUFFIX = ["g", "tid", "pos", "left", "before"]


def _following(held: list[str], skip: int, width: int) -> Callable:
    """The held columns of a text's spots (g, ...) with gram, the `width` characters that follow `skip` characters after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, spots = _Texts(batch.column("text")), batch.column("spots")
            cells, text = spots.flatten(), pc.list_parent_indices(spots).to_numpy()
            first = batch.column("first").to_numpy()
            for low in range(0, len(text), CUT):
                own, t = cells.slice(low, CUT), text[low : low + CUT]
                at = own.field("g").to_numpy() - first[t] + skip
                grams = texts.cut(t, np.minimum(at, texts.size[t]), np.minimum(at + width, texts.size[t]))
                columns = dict(zip([f.name for f in own.type], own.flatten(), strict=True))
                yield pa.RecordBatch.from_arrays([*(columns[c] for c in held), grams], [*held, "gram"])

    return run


def _followed(rows: DataFrame, texts: DataFrame, skip: int, width: int) -> DataFrame:
    """rows (g, tid, ...) with gram, the `width` characters that follow `skip` characters after their places: each text meets all
    of its own places at once."""
    held = rows.columns
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "gram string"])
    spots = rows.groupBy("tid").agg(F.collect_list(F.struct(*held)).alias("spots"))
    return texts.select("tid", "first", "text").hint("merge").join(spots, "tid").select("first", "text", "spots").mapInArrow(_following(held, skip, width), schema)


def _asked_for(known: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of known (g, ...) with a place (g) that is asked for, and by chance some others.

    The places are told by a field of ASKED_BITS bits, whatever their number; each bit stands for eight neighbouring places
    at a time, as what is asked for goes on for a while. With very many places most rows pass, and never too few."""
    slot = F.pmod(F.xxhash64(F.shiftright("g", 3)), F.lit(ASKED_BITS))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = asked.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    # a row for each 64 bits at most
    got = known.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(words), "word")
    return got.where(F.col("bits").bitwiseAND(bit) != 0).drop("slot", "word", "bits")


def ordered(rows: DataFrame, gram: int = GRAM, limit: int = 0, lead: int = 0, common: bool = False, texts: DataFrame | None = None, since: int | None = None) -> DataFrame:
    """suffix_rows() with sa_rank, their place in the order of their characters (equal ones by g); group, the place where the
    suffixes with the same first characters begin; single, whether a suffix has its first characters to itself; and common: how
    many of those characters are shared with the suffix before the group (-2 for the very first group), which is told only
    if asked for.

    Given the texts (tid, first, text), suffixes that share their first characters are sorted by those that follow, MORE times
    as many, read from the texts: few are left. Suffixes that share h characters are sorted again by the ranks of what
    follows after h, which doubles h; one that is equal to another up to its text's end is done. With a limit only groups
    that hold a suffix of a place below it are sorted out, which is all that is needed to tell where those stand; other
    groups keep some order of their own. Suffixes of higher places may then be missing, if no suffix below the limit begins
    like them, or only empty ones, which any does: one that goes on with a missing one goes on like none below the limit, and
    stands before those that go on, but behind those that end there. With since
    only groups that hold a suffix of a place from it on are sorted out; pending is then where a group begins that was
    left in some order of its own, and null for what has its place. lead: the length of what is put before the first
    characters, which common leaves out."""
    held = [c for c in SUFFIX if c in rows.columns]
    partial, turn = limit != 0 or since is not None, "g" if since is None else "turn"

    def by(df: DataFrame, ended: Column) -> DataFrame:
        """df with what rows of a group are sorted by: their places, but suffixes from since on come first, as a group's first one
        marks it, except where suffixes are equal."""
        return df if since is None else df.withColumn(turn, F.when((F.col("g") >= since) & ~ended, F.col("g") - (1 << 62)).otherwise(F.col("g")))

    # of strings shorter than a gram equal ones are equal to the end
    short = F.length("gram") < gram + lead
    told = {"ended": short} | ({"empty": F.length("gram") == lead} if limit else {})
    first = in_groups(by(rows, short), ["gram", turn], ["gram"], held, "suffix-grams", (gram + lead) * common, limit, told)
    if lead:
        first = first.withColumn("shared", F.greatest(F.col("shared") - lead, F.lit(0)))
    unsettled = ~F.col("alone") & ~F.col("ended") & (F.col("marked") if partial else F.lit(True))
    pending = F.when(~F.col("alone") & ~F.col("ended") & (F.lit(since is not None)), F.col("rank")).alias("pending")
    first = first.withColumnsRenamed({"r0": "group", "shared": "common"}).withColumn("single", F.col("alone"))
    columns = [*held, "group", "common", "single"]
    done = [first.where(~unsettled).withColumn("rank", F.col("group")).select(*columns, F.col("idx").alias("sa_rank"), pending)]
    # what is missing is at -1
    rank = F.when(F.col("empty"), -2).otherwise(F.col("group")) if limit else F.col("group")
    ranks = [first.where(~unsettled).select("g", rank.alias("rank"), "ended")]
    open_ = first.where(unsettled).select(*columns, F.col("group").alias("rank"))
    h = gram
    while not open_.isEmpty():
        if texts is not None and h == gram:
            width = MORE * gram
            pairs = _followed(open_, texts, h, width)
            short = F.length("gram") < width
            again = in_groups(by(pairs, short), ["rank", "gram", turn], ["rank", "gram"], [*columns, "rank"], "suffix-ranks", 0, limit, {"ended": short})
            h += width
        else:
            known = open_.select("g", "rank", F.lit(False).alias("ended"))
            for r in ranks:
                known = known.unionByName(r)
            known = _asked_for(known, open_.select((F.col("g") + h).alias("g")))
            ahead = known.select((F.col("g") - h).alias("g"), F.col("rank").alias("two"), "ended")
            # written tables are larger in memory than as files, by which a side would be judged small enough for the driver
            pairs = open_.hint("merge").join(ahead, "g", "left" if limit else "inner")
            if limit:
                pairs = pairs.withColumns({"two": F.coalesce("two", F.lit(-1)), "ended": F.coalesce("ended", F.lit(True))})
            again = in_groups(by(pairs, F.col("ended")), ["rank", "two", turn], ["rank", "two"], [*columns, "rank", "ended"], "suffix-ranks", 0, limit)
            h *= 2
        again = again.select(*columns, "alone", "ended", "marked", (F.col("rank") + F.col("r1") - F.col("r0")).alias("rank"), (F.col("rank") + F.col("idx") - F.col("r0")).alias("sa_rank"))
        done.append(again.where(~unsettled).select(*columns, "sa_rank", pending))
        ranks.append(again.where(~unsettled).select("g", "rank", "ended"))
        open_ = again.where(unsettled).select(*columns, "rank")
    got = done[0]
    for d in done[1:]:
        got = got.unionByName(d)
    return got if since is not None else got.drop("pending")


def _pieces(size: int) -> Callable:
    """Texts cut into pieces that overlap by as much again: any place has `size` characters more in the piece it falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tid", "piece", "text"]
        for batch in batches:
            rows, held = [], 0
            for tid, text in zip(batch.column("tid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k in range(0, max(1, len(text)), size):
                    rows.append((tid, k // size, text[k : k + 2 * size]))
                    held += len(rows[-1][2])
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.string()]
    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many characters the strings one and two have in common at their beginnings."""
    for batch in batches:
        found = []
        for a, b in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
            low, high = 0, min(len(a), len(b))
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
            found.append(low)
        yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(found, pa.int64())], ["g", "agree"])


def _compared(pairs: DataFrame, texts: DataFrame, start: int) -> DataFrame:
    """(g, lcp) of pairs (g, tid, pos, other_tid, other_pos) of suffixes whose first `start` characters are equal.

    The texts meet the pairs in pieces, which get longer for the pairs that are still equal at a piece's end. Both are shuffled:
    pairs and what is told of them are written tables, far smaller as files than in memory, and grow with the texts."""
    found, off, size = None, start, SPAN
    while True:
        cut = texts.select("tid", "text").mapInArrow(_pieces(size), "tid long, piece long, text string")
        met = pairs
        for side, tid, pos in (("one", "tid", "pos"), ("two", "other_tid", "other_pos")):
            at = F.col(pos) + off
            shown = F.substring("text", (at % size + 1).cast("int"), F.lit(size))
            there = cut.select(F.col("tid").alias("t"), F.col("piece").alias("p"), "text")
            met = met.hint("merge").join(there, (F.col(tid) == F.col("t")) & (F.floor(at / size) == F.col("p")), "left").withColumn(side, F.coalesce(shown, F.lit(""))).drop("t", "p", "text")
        told = stored(met.select("g", "one", "two").mapInArrow(_agreeing, "g long, agree long"), "agreeing")
        done = told.where(F.col("agree") < size).select("g", (F.col("agree") + off).alias("lcp"))
        found = done if found is None else found.unionByName(done)
        more = told.where(F.col("agree") == size)
        if more.isEmpty():
            return found
        pairs = stored(pairs.hint("merge").join(more.select("g"), "g", "left_semi"), "pairs")
        texts = texts.hint("merge").join(pairs.select("tid").unionByName(pairs.select(F.col("other_tid").alias("tid"))).distinct(), "tid", "left_semi")
        off, size = off + size, 4 * size


def common_prefixes(order: DataFrame, texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """ordered() (with common) with lcp: the characters a suffix shares with the one before it in the order, 0 for the first.

    Between groups of the first characters the common beginning is known from the sort. Within one, a suffix that is preceded
    by the same character as its neighbour shares one character less than the suffix a place earlier in its text does with its
    neighbour; only the others are compared with their neighbours' texts. The rest is carried along the texts."""
    inner = order.where(F.col("sa_rank") > F.col("group"))
    above = order.where(~F.col("single")).select((F.col("sa_rank") + 1).alias("sa_rank"), "group", F.col("tid").alias("other_tid"), F.col("pos").alias("other_pos"), F.col("before").alias("other_before"))
    pairs = stored(inner.hint("merge").join(above, ["sa_rank", "group"]), "neighbours")
    ended = F.col("left") < gram
    apart = (F.col("before") == "") | (F.col("other_before") == "") | (F.col("before") != F.col("other_before"))
    told = _compared(pairs.where(apart & ~ended).select("g", "tid", "pos", "other_tid", "other_pos"), texts, gram)
    told = told.unionByName(pairs.where(ended).select("g", F.col("left").alias("lcp")))
    filled = with_last(pairs.select("g").hint("merge").join(told, "g", "left"), ["g"], {"reach": F.col("lcp") + F.col("g")})
    inside = filled.select("g", (F.col("reach") - F.col("g")).alias("within"))
    told = F.greatest(F.col("common"), F.lit(0)).cast("long")
    shared = order.where(~F.col("single")).hint("merge").join(inside, "g", "left").withColumn("lcp", F.coalesce("within", told)).drop("within")
    return order.where("single").withColumn("lcp", told).unionByName(shared.select(*order.columns, "lcp"))


def _own_orders(names: list[str]) -> Callable:
    def ranks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text of each place, its rank in it), the texts' ends included, by ranks of twice as many characters each time."""
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes)
        text, place = np.repeat(np.arange(len(texts)), sizes), np.arange(ends[-1])
        key = np.zeros(ends[-1], np.int64)  # an end is before any character
        key[np.delete(place, ends - 1)] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        rank, h = np.unique((text << 21) + key, return_inverse=True)[1], 1
        while rank.max() + 1 < ends[-1]:
            # what would go on in the next text ended before, and is alone already
            two = np.append(rank[h:], np.zeros(min(h, len(rank)), np.int64))
            rank, h = np.unique(rank * ends[-1] + two, return_inverse=True)[1], 2 * h
        return text, rank - (ends - sizes)[text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, first = [], 0
            for k, text in enumerate([*batch.column("text").to_pylist(), None]):
                if held and (text is None or sum(map(len, held)) + len(text) > CUT):
                    own, rank = ranks(held)
                    pos = np.arange(len(own)) - np.searchsorted(own, own)
                    for low in range(0, len(own), CUT):
                        at = pa.array(first + own[low : low + CUT])
                        keys = [batch.column(c).take(at) for c in names]
                        yield pa.RecordBatch.from_arrays([*keys, pa.array(pos[low : low + CUT]), pa.array(rank[low : low + CUT])], [*names, "pos", "own_rank"])
                    held, first = [], k
                if text is not None:
                    held.append(text)

    return run


def own_orders(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, own_rank): the order of each text's own suffixes, the empty one included. Texts are told apart by nothing but
    their rows, so a task works them where it reads them; null texts have none."""
    rows = texts.where("text is not null").select(*keys, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"), "pos long", "own_rank long"])
    return rows.mapInArrow(_own_orders(keys), schema)


@dataclass
class Found:
    """Patterns among the suffixes: bounds (pattern, low, high, n), where n suffixes stand between low and high; and the order of
    those of the texts' suffixes that were sorted, which these are places in."""

    bounds: DataFrame
    order: DataFrame
    texts: DataFrame
    keys: list[str]

    def occurrences(self) -> DataFrame:
        """(pattern, keys, pos): a row for each suffix between a pattern's bounds.

        Places are listed in pieces, as a few patterns may have most of them. Both sides of the joins are shuffled: the listed places
        are far more than the bounds they come from, by whose size they would be sent to all."""
        pieces = self.bounds.where("n > 0").select("pattern", "high", F.explode(F.sequence(F.col("low") + 1, F.col("high") - 1, F.lit(LISTED).cast("long"))).alias("from"))
        # so many partitions in any case: the pieces are few bytes, and would be put into one
        spread = pieces.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pattern", "from")
        ranks = spread.select("pattern", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + LISTED, F.col("high")) - 1)).alias("sa_rank"))
        named = self.texts.select("tid", *(F.col(f"k{n}").alias(c) for n, c in enumerate(self.keys)))
        return ranks.hint("merge").join(self.order.select("sa_rank", "tid", "pos"), "sa_rank").hint("merge").join(named, "tid").select("pattern", *self.keys, "pos")


def find(texts: DataFrame, patterns: DataFrame, keys: list[str]) -> Found:
    """Where patterns stand in the order of the texts' suffixes; texts: keys, text. patterns: pattern.

    Each pattern is sorted in among the suffixes twice: as it is, before all suffixes that begin with it, and followed by
    more LAST characters than any text has, behind them. Its count is the difference of its places, without looking at an
    occurrence. Patterns may have any length and number; of a long one only every GRAM-th suffix is needed. Of the texts, only
    suffixes that may begin like one of those are sorted: a filter of a fixed size tells, which lets more pass the more
    patterns there are, and never too few. Found.order holds those only. Null texts and empty or null patterns have no
    occurrences; repeated patterns count once."""
    sets = patterns.where("pattern <> ''").select("pattern").distinct()
    most = texts.agg(F.max(F.length("text") - F.length(F.replace(F.col("text"), F.lit(LAST), F.lit(""))))).first()[0] or 0
    both = sets.select("pattern", F.explode(F.array(F.lit(False), F.lit(True))).alias("high"))
    both = both.select("pattern", "high", F.when(F.col("high"), F.concat("pattern", F.lit(LAST * (most + 1)))).otherwise(F.col("pattern")).alias("text"))
    asked = numbered(both, ["pattern", "high"])
    limit = asked.agg(F.max(F.col("first") + F.length("text") + 1)).first()[0] or 0
    named = numbered(texts, keys, start=limit)
    shifts, field = _filter(sets)
    asked_for = named.select("tid", "first", "text").mapInArrow(_candidates(shifts, texts.sparkSession.sparkContext.broadcast(field)), SUFFIX_ROWS)
    order = ordered(suffix_rows(asked, every=GRAM).unionByName(asked_for), limit=limit or -1)
    spots = with_running(order.where(F.col("g") < limit).select("sa_rank", "tid", "pos"), ["sa_rank"], "nth").where("pos = 0")
    place = lambda high: F.max(F.when(F.col("k1") == high, F.struct("sa_rank", "nth")))
    bounds = spots.join(asked.select("tid", "k0", "k1"), "tid").groupBy(F.col("k0").alias("pattern")).agg(place(False).alias("a"), place(True).alias("b"))
    n = (F.col("b.sa_rank") - F.col("a.sa_rank")) - (F.col("b.nth") - F.col("a.nth"))
    bounds = bounds.select("pattern", F.col("a.sa_rank").alias("low"), F.col("b.sa_rank").alias("high"), n.alias("n"))
    return Found(stored(bounds, "pattern-bounds"), order.where(F.col("g") >= limit), named, keys)


def shown_from(rows: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """rows (tid, pos, ...) with shown, the text from pos on, at most `most` characters. Texts meet the rows in pieces."""
    size = max(most, SPAN)
    cut = texts.select("tid", "text").mapInArrow(_pieces(size), "tid long, piece long, text string")
    return rows.withColumn("piece", F.floor(F.col("pos") / size)).join(cut, ["tid", "piece"], "left").withColumn("shown", F.coalesce(F.substring("text", (F.col("pos") % size + 1).cast("int"), F.lit(most)), F.lit(""))).drop("piece", "text")


def named_order(texts: DataFrame, keys: list[str], gram: int = GRAM, common: bool = False, kept: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(ordered() of all suffixes of the texts, the numbered() texts with their keys as k0, k1, ...). kept: those of SUFFIX that are
    asked for, besides g and tid; every other column is carried through all sorting."""
    named = numbered(texts, keys)
    held = SUFFIX if kept is None else ["g", "tid", *kept]
    return ordered(suffix_rows(named, gram, kept=held), gram, common=common, texts=named), named


def with_keys(rows: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their texts' keys instead of tid; without pos, g becomes the place in the text (pos)."""
    names = named.select("tid", *(F.col(f"k{n}").alias(c) for n, c in enumerate(keys)), "first")
    shown = [(F.col("g") - F.col("first")).alias("pos") if c == "g" and "pos" not in rows.columns else c for c in rows.columns if c != "tid"]
    return rows.join(names, "tid").select(*keys, *shown)


def merged_order(order: DataFrame, named: DataFrame, more: DataFrame, keys: list[str], gram: int = GRAM, kept: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(order, numbered texts) of the old texts and more, from the old ones' named_order() (of which g and sa_rank are enough):
    (g, tid, pos, left, before, sa_rank), or of these g, tid, sa_rank and what is kept.

    All suffixes are dealt out by their first characters, which tells where the new ones come between the old ones. Only
    groups that hold a new suffix are sorted on. The old suffixes of any other group stand next to each other in the old order
    too, and take their places from it; no other old rank is read. New texts are numbered behind the old ones, so of equal
    suffixes the old ones come first. Either side may be empty, and the result may be added to again."""
    end, n = named.agg(F.coalesce(F.max(F.col("first") + F.length("text") + 1), F.lit(0)), F.count("*")).first()
    held = SUFFIX if kept is None else ["g", "tid", *kept]
    added = stored(numbered(more, keys, start=end).withColumn("tid", F.col("tid") + n), "added-texts")
    texts = named.unionByName(added)
    got = ordered(suffix_rows(texts, gram, kept=held), gram, texts=texts, since=end)
    left = got.where(F.col("pending").isNotNull())
    old = _asked_for(order.select("g", F.col("sa_rank").alias("old")), left.select("g"))
    both = stored(left.hint("merge").join(old, "g"), "left-as-they-were")
    least = both.groupBy("pending").agg(F.min("old").alias("least"))
    both = both.hint("merge").join(least, "pending").withColumn("sa_rank", F.col("pending") + F.col("old") - F.col("least"))
    got = got.where(F.col("pending").isNull()).select(*held, "sa_rank").unionByName(both.select(*held, "sa_rank"))
    return stored(got, "suffix-order"), texts
