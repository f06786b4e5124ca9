"""Byte-level BPE encoding and decoding with a pair occurrence index.

Within an Arrow batch of a partition the distinct pre-tokens are laid out as one array of symbols. An index maps every
mergeable pair to all its positions; the active ranks are applied in ascending order, each to all its positions at
once, and only the lists of the pairs that a merge touches are updated. Documents are then looked up, not merged."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import flat_ranges, fresh, steps, texts

#: Bytes of text whose distinct pre-tokens are merged together.
BATCH_BYTES = 8 << 20

#: The pre-token pattern of byte-level BPE vocabularies (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else the next unused one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b not in hidden else chr(0x100 + hidden.index(b)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary: tokenizer JSON with vocabulary, merges and added tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_chars()
        to_byte = {c: b for b, c in enumerate(chars)}
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.base = np.array([vocab[c] for c in chars], np.int64)
        self.base_at_end = np.array([vocab[c + suffix] for c in chars], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        keys = self.left * self.size + self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.pieces = [b""] * self.size
        for token, i in vocab.items() if not suffix else ():
            self.pieces[i] = bytes(to_byte[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.pieces[i] = token.encode()
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(PRE_TOKENS)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that never merge."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], -1)

    def merge_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids in each word). data, sizes: the words' bytes in a row, and how many each has."""
        symbol = self.base[data]
        n = len(symbol)
        ends = np.cumsum(sizes)
        symbol[ends[sizes > 0] - 1] = self.base_at_end[data[ends[sizes > 0] - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray) -> None:
            positions = positions[after[positions] >= 0]
            ranks = self._ranks(symbol[positions] * self.size + symbol[after[positions]])
            hit = ranks >= 0
            positions, ranks = positions[hit], ranks[hit]
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts), strict=True):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(part)

        add(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            parts = index.pop(rank)
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of equal symbols every second pair merges, from the left
                at = np.unique(at)
                joined = after[at[:-1]] == at[1:]
                first = np.flatnonzero(np.concatenate(([True], ~joined)))
                nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                at = at[nth % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = new, -1
            after[at] = after[gone]
            follows = after[at] >= 0
            before[after[at][follows]] = at[follows]
            left = before[at]
            left = left[left >= 0]
            add(np.concatenate((left[symbol[left] != new], at)))
        live = symbol >= 0
        counts = np.zeros(len(sizes), np.int64)
        filled = sizes > 0
        if n:
            counts[filled] = np.add.reduceat(live, (ends - sizes)[filled])
        return symbol[live].astype(np.int32), counts


def bytes_of(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 of the words in a row, bytes in each)."""
    coded = [w.encode("utf-8", "surrogatepass") for w in words]
    return np.frombuffer(b"".join(coded), np.uint8), np.fromiter(map(len, coded), np.int64, len(coded))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> ByteBpe:
    return ByteBpe(path)


def _solid(c: str) -> bool:
    """Surely no white space by anyone's definition."""
    return "!" <= c <= "~" or c.isalpha() or c.isdecimal()


class _Units:
    """Distinct stretches of text that pre-tokenise by themselves, by number.

    A text may be cut before a space between two solid characters: a pre-token can only start there."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}

    def of(self, unit: str) -> int:
        return self.number.setdefault(unit, len(self.number))

    def slow(self, text: str) -> list[int]:
        parts = text.split(" ")
        made = [parts[0]]
        for last, part in zip(parts, parts[1:]):
            if last and part and _solid(last[-1]) and _solid(part[0]):
                made.append(" " + part)
            else:
                made[-1] += " " + part
        return [self.of(u) for u in made]

    def of_batch(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(units of all texts in a row, units in each text)."""
        parts = pc.split_pattern(text, " ")
        counts = np.diff(parts.offsets.to_numpy())
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False)
        heads = np.fromiter((bool(w) and _solid(w[0]) for w in words), bool, len(words))
        tails = np.fromiter((bool(w) and _solid(w[-1]) for w in words), bool, len(words))
        ends = np.cumsum(counts)
        first = np.zeros(len(index), bool)
        first[ends - counts] = True
        clean = first | heads[index]
        clean[1:] &= tails[index[:-1]] | first[1:]
        whole = np.logical_and.reduceat(clean, ends - counts) if len(counts) else np.zeros(0, bool)
        used = np.unique(index[np.repeat(whole, counts) & ~first])
        numbers = np.full(len(words), -1, np.int64)
        numbers[used] = [self.of(" " + words[i]) for i in used.tolist()]
        units = numbers[index]
        units[ends - counts] = [self.of(words[i]) if ok else -1 for i, ok in zip(index[ends - counts].tolist(), whole.tolist(), strict=True)]
        if whole.all():
            return units, counts
        lists: list[np.ndarray] = []
        for k, ok in enumerate(whole.tolist()):
            lists.append(units[ends[k] - counts[k] : ends[k]] if ok else np.array(self.slow(text[k].as_py()), np.int64))
        return np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))


def encode_texts(bpe: ByteBpe, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, ids in each text) as the vocabulary's library gives them without special tokens.

    Strings of added tokens inside a text become their ids, as there."""
    units = _Units()
    number, counts = units.of_batch(text)
    if bpe.added_pattern is not None and any(pc.any(pc.match_substring(text, t)).as_py() for t in bpe.added):
        lists, ends = [], np.cumsum(counts)
        for k, has in enumerate(pc.match_substring_regex(text, bpe.added_pattern.pattern).to_pylist()):
            if has:  # negative numbers stand for added tokens
                lists.append(np.array([u for part in bpe.added_pattern.split(text[k].as_py()) if part for u in ([-1 - bpe.added[part]] if part in bpe.added else units.slow(part))], np.int64))
            else:
                lists.append(number[ends[k] - counts[k] : ends[k]])
        number, counts = np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))
    words: dict[str, int] = {}
    find = bpe.pattern.findall
    unit_words = [[words.setdefault(w, len(words)) for w in find(u)] for u in units.number]
    ids, sizes = bpe.merge_words(*bytes_of(words))
    del words
    per_unit = np.fromiter(map(len, unit_words), np.int64, len(unit_words))
    flat = np.fromiter((w for ws in unit_words for w in ws), np.int64, int(per_unit.sum()))
    del unit_words
    word_start = np.cumsum(sizes) - sizes
    # the ids of each unit, then one entry for each added token
    unit_ids = ids[flat_ranges(word_start[flat], sizes[flat])]
    unit_ends = np.cumsum(sizes[flat])
    per_unit_end = np.cumsum(per_unit)
    bounds = np.concatenate(([0], unit_ends))
    unit_start, unit_end = bounds[per_unit_end - per_unit], bounds[per_unit_end]
    added = sorted(bpe.added.values())
    unit_start = np.concatenate((unit_start, len(unit_ids) + np.arange(len(added))))
    unit_end = np.concatenate((unit_end, len(unit_ids) + np.arange(len(added)) + 1))
    unit_ids = np.concatenate((unit_ids, np.array(added, np.int32)))
    if len(number) and number.min() < 0:
        place = {i: len(per_unit) + k for k, i in enumerate(added)}
        negative = number < 0
        number = number.copy()
        number[negative] = [place[-1 - x] for x in number[negative].tolist()]
    lengths = (unit_end - unit_start)[number]
    per_text = np.zeros(len(counts), np.int64)
    filled = counts > 0
    if len(number):
        per_text[filled] = np.add.reduceat(lengths, (np.cumsum(counts) - counts)[filled])
    return unit_ids[flat_ranges(unit_start[number], lengths)], per_text


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): every whole text's ids as a binary of little-endian unsigned 32-bit integers.

    One row per row of docs; a null text counts as empty and has no ids. Other columns are not read. Each batch is
    encoded by itself, so the result does not depend on how rows are dealt out; there is no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in steps(batches, text_col, BATCH_BYTES):
            ids, counts = encode_texts(bpe, texts(batch, text_col))
            ends = np.concatenate(([0], np.cumsum(counts))) * 4
            packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(counts), packed.cast(pa.binary())], [id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded (all columns) plus the decoded text; ids as encode() gives them (null: empty). Bytes that are no UTF-8 become
    U+FFFD. Where a column has the new one's name already, the new one gets a leading underscore."""
    kept, out_col = encoded.columns, fresh(encoded, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(vocab_path).pieces
        for batch in steps(batches, ids_col):
            made = [b"".join([pieces[i] for i in np.frombuffer(x or b"", "<u4").tolist()]).decode("utf-8", "replace") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.string())], [*kept, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, `{out_col}` string")
