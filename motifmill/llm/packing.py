"""Packing of documents into sequences of bounded length by order-preserving dynamic programming.

Documents are laid end to end in stored order, an end-of-document id after each. A window of the stream is cut only at
document ends and sentence ends (and inside overlong sentences), so that sequences, padding and truncation penalties
together cost least. The cost of a window is linear in its start, so its best start is the head of a monotone queue."""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import bytes_of, vocabulary
from .common import cpu_quiet, flat_ranges, steps, texts

SEQUENCE = 2048
END_ID = 1
#: What a cut costs, in padded tokens: at a sentence end, inside a sentence. At a document's end it is free.
SENTENCE_CUT, INNER_CUT = 3, 12
#: A sentence of over 1 / LONG of a sequence may be cut inside, at steps of half of that.
LONG = 64
#: Ids of documents that are packed together; a longer document is a block of its own.
BLOCK_IDS = 1_000_000
#: Bytes of text whose distinct words are encoded together.
BATCH_BYTES = 4 << 20

#: The pre-token pattern of the word vocabulary (fixed value).
WORD_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"

#: Stretches that need no pattern: a word of Latin-1 letters (stable under NFC, lower case letter by letter), then marks.
MARKS = ".,;:!?|"
PLAIN = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{MARKS}]*$"


class WordCoder:
    """Ids of texts under a lower-casing word BPE vocabulary that drops white space.

    Stretches between spaces encode independently of each other, so each distinct one is normalised (NFC, lower case,
    character by character) and cut into pre-tokens once; distinct pre-tokens are merged by the pair occurrence index.
    Stretches that hold the string of an added token are left to the tokenizers library."""

    def __init__(self, path: str) -> None:
        cpu_quiet()
        from tokenizers import Tokenizer

        self.library, self.bpe = Tokenizer.from_file(path), vocabulary(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.sentence_end = np.zeros(1 + max(vocab.values()), bool)
        self.sentence_end[[i for t, i in vocab.items() if t.endswith("</w>") and t[:-4] and set(t[:-4]) <= set(".!?")]] = True
        self.find = regex.compile(WORD_PRE_TOKENS).findall

    def _pre_tokens(self, unit: str) -> list[str]:
        unit = unicodedata.normalize("NFC", unit)
        return self.find("".join(c.lower() for c in unit) if "\u03a3" in unit else unit.lower())

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids in each text)."""
        parts = pc.split_pattern(pc.replace_substring(text, "\n", " "), " ")
        counts = np.diff(parts.offsets.to_numpy())
        coded = parts.flatten().dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        # most stretches are a Latin word and perhaps a mark after it: two pre-tokens, found without Python
        plain = pc.match_substring_regex(distinct, PLAIN)
        low = pc.utf8_lower(pc.filter(distinct, plain))
        pair = pa.concat_arrays([pc.utf8_rtrim(low, MARKS), pc.replace_substring_regex(low, f"^[^{MARKS}]+", "")]).dictionary_encode()
        known, offsets = pair.dictionary, np.frombuffer(pair.dictionary.buffers()[1], np.int32)[pair.dictionary.offset :][: len(pair.dictionary) + 1] if len(pair.dictionary) else np.zeros(1, np.int32)
        data = np.frombuffer(known.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
        plain_words = pair.indices.to_numpy(zero_copy_only=False).reshape(2, -1)
        # the others by pattern
        others = pc.filter(distinct, pc.invert(plain)).to_pylist()
        words: dict[str, int] = {}
        special = {k for k, u in enumerate(others) if any(t in u for t in self.bpe.added)}
        unit_words = [[len(known) + words.setdefault(w, len(words)) for w in self._pre_tokens(u)] if k not in special else [] for k, u in enumerate(others)]
        more, more_sizes = bytes_of(words)
        flat_ids, sizes = self.bpe.merge_words(np.concatenate((data, more)), np.concatenate((np.diff(offsets).astype(np.int64), more_sizes)))
        is_plain = plain.to_numpy(zero_copy_only=False)
        per_unit = np.zeros(len(distinct), np.int64)
        per_unit[is_plain] = 2
        per_unit[~is_plain] = np.fromiter(map(len, unit_words), np.int64, len(unit_words))
        unit_end = np.cumsum(per_unit)
        flat = np.zeros(int(unit_end[-1]) if len(unit_end) else 0, np.int64)
        at = (unit_end - per_unit)[is_plain]
        flat[at], flat[at + 1] = plain_words
        flat[flat_ranges((unit_end - per_unit)[~is_plain], per_unit[~is_plain])] = np.fromiter((w for ws in unit_words for w in ws), np.int64)
        ids = flat_ids[flat_ranges((np.cumsum(sizes) - sizes)[flat], sizes[flat])].astype(np.uint32)
        bounds = np.concatenate(([0], np.cumsum(sizes[flat])))
        starts, lengths = bounds[unit_end - per_unit], bounds[unit_end] - bounds[unit_end - per_unit]
        for k in special:
            got = np.array(self.library.encode(others[k], add_special_tokens=False).ids, np.uint32)
            nth = np.flatnonzero(~is_plain)[k]
            starts[nth], lengths[nth] = len(ids), len(got)
            ids = np.concatenate((ids, got))
        each = lengths[index]
        per_text = np.add.reduceat(each, np.cumsum(counts) - counts) if len(counts) else np.zeros(0, np.int64)
        return ids[flat_ranges(starts[index], each)], per_text


@lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def best_cuts(ends: np.ndarray, sentence_ends: np.ndarray, size: int = SEQUENCE) -> list[int]:
    """Where a stream is cut: positions from 0 to the stream's end, at most `size` apart, of least total cost.

    ends: the documents' ends, rising, the last one the stream's. sentence_ends: further places to cut. A window costs
    `size` for being a sequence, its padding (size - n at length n, none at a power of two) and what its end's cut costs:
    short windows without padding are taken only where they save a sequence's worth of it."""
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return [0]
    at = np.union1d(np.concatenate(([0], ends)), sentence_ends)
    step = max(1, size // (2 * LONG))
    wide = np.flatnonzero(np.diff(at) > max(2 * step, size // LONG))
    if len(wide):
        inner = (np.diff(at)[wide] - 1) // step
        at = np.union1d(at, flat_ranges(np.zeros(len(wide), np.int64), inner) * step + np.repeat(at[wide] + step, inner))
    penalty = np.full(len(at), INNER_CUT)
    penalty[np.isin(at, sentence_ends)] = SENTENCE_CUT
    penalty[np.isin(at, ends)] = 0
    # starts of windows whose length is a power of two below `size`
    place = np.full(total + 1, -1, np.int32)
    place[at] = np.arange(len(at))
    targets, sources = [], []
    power = 1
    while power < size:
        j = np.flatnonzero(at >= power)
        i = place[at[j] - power]
        targets.append(j[i >= 0])
        sources.append(i[i >= 0])
        power *= 2
    target, source = np.concatenate(targets), np.concatenate(sources)
    order = np.argsort(target, kind="stable")
    target, source = [*target[order].tolist(), len(at)], source[order].tolist()
    nth = 0
    where, extra = at.tolist(), penalty.tolist()
    cost, came = [0] * len(where), [0] * len(where)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, index), rising in both
    for j in range(1, len(where)):
        x = where[j]
        while where[queue[0][1]] < x - size:
            queue.popleft()
        best, i = queue[0]
        best += size - x
        while target[nth] == j:
            k = source[nth]
            nth += 1
            if cost[k] < best:
                best, i = cost[k], k
        best += extra[j] + size
        cost[j], came[j] = best, i
        key = best + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [len(where) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return [where[i] for i in reversed(cuts)]


def _pieces(ids: np.ndarray, counts: np.ndarray, coder: WordCoder, size: int) -> tuple[np.ndarray, ...]:
    """Of a block of documents: (document, start, length, sequence, offset, position in the block) of each piece."""
    ends = np.cumsum(counts)
    sentences = np.flatnonzero(coder.sentence_end[ids]) + 1
    cuts = np.array(best_cuts(ends, sentences, size))
    at = np.union1d(cuts, ends[:-1])
    at = at[at < ends[-1]]
    length = np.diff(np.append(at, ends[-1]))
    doc = np.searchsorted(ends, at, side="right")
    sequence = np.searchsorted(cuts, at, side="right") - 1
    return doc, at - (ends - counts)[doc], length, sequence, at - cuts[sequence], at


def pack(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents, each id in one piece.

    A document's ids are the tokenizer's, then end_id; ids holds a piece's as little-endian unsigned 32-bit integers,
    start counts the document's ids before it, offset those before it in its sequence. Null and empty texts are one
    end_id; repeated rows are packed like others; rows with a null id are packed under null; an empty table gives no
    pieces. The order of documents is that of the stored rows of each input split, which are packed by themselves in
    blocks of bounded length; there is no shuffle, and a task that is run again gives the same pieces."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, next_sequence = word_coder(vocab_path), TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            nonlocal next_sequence
            names = pa.concat_arrays([x[0] for x in held])
            ids, counts = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            held.clear()
            doc, start, length, sequence, offset, at = _pieces(ids, counts, coder, size)
            bounds = pa.py_buffer(np.append(at, len(ids)).astype(np.int64) * 4)
            taken = pa.Array.from_buffers(pa.large_binary(), len(at), [None, bounds, pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
            sequence = sequence + next_sequence
            next_sequence = int(sequence[-1]) + 1
            columns = [names.take(pa.array(doc)), pa.array(start), pa.array(length), taken, pa.array(counts[doc]), pa.array(sequence), pa.array(offset)]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        waiting = 0
        for batch in steps(batches, text_col, BATCH_BYTES):
            ids, counts = coder.ids(texts(batch, text_col))
            ends = np.cumsum(counts + 1)
            with_end = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
            inside = np.ones(len(with_end), bool)
            inside[ends - 1] = False
            with_end[inside] = ids
            held.append((batch.column(id_col), with_end, counts + 1))
            waiting += len(with_end)
            if waiting >= BLOCK_IDS:
                yield packed()
                waiting = 0
        if held:
            yield packed()

    schema = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
