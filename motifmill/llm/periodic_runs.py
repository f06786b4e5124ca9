"""Periodic runs of words (tandem repeats) by block convolution.

A run of period q is looked for at the dyadic scale B with B <= q < 2B: the words are cut into blocks of B, and a run of
at least three periods holds a whole block whose next occurrence is q words on. The squared differences of a block's word
numbers and every place of the window that follows it are a convolution, taken exactly modulo a prime by a number-theoretic
transform; where they add up to zero the block occurs again, and the distance is a seed. Consecutive blocks with the same
distance form a chain; chains that a run of a smaller scale covers are its multiples, the others are compared word by word
and extended to both sides. A difference that is zero only modulo the prime is found out by that comparison.

A document is one row's work: its words are numbered and convolved a step of texts at a time, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import fresh, starts_of, steps, texts, word_ids

#: 3 * 2^30 + 1, a prime whose products fit 64 bits, and a generator of its units: transforms of up to 2^30 places.
PRIME, GENERATOR = 3 * (1 << 30) + 1, 5
P = np.uint64(PRIME)
#: Numbers that are transformed at a time (one block more is never split).
CHUNK = 1 << 17
#: Shortest run, and the least number of periods in it.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text whose words are numbered together.
TEXT_STEP = 2 << 20


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo the prime; n is a power of two."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), PRIME)) % P))
    return out


@lru_cache(maxsize=8)
def _twiddles(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The factors of each layer of a transform of n places, from the widest layer, and their inverses from the narrowest."""
    halves = [n >> k for k in range(1, n.bit_length())]
    roots = [pow(GENERATOR, (PRIME - 1) // (2 * h), PRIME) for h in halves]
    there = [_powers(r, h)[:, None] for r, h in zip(roots, halves, strict=True)]
    back = [_powers(pow(r, PRIME - 2, PRIME), h)[:, None] for r, h in zip(roots, halves, strict=True)]
    return there, back[::-1]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, in place."""
    x -= x // P * P
    return x


def transform(x: np.ndarray) -> np.ndarray:
    """Each column's number-theoretic transform, in bit-reversed order; x (n, columns) is used up."""
    for w in _twiddles(len(x))[0]:
        v = x.reshape(-1, 2, len(w), x.shape[1])
        a, b = v[:, 0], v[:, 1]
        total, apart = a + b, a + (P - b)
        np.minimum(apart, apart - P, out=apart)
        apart *= w
        v[:, 1] = _reduced(apart)
        v[:, 0] = np.minimum(total, total - P)
    return x


def transform_back(x: np.ndarray) -> np.ndarray:
    """The columns whose transform x is, times their length."""
    for w in _twiddles(len(x))[1]:
        v = x.reshape(-1, 2, len(w), x.shape[1])
        a, b = v[:, 0], v[:, 1] * w
        _reduced(b)
        total, apart = a + b, a + (P - b)
        v[:, 0] = np.minimum(total, total - P)
        v[:, 1] = np.minimum(apart, apart - P)
    return x


def zero_mismatches(x: np.ndarray, squares: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, index of start) where the block at a start occurs again at block <= distance < 2 * block, modulo the prime.

    x: numbers below the prime, with at least 3 * block more after the last start. squares: their squares' running sums
    modulo the prime, one longer."""
    n, at = 2 * block, np.arange(2 * block)[:, None]
    own = np.zeros((n, len(starts)), np.uint64)
    own[0] = x[starts]
    if block > 1:
        own[block + 1 :] = x[starts + at[block - 1 : 0 : -1]]  # place i of the block stands at -i
    window = x[starts + block + at]
    window[n - 1] = 0
    product = transform(own)
    product *= transform(window)
    cross = transform_back(_reduced(product))[:block]
    cross += cross
    np.minimum(cross, cross - P, out=cross)
    far = starts + block + at[:block]
    sums = _reduced(squares[starts + block] + (P - squares[starts]) + squares[far + block] + (P - squares[far]))
    place, which = np.nonzero(_reduced(sums * np.uint64(n)) == cross)
    return place + block, which


def _chains(distance: np.ndarray, block_no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, first block, blocks) of the longest stretches of consecutive blocks with the same distance."""
    order = np.lexsort((block_no, distance))
    d, j = distance[order], block_no[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(d)), bool), (d[1:] != d[:-1]) | (j[1:] != j[:-1] + 1))))
    return d[new], j[new], np.diff(np.append(new, len(d)))


def runs_of(codes: np.ndarray, ends: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, end, period) of all runs in several word sequences laid end to end, by start, then period.

    codes: a number below the prime for each word; ends: the end of each word's sequence. A run is a stretch with smallest
    period q, of at least max(least, periods * q) words, that cannot be made longer; periods is 3 at least."""
    if periods < 3:
        raise ValueError("runs of fewer than three periods need not hold a whole block")
    n = len(codes)
    begins = np.concatenate(([0], ends[:-1]))[np.searchsorted(ends[:-1], ends, "left")] if n else ends  # ends repeat within a sequence
    sizes = ends - begins
    longest = int(sizes.max(initial=0))
    found: dict[tuple[int, int], int] = {}
    block = 1
    if longest >= max(least, periods):
        widest = 1 << (longest // periods).bit_length() - 1
        x = np.concatenate((codes.astype(np.uint64), np.zeros(4 * widest, np.uint64)))
        squares = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_reduced(x * x))))
        _reduced(squares)
    while periods * block <= longest and longest >= least:
        starts = np.arange(0, n, block)
        starts = starts[(sizes[starts] >= max(least, periods * block)) & (starts + 2 * block <= ends[starts])]
        seeds = []
        wide = max(1, CHUNK // (2 * block))
        for k in range(0, len(starts), wide):
            part = starts[k : k + wide]
            d, which = zero_mismatches(x, squares, part, block)
            inside = part[which] + block + d <= ends[part[which]]
            seeds.append((d[inside], part[which[inside]] // block))
        if seeds:
            d, j, m = _chains(*(np.concatenate(c) for c in zip(*seeds, strict=True)))
            need = np.maximum(least, periods * d) - d  # words that equal the one a period on
            keep = m >= np.maximum(1, (need - block + 1) // block)
            if found:  # what a run of a smaller scale covers has a multiple of its period
                spans = np.array(sorted(found))
                reach = np.concatenate(([-1], np.maximum.accumulate(spans[:, 1])))
                keep &= reach[np.searchsorted(spans[:, 0], j * block, "right")] < (j + m) * block + d
            for k in np.flatnonzero(keep).tolist():
                dist, low, wanted = int(d[k]), int(j[k]) * block, int(need[k])
                lo, hi = max(int(begins[low]), low - block), min(int(ends[low]) - dist, low + (int(m[k]) + 1) * block)
                breaks = np.flatnonzero(codes[lo:hi] != codes[lo + dist : hi + dist]) + lo
                edges = np.concatenate(([lo - 1], breaks, [hi]))
                for s in np.flatnonzero(np.diff(edges) - 1 >= wanted).tolist():
                    found.setdefault((int(edges[s]) + 1, int(edges[s + 1]) + dist), dist)
        block *= 2
    return np.array(sorted((s, e, q) for (s, e), q in found.items()), np.int64).reshape(-1, 3)


def _greatest(starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> int:
    """The run of greatest length / period, compared exactly; of equal ones the first by start, then period."""
    best = 0
    for k in range(1, len(starts)):
        if int(lengths[k]) * int(periods[best]) > int(lengths[best]) * int(periods[k]):
            best = k
    return best


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """docs (all columns) plus n_words, runs (start, length, period of each, by start, then period), best (the run of greatest
    length / period; ties: smallest start, then period) and collapsed: the words, joined by one space, without those that
    a run repeats after its first period.

    Words are stretches of bytes other than \\x20 and \\x09-\\x0D, compared as they stand. Null and empty texts have no
    words, no runs, a null best and an empty collapsed text; repeated rows and null ids are rows like others, an empty
    table gives an empty one. Where a column has one of the new names already, the new one gets a leading underscore."""
    names = docs.columns
    added: list[str] = []
    for c in ("n_words", "runs", "best", "collapsed"):
        added.append(fresh(docs, c, *added))
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col, TEXT_STEP):
            doc, words, index = word_ids(texts(batch, text_col), pc.ascii_split_whitespace)
            n = batch.num_rows
            at = starts_of(doc, n)
            found = runs_of(index, at[1:][doc], least, periods)
            owner = doc[found[:, 0]] if len(found) else np.zeros(0, np.int64)
            start, length, period = found[:, 0] - at[owner], found[:, 1] - found[:, 0], found[:, 2]
            bounds = np.searchsorted(owner, np.arange(n + 1))
            best = [bounds[k] + _greatest(start[a:b], length[a:b], period[a:b]) if b > a else None for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]
            repeats = np.zeros(len(index) + 1, np.int64)
            np.add.at(repeats, found[:, 0] + found[:, 2], 1)
            np.add.at(repeats, found[:, 1], -1)
            kept = np.cumsum(repeats)[:-1] == 0
            left = pa.ListArray.from_arrays(pa.array(np.searchsorted(np.flatnonzero(kept), at).astype(np.int32)), words.take(pa.array(index[kept])))
            rows = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(at)), lists, rows.take(pa.array(best, pa.int64())), pc.binary_join(left, " ")], [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    one = "struct<start:bigint,length:bigint,period:bigint>"
    return docs.mapInArrow(run, f"{schema}, `{added[0]}` long, `{added[1]}` array<{one}>, `{added[2]}` {one}, `{added[3]}` string")


def with_periodic_tails(docs: DataFrame, hash_col: str, text_col: str = "text") -> DataFrame:
    """docs whose rows with hash_col % 10 = 0 get a periodic tail: with g = hash_col // 10 and n words, those from a = g % n on
    repeat the words at a ... a + p - 1, p = 1 + (n - a) // (3 + g % 8). Words are then joined by one space.

    Texts without words and rows with a null hash stay as they are. No shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            values = batch.column(text_col).to_pylist()
            for k, h in enumerate(batch.column(hash_col).to_pylist()):
                if h is None or h % 10 or not (words := (values[k] or "").encode().split()):
                    continue
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                tail = words[a : a + p]
                words[a:] = (tail * ((n - a) // p + 1))[: n - a]
                values[k] = b" ".join(words).decode()
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()) if c == text_col else batch.column(c) for c in names], names)

    return docs.mapInArrow(run, docs.schema)
