"""Edit scripts and CIGAR strings of string pairs; distances are Spark's own levenshtein()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a pair's table up to which pairs are worked together, and cells that are held at a time.
SHORT, CELLS = 1 << 14, 1 << 20


def _rows(x: np.ndarray, y: np.ndarray, first: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
    """Rows low + 1 ... high of the table of costs to turn the first characters of x into those of y; first is row low."""
    at, row = np.arange(len(y) + 1, dtype=np.int32), first
    for i in range(low, high):
        best = row + 1
        np.minimum(best[1:], row[:-1] + (y != x[i]), out=best[1:])
        row = np.minimum.accumulate(best - at) + at  # additions carry over from the left
        yield row


def operations(a: str, b: str) -> str:
    """The edit operations that turn a into b, a letter each: M equal, X other, D only in a, I only in b.

    Of equally cheap ways the one that goes back diagonally first, then drops from a, then adds from b. The table is filled
    row by row, and only about the square root of its rows are kept; on the way back the rows between two of these are made
    again. Two texts of 20,000 characters take some 25 MB."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (a, b))
    step = max(1, int(len(x) ** 0.5))
    kept = [np.arange(len(y) + 1, dtype=np.int32)]
    for i, row in enumerate(_rows(x, y, kept[0], 0, len(x)), 1):
        if i % step == 0:
            kept.append(row)
    i, j, out = len(x), len(y), []
    while i or j:
        low = max(0, i - 1) // step * step
        rows = [kept[low // step], *_rows(x, y, kept[low // step], low, i)]
        while j and i == 0 or i > low:
            here = rows[i - low]
            above = rows[i - low - 1] if i > low else None
            if above is not None and j and here[j] == above[j - 1] + (x[i - 1] != y[j - 1]):
                out.append("M" if x[i - 1] == y[j - 1] else "X")
                i, j = i - 1, j - 1
            elif above is not None and here[j] == above[j] + 1:
                out.append("D")
                i -= 1
            else:
                out.append("I")
                j -= 1
    return "".join(reversed(out))


def _together(a: list[str], b: list[str]) -> list[str]:
    """operations() of many short pairs: one table for all, filled and walked back side by side."""
    codes = [np.array(t).astype(f"<U{max(1, *map(len, t))}").view("<u4").reshape(len(t), -1) for t in (a, b)]
    (x, y), r = codes, np.arange(len(a))
    i, j = (np.array([len(s) for s in t], np.int64) for t in (a, b))
    at = np.arange(y.shape[1] + 1, dtype=np.int32)
    table = np.empty((x.shape[1] + 1, len(a), len(at)), np.int32)
    table[0] = at
    for k in range(x.shape[1]):
        best = table[k] + 1
        np.minimum(best[:, 1:], table[k][:, :-1] + (y != x[:, k : k + 1]), out=best[:, 1:])
        table[k + 1] = np.minimum.accumulate(best - at, axis=1) + at
    out = []
    while (live := (i > 0) | (j > 0)).any():
        up, before = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        here, same = table[i, r, j], x[r, up] == y[r, before]
        both = (i > 0) & (j > 0) & (here == table[up, r, before] + ~same)
        drop = ~both & (i > 0) & (here == table[up, r, j] + 1)
        add = live & ~both & ~drop
        out.append(np.select([both & same, both, drop, add], [ord(c) for c in "MXDI"], 0).astype(np.uint8))
        i, j = i - (both | drop), j - (both | add)
    letters = np.array(out[::-1], np.uint8).reshape(len(out), len(a)).T.tobytes().decode("ascii")
    return [letters[k * len(out) : (k + 1) * len(out)].lstrip("\0") for k in range(len(a))]


def all_operations(a: list, b: list) -> list:
    """operations() of each pair; a null side gives null. Short pairs of like lengths are worked together."""
    found: list = [None] * len(a)
    cells = lambda k: (len(a[k]) + 1) * (len(b[k]) + 1)
    held = sorted((k for k in range(len(a)) if a[k] is not None and b[k] is not None), key=lambda k: (len(a[k]), len(b[k])))
    group: list[int] = []
    wide = high = 0

    def done() -> None:
        for k, ops in zip(group, _together([a[k] for k in group], [b[k] for k in group]) if group else [], strict=True):
            found[k] = ops

    for k in held:
        if cells(k) > SHORT:
            found[k] = operations(a[k], b[k])
            continue
        w, h = max(wide, len(a[k]) + 1), max(high, len(b[k]) + 1)
        if group and (w * h > 4 * SHORT or w * h * (len(group) + 1) > CELLS):
            done()
            group, w, h = [], len(a[k]) + 1, len(b[k]) + 1
        group.append(k)
        wide, high = w, h
    done()
    return found


def script(a: str, b: str, ops: str) -> str:
    """The operations as 'place character': places count b from 0; a's letter where it differs, its small letter where only a
    has one, D where only b has one. Equal strings give an empty text."""
    i = j = 0
    said = []
    for o in ops:
        if o == "X":
            said.append(f"{j} {a[i]}")
        elif o == "D":
            said.append(f"{j} {a[i].lower()}")
        elif o == "I":
            said.append(f"{j} D")
        i, j = i + (o != "I"), j + (o != "D")
    return " ".join(said)


def cigar(ops: str) -> str:
    """Run lengths of M (equal or other), I and D."""
    out, last, n = [], "", 0
    for c in [*("M" if o == "X" else o for o in ops), ""]:
        if c != last:
            out.append(f"{n}{last}" if n else "")
            last, n = c, 0
        n += 1
    return "".join(out)


def aligned(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs plus distance, ops, cigar and edits; a null side gives nulls. For pairs of names and reads, not of whole books:
    a pair's table has a cell for each two characters."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ops = all_operations(frame[a].tolist(), frame[b].tolist())
            edits = [None if o is None else script(x, y, o) for x, y, o in zip(frame[a], frame[b], ops, strict=True)]
            yield frame.assign(ops=ops, cigar=[None if o is None else cigar(o) for o in ops], edits=edits)

    return pairs.mapInPandas(run, f"{schema}, ops string, cigar string, edits string").withColumn("distance", F.levenshtein(a, b))


def tab_line(name: str, ref: str, pos: str, length: str, strand: str) -> Column:
    """A tab-separated alignment row with a 1-based start."""
    return F.concat_ws("\t", name, ref, (F.col(pos) + 1).cast("string"), (F.col(pos) + F.col(length)).cast("string"), strand)


def sam_line(name: str, ref: str, pos: str, cigar_col: str, seq: str, reverse: str) -> Column:
    """A SAM row; flag 16 marks the reverse strand."""
    return F.concat_ws("\t", name, F.when(F.col(reverse), "16").otherwise("0"), ref, (F.col(pos) + 1).cast("string"), F.lit("255"), cigar_col, F.lit("*"), F.lit("0"), F.lit("0"), seq, F.lit("*"))
