"""What the operators of this subpackage share: table access, shared scratch tables and Arrow batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles at a time; a longer text is a step of its own.
STEP_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session that names none (tests) gets a temporary one; on a cluster,
    whose machines share no temporary folder, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="motifmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/motifmill/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that stored() made, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with: its cleaner learns of them only when the driver's
    garbage is collected, which an idle driver may put off for long."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, name: str, *others: str) -> str:
    """name, or a variant of it that neither a column of df nor one of the others has (Spark's names ignore case)."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hand_back() -> None:
    """Returns freed memory to the system: Python workers are reused, and what one task freed should not add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def steps(batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most `limit` bytes of text (or one row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    hand_back()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A text column as pa.string() without nulls (null is the empty text)."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def word_ids(text: pa.Array, split: Callable[[pa.Array], pa.Array]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(document of each word, distinct words, index of each word among them); empty words are left out."""
    parts = split(text)
    words = parts.flatten()
    offsets = parts.offsets.to_numpy()
    doc = np.repeat(np.arange(len(text), dtype=np.int32), np.diff(offsets))
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        keep = ~empty[index]
        doc, index = doc[keep], index[keep]
    return doc, coded.dictionary, index


def ascii_words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """word_ids of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    return word_ids(pc.ascii_lower(text), pc.ascii_split_whitespace)


def starts_of(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Where each document's words start, and their number at the end."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + n) for each start and length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (multiply and shift, three rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F), (32, 0xE7037ED1A0B428DB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def cpu_quiet() -> None:
    """One thread for each task: Spark's slots are the parallelism."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    pa.set_cpu_count(1)
