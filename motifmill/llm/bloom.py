"""Bloom filters in bounded shards: built in one task a shard, broadcast or left in the shared folder, and probed one shard at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Bits of a shard and its number of bit insertions, at half of the bits set or less: the memory of one shard is 2 MiB.
SHARD_BITS = 1 << 24
SHARD_LOAD = 11_000_000
#: Added to a key's hash for its shard, so that shards and bit positions are independent.
SHARD_SALT = 0x5851F42D4C957F2D


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(keys + np.uint64(SHARD_SALT)) % np.uint64(shards)).astype(np.int32)


def bit_positions(keys: np.ndarray, probes: int, bits: int = SHARD_BITS) -> Iterator[np.ndarray]:
    """The positions of each key's probes (double hashing)."""
    one = mix64(keys)
    two = (one >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64(bits - 1)
    for i in range(probes):
        with np.errstate(over="ignore"):
            yield ((one + np.uint64(i) * two) & mask).astype(np.int64)


def filled(keys: np.ndarray, probes: int, bits: int = SHARD_BITS) -> bytes:
    """A filter that holds the keys, eight bits a byte."""
    field = np.zeros(bits, bool)
    for at in bit_positions(keys, probes, bits):
        field[at] = True
    return np.packbits(field, bitorder="little").tobytes()


def contains(filter_bits: np.ndarray, keys: np.ndarray, probes: int) -> np.ndarray:
    if not len(filter_bits):
        return np.zeros(len(keys), bool)
    found = np.ones(len(keys), bool)
    for at in bit_positions(keys, probes, 8 * len(filter_bits)):
        found &= (filter_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return found


def broadcast_rows(df: DataFrame, shards: int) -> list[Broadcast]:
    """A broadcast for each shard of (shard, bits), in order (empty bits where a shard has no row).

    The driver holds one row at a time; the rows should be stored, as partitions are fetched one after the other."""
    sc = df.sparkSession.sparkContext
    found = {row[0]: sc.broadcast(bytes(row[1])) for row in df.toLocalIterator()}
    return [found.get(k) or sc.broadcast(b"") for k in range(shards)]


class SharedShard:
    """A shard that tasks read from its file in the shared folder (None: empty), as often as they come to it."""

    def __init__(self, path: str | None):
        self.path = path

    @property
    def value(self) -> bytes | pa.Buffer:
        if self.path is None:
            return b""
        if "_value" not in self.__dict__:
            system, path = fs.FileSystem.from_uri(self.path)
            with system.open_input_file(path) as file:
                self._value = pq.ParquetFile(file).read(columns=["data"], use_threads=False).column(0)[0].as_buffer()
        return self._value

    def __getstate__(self) -> dict:
        return {"path": self.path}


def shared_rows(df: DataFrame, shards: int) -> list[SharedShard]:
    """The shards of (shard, data), a stored table whose tasks wrote one row each, in order. Only the files' names come to the
    driver, and the data go to the tasks without it."""
    found = dict(df.select("shard", F.input_file_name()).collect())
    return [SharedShard(found.get(k)) for k in range(shards)]


def one_by_one(shards: Iterable[Broadcast | SharedShard]) -> Iterator[bytes | pa.Buffer]:
    """The shards' values; a Python worker keeps the value only if it is the only one."""
    shards = list(shards)
    for shard in shards:
        yield shard.value
        if len(shards) > 1:
            shard.__dict__.pop("_value", None)
