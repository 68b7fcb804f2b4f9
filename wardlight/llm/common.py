"""Helpers shared by the training-data operators: Arrow text buffers, word splitting and hashing.

Words are the maximal runs of bytes other than space and \\x09-\\x0D. Those six are single ASCII
bytes, so splitting UTF-8 bytes equals splitting characters.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICE_BYTES = 1 << 20      # text handled at once by the vectorised kernels

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_splits(df: DataFrame) -> int:
    """Number of input partitions: follows the input's size, costs no job."""
    return max(1, df.rdd.getNumPartitions())


def spread_partitions(df: DataFrame, factor: int = 2) -> int:
    """Partition count for an exchange of the whole of ``df``: grows with the input splits."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, factor * input_splits(df))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text each; a longer row is a range of its own."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def split_words(buf: np.ndarray, offs: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words of each row; ``apart`` marks the 256
    byte values that stand between words."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    word = ~apart[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    begin = offs[:-1][offs[:-1] < n]
    first[begin] = word[begin]
    end = offs[1:][offs[1:] > 0] - 1
    last[end] = word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, ends, counts


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Hasher:
    """One family of 64-bit word and word-sequence hashes, fixed by its seed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = rng.integers(1, 2**63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
        self.lowered = self.byte[_LOWER]
        self.power = np.ones(1, np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.power) < n:
            step = np.full(max(n, 2 * len(self.power), 64), self.base[0])
            step[0] = 1
            self.power = np.multiply.accumulate(step)
        return self.power

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """Hash of each word's bytes; ``lower`` folds A-Z first."""
        if len(starts) == 0:
            return np.zeros(0, np.uint64)
        length = ends - starts
        head = np.cumsum(length) - length
        total = int(length.sum())
        shift = np.repeat(starts - head, length)
        at = np.arange(total)
        value = (self.lowered if lower else self.byte)[buf[at + shift]]
        at -= np.repeat(head, length)
        value *= self._powers(int(length.max()))[at]
        return mix64(np.add.reduceat(value, head) + length.astype(np.uint64))

    def windows(self, word_hash: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 places are cut off."""
        n = len(word_hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = word_hash[:n].copy()
        for j in range(1, k):
            out *= self.base[1]
            out += word_hash[j:j + n]
        return mix64(out)


def window_starts(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of each k-word window that stays inside its row, and the row of each window."""
    n = np.maximum(counts - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(counts) - counts
    head = np.cumsum(n) - n
    return np.arange(int(n.sum())) - np.repeat(head, n) + np.repeat(first, n), row


def sample_hash(key: Column, text: Column) -> Column:
    """By which training rows are chosen: equal rows are one, rows that share a key are not."""
    return F.xxhash64(key, text)


def hash_sample(rows: DataFrame, n: int) -> DataFrame:
    """label, hash, i (from 1): per label the n smallest distinct hashes of ``rows`` (label, hash), all if
    there are fewer. Repeated rows are one before the exchange, and no task sends more than n hashes of
    a label on to be ranked."""
    order = Window.partitionBy("label").orderBy("hash")
    return rows.select("label", "hash").distinct().withColumn("i", F.row_number().over(order)).where(F.col("i") <= n)


def sampled_texts(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """label, i, text: one row of ``texts`` (hash, text) per row of ``chosen``, which is small."""
    return texts.join(F.broadcast(chosen), "hash").groupBy("label", "i").agg(F.min("text").alias("text")).orderBy("label", "i")


def text_window(text: Column, key: Column, most: int) -> Column:
    """UTF-8 bytes of a text, of a longer one ``most`` bytes from a place chosen by a hash of its key;
    the window's first and last character may be cut."""
    raw = text.cast("binary")
    spare = F.greatest(F.octet_length(text) - most, F.lit(0))
    return F.substring(raw, (F.pmod(F.xxhash64(key, F.lit(1)), spare + 1) + 1).cast("int"), F.lit(most))


def whole_characters(raw: bytes) -> bytes:
    """A window of UTF-8 bytes without the characters cut at its ends."""
    return bytes(raw).decode(errors="ignore").encode()


_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """One costly object per Python worker, kept for the worker's next tasks until a task needs
    another one, or none."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what earlier tasks of this Python worker kept, and hand free memory back."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Memo(dict):
    """Values of ``compute`` by key, in two generations: when the young one is full it becomes the
    old one, and what is asked for again moves up. Holds at most twice ``size`` keys."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


# The letters, digits and white space of the first 256 code points.
LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_SPACE = "\t-\r \x85\xa0"


def is_latin(text: str) -> bool:
    """Whether all characters are of the first 256 code points."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(values: np.ndarray) -> bytes:
    """Integers as zstd-compressed byte planes."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def expand(blob: bytes, dtype: type) -> np.ndarray:
    size, width = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    if size == 0:
        return np.zeros(0, dtype)
    raw = _ZSTD.decompress(blob[8:], decompressed_size=size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()
