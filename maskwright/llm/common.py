"""Helpers shared by the corpus operators: shared scratch tables, checked broadcasts, text slices."""

from __future__ import annotations

import ctypes
import gc
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a table that may be sent to every executor; a table beyond it is joined by a shuffle.
BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session names none (a local test session) is a temporary folder set up.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="maskwright-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    It cuts the lineage, so what stands above is never computed twice, and a lost executor costs
    only a rerun of the tasks that were reading the table.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that ``materialize`` has written and nobody has removed.
_written: list[str] = []


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _written.remove(path)


def remove_written(spark: SparkSession, but: DataFrame | None = None) -> None:
    """Delete the tables written so far, but for the one that ``but`` reads; for when nothing reads them any more."""
    kept = {f.split("/")[-2] for f in but.inputFiles()} if but is not None else set()
    _remove(spark, [p for p in _written if p.rpartition("/")[2] not in kept])


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave and that nothing reads any more, and what ``collect`` finds."""
    names = {f.split("/")[-2] for t in tables for f in t.inputFiles()}
    _remove(tables[0].sparkSession, [p for p in _written if p.rpartition("/")[2] in names])
    collect(tables[0].sparkSession)


def collect(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of all that has ended.

    It does so once the driver's garbage collector finds a shuffle unreachable, which may take longer than
    all the steps of an operator.
    """
    gc.collect()
    spark._jvm.System.gc()


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most ``rows`` rows, else df as it is (shuffled join).

    df should be cheap to count: an aggregate of a materialized table, or one itself.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key counts as hot if more than one in HOT_SHARE of all rows have it, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE, HOT_LEAST = 10_000, 1_000
#: Bits of a bit table for each key, and bits of the largest table (16 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 27


def rejoin(rows: DataFrame, summed: DataFrame, key: str | list[str], count: str = "n", how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with a written table that has a row a key and ``count``, the number of rows of that key.

    Hot keys, fewer than HOT_SHARE whatever the size, are broadcast, so no task gets all rows of one;
    the rest are shuffled. The count column is dropped.
    """
    total = summed.agg(F.sum(count)).first()[0] or 0
    limit = max(HOT_LEAST, total // HOT_SHARE)
    keys = [key] if isinstance(key, str) else key
    hot, cold = summed.where(F.col(count) > limit).drop(count), summed.where(F.col(count) <= limit).drop(count)
    if hot.isEmpty():
        return rows.join(cold, keys, how)
    hot = F.broadcast(hot)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))


def might_match(rows: DataFrame, keys: DataFrame, key: str, rest: bool = False) -> DataFrame:
    """rows without most of those whose ``key`` isn't in ``keys``, a written table; none is lost that is in it. rest: just the other rows.

    A table of bits, BITS_A_KEY for each key and MOST_BITS at most, is broadcast as 64-bit words; beyond
    that size it lets more through, which the join behind it sorts out.
    """
    n = keys.count()
    bits = min(MOST_BITS, 1 << max(10, (BITS_A_KEY * n - 1).bit_length() if n else 10))
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(bits))
    word = F.shiftright(place(key), 6)
    table = keys.groupBy(word.alias("_bits_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`, 7), {bits}) & 63 as int))")).alias("_bits"))
    set_ = F.expr(f"(shiftrightunsigned(_bits, cast(pmod(xxhash64(`{key}`, 7), {bits}) & 63 as int)) & 1) = 1")
    if rest:
        return rows.join(F.broadcast(table), word == F.col("_bits_word"), "left").where(~F.coalesce(set_, F.lit(False))).drop("_bits_word", "_bits")
    return rows.join(F.broadcast(table), word == F.col("_bits_word")).where(set_).drop("_bits_word", "_bits")


class Manifests:
    """Numbered manifest files in a shared folder; the highest number is the state that counts.

    A manifest is created, never overwritten, so of two writers only one can publish a number.
    """

    def __init__(self, spark: SparkSession, root: str, empty: dict):
        self.spark, self.root, self.empty = spark, root, empty

    def _at(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> tuple[int, dict]:
        folder, fs = self._at("manifests")
        numbers = [int(x.getPath().getName()) for x in fs.listStatus(folder)] if fs.exists(folder) else []
        if not numbers:
            return 0, self.empty
        path, fs = self._at(f"manifests/{max(numbers):08d}")
        stream = fs.open(path)
        try:
            return max(numbers), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, manifest: dict) -> None:
        """Write a manifest beside its place, then move it there unless another writer was first."""
        own, fs = self._at(f"pending-{uuid.uuid4().hex}")
        stream = fs.create(own)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        place, _ = self._at(f"manifests/{number:08d}")
        fs.mkdirs(place.getParent())
        if fs.exists(place) or not fs.rename(own, place):
            raise RuntimeError("another writer has committed meanwhile; apply the batch again")

    def remove(self, path: str) -> None:
        """Delete a table that no manifest names any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text: Column) -> Column:
    """Number of white-space separated words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- texts in numpy -----------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def space(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return _SPACE[data]


def trim() -> None:
    """Give memory that a Python worker has freed back to the system; a worker waits for its next task with all that it holds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if give:
        give(0)


#: Bytes of text that are worked on at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of the base's inverse."""
    base = _BASE_INVERSE if inverse else _BASE
    have = _powers[base]
    if len(have) < n:
        size = max(1 << (n - 1).bit_length(), 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SLICE_BYTES:  # a longer one serves one long text and goes
            _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of a slice of documents as byte ranges, and 64-bit hashes of them.

    data: bytes of all texts, one after the other. bounds: where each text begins, and the end.
    start, end: byte range of each word. first: index of each document's first word, and the end.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray | None = None):
        self.data, self.bounds = data, bounds
        inside = is_word[data] if is_word is not None else ~_SPACE[data]
        edge = bounds[:-1][bounds[:-1] < len(data)]
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes: a polynomial over the bytes, then mixed with the length."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
        own = (total[self.end] - total[self.start]) * powers(n, inverse=True)[self.start]
        return mix64(own ^ ((self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values (len(values) - width + 1 of them)."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n), out=total[1:])
    return mix64((total[width:] - total[:-width]) * powers(n, inverse=True)[: n - width + 1])


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a text column as (from, to, bytes, bounds), about ``limit`` bytes each.

    Null counts as an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:  # filling copies the whole batch
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices starts[i] .. starts[i] + lengths[i] - 1, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    jump[begin] = starts
    jump[begin[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(jump)
