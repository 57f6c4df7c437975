"""Shared pieces of the training-data operators: table access, checkpoints, byte-level numpy kernels, components."""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; bounds the memory of a Python worker whatever the batch size.
SLICE_BYTES = 1 << 19
M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset a local session gets its own; a cluster's executors could not
    see a driver's folder, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="checkpoints-"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's bytes (file sizes, for a scan); 0 where it has none."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 60 else 0


#: Bytes of input, as Catalyst estimates them, that share a group of a shuffle.
GROUP_BYTES = 64 << 20


def n_groups(df: DataFrame) -> int:
    """Groups to deal an input's hashes to: by bytes, so that a group stays as small whatever the partition setting; two a partition at least."""
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // GROUP_BYTES))


def give_back() -> None:
    """Returns freed memory of a Python worker, which lives on after its task, to the system; where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; survives the loss of executors.

    What the job shuffled is deleted at its end, since nothing reads it again.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a new query, planned under the setting
    finally:
        spark.conf.set(cleanup, before)


def crc_mod(col: str, n: int):
    """crc32 of the column's decimal text, modulo ``n``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when the scan has fewer tasks than the cluster has cores; a round-robin, so no key can be hot."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) whose bytes come to about ``limit``; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, null as empty, without copying where there are no nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8), offsets


def text_slices(col: pa.Array, limit: int = SLICE_BYTES):
    """Yields (lo, hi, bytes, offsets from 0) over a string column."""
    data, offsets = text_buffers(col)
    for lo, hi in slices(offsets, limit):
        a, b = int(offsets[lo]), int(offsets[hi])
        yield lo, hi, data[a:b], offsets[lo : hi + 1] - a


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche mix of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_WORDS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hash(data: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Polynomial hash mod 2**64 of each ``width`` bytes, by doubling; result[i] covers data[i : i + width]."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, length, out, done = BYTE_WORDS[data], 1, None, 0
    while True:
        if width & length:
            if out is None:
                out = power[: len(data) - length + 1]
            else:
                scale = np.uint64(pow(base, done, 1 << 64))
                k = len(data) - (done + length) + 1
                out = power[:k] * scale + out[length : length + k]
            done += length
        if done == width:
            return mix64(out[:n])
        scale = np.uint64(pow(base, length, 1 << 64))
        k = len(data) - 2 * length + 1
        power = power[:k] * scale + power[length : length + k]
        length *= 2


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + length - 1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    ends = np.cumsum(lengths)[:-1]
    step[ends] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and row of each run of bytes other than white space (0x20, 0x09-0x0D); runs never cross rows."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:]] = True
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | last[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


#: Edges that a task of `components` reads of a round's list.
EDGES_A_TASK = 1 << 20


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component = smallest node; only nodes with an edge.

    Alternates large-star and small-star until nothing changes; nodes may be of any type with an order. Each step is a map-side combined
    ``min`` and an equi-join: a hub's edges stream through one task of the join (two ids each, never held together), which adaptive
    execution splits when it is large. The lineage is cut each round, and a round reads its edges in as many tasks as their number asks
    for, one a core at least: the driver keeps a record of every task. Self-loops and nulls are ignored.
    """

    def settle(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = cut(e.where("u > v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        return e.coalesce(max(e.sparkSession.sparkContext.defaultParallelism, -(-now[0] // EDGES_A_TASK))), now

    def two(*pairs):
        return F.inline(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs]))

    e, seen = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    for _ in range(rounds):
        both = e.select(two(("u", "v"), ("v", "u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        e, now = settle(large.join(small_low, "u").select(two(("v", "m"), ("u", "m"))))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


class Union:
    """Union-find over 0 .. n - 1; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
