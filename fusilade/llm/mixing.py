"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every row belongs to a block of its source (a hash of the id). A source's target decides how many whole passes of its blocks the mix
takes and which blocks a last, partial pass takes: blocks in a permuted order up to the remainder, the block at the end cut along a
second permutation. The resulting exact block quotas go down a binary tree over the output shards: each node splits its vector of
remaining blocks per source between its halves by a multivariate-hypergeometric draw, so the leaves' quotas add up exactly. Each leaf
then draws the next disjoint run of each source's permuted blocks, and rows are shuffled inside the shard by a hash.

Only per-source sums reach the driver, which splits the top of the tree; tasks split the subtrees. Rows meet their block by an equi-join
on (source, block), and a hot source has as many blocks as its size asks for, ``MOST_BLOCKS`` at most: above 13 billion words of a source
its blocks grow, and the one that the target cuts, whose keys and sizes a task holds, is a 65,536th of it.

Behaviour: a null text has size 0; a null source is a source of its own, ordered last; rows of size 0 are taken as their block is;
rows without id are dealt by their size (by their text, in ``mixed``); repeated rows are placed alike; an empty table gives an empty result; a source without words has target 0; extra columns are kept by
``mixed``. The seed decides every draw, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import cut, table

WEIGHTS, CAP, SEED = (5.0, 2.0, 1.0), 3.0, 20240601
BLOCK_WORDS, SHARD_WORDS, MOST_BLOCKS, NODES = 200_000, 5_000_000, 1 << 16, 256
#: Copies of blocks up to which the table of blocks is broadcast.
BROADCAST_COPIES = 100_000
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(col: str | Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> list[float]:
    """Shares of the total by repeating weights, none above ``cap`` times its size, the excess reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i]
        free -= set(over)
        left -= sum(out[i] for i in over)
    return out


def split_tree(lo: int, hi: int, have: np.ndarray, start: np.ndarray, seed: int, stop: int = 1):
    """Splits the blocks ``have`` [source] of shards lo .. hi - 1 down to nodes of ``stop`` shards: yields (lo, hi, have, start).

    At each node the halves share the blocks by a multivariate-hypergeometric draw, of which a node's seed and place are the only input;
    ``start`` counts the blocks of each source that belong to the shards before."""
    todo = [(lo, hi, have.astype(np.int64), start.astype(np.int64))]
    while todo:
        lo, hi, have, start = todo.pop()
        if hi - lo <= stop:
            yield lo, hi, have, start
            continue
        mid, total = (lo + hi) // 2, int(have.sum())
        take = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if 0 < take < total else (have if take else have * 0)
        todo += [(mid, hi, have - left, start + left), (lo, mid, left, start)]


def quotas(spark: SparkSession, blocks: np.ndarray, n_shards: int, seed: int) -> DataFrame:
    """(__s, shard, lo, hi): each shard's run of every source's permuted blocks. The driver holds ``NODES`` nodes of the tree."""
    stop = max(1, -(-n_shards // NODES))
    nodes = [(lo, hi, have.tolist(), start.tolist()) for lo, hi, have, start in split_tree(0, n_shards, blocks, blocks * 0, seed, stop)]
    top = spark.createDataFrame(nodes, "lo long, hi long, have array<long>, start array<long>")

    def run(frames):
        for g in frames:
            for lo, hi, have, start in g.itertuples(index=False):
                for shard, _, n, at in split_tree(lo, hi, np.asarray(have), np.asarray(start), seed):
                    s = np.flatnonzero(n)
                    yield pd.DataFrame({"__s": s.astype(np.int32), "shard": np.full(len(s), shard, np.int32), "lo": at[s], "hi": at[s] + n[s]})

    return top.repartition(min(len(nodes), 64)).mapInPandas(run, "__s int, shard int, lo long, hi long")


def _block_columns(df: DataFrame, sources: DataFrame, source_col: str, id_col: str, size_col: str, seed: int) -> DataFrame:
    """Adds the source's numbers, the row's block and the key of the second permutation."""
    df = df.join(sources, F.col(source_col).eqNullSafe(F.col("__source")), "left").drop("__source")
    own = lambda n: F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(n), F.col(id_col))).otherwise(F.xxhash64(F.lit(n), F.col(size_col)))
    return df.withColumn("__block", F.pmod(own(seed), F.col("__blocks"))).withColumn("__key", own(seed + 1))


def _fill(g, size_col: str):
    """Which rows of a block that is cut the last pass takes: those with lows[i] <= key <= limits[i] and size <= gaps[i] for some i.

    Up the permuted keys, each row that fits the gap left is taken (rows of one key and fitting sizes together), so at the end no row
    left out fits. A round is a run of keys under one gap. One block of a source is cut, so a hot source is never gathered.
    """
    ids = g[["__s", "__block"]].iloc[:1].reset_index(drop=True)
    gap, lows, limits, gaps = float(g["want"].iloc[0]), [], [], []
    g = g.sort_values("__key")
    key, size = g["__key"].to_numpy(), g[size_col].to_numpy()
    while gap > 0:
        key, size = key[size <= gap], size[size <= gap]
        if not len(key):
            break
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        total = np.cumsum(size)[ends]
        n = int(np.searchsorted(total, gap, "right"))
        if n:
            lows.append(int(key[0]))
            limits.append(int(key[ends[n - 1]]))
            gaps.append(gap)
            gap -= float(total[n - 1])
        at = ends[max(n, 1) - 1] + 1
        key, size = key[at:], size[at:]
    return ids.assign(lows=[lows], limits=[limits], gaps=[gaps])


def plan(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights=WEIGHTS, cap=CAP, seed=SEED, block_words=BLOCK_WORDS, shard_words=SHARD_WORDS) -> DataFrame:
    """Every row of ``df`` with ``source_size``, ``target`` and ``placements``: array of (copy, shard), one per time that the mix takes it."""
    spark = df.sparkSession
    stats = cut(df.select(F.col(id_col), F.col(source_col), F.col(size_col)))
    got = sorted(((r[0], int(r[1])) for r in stats.groupBy(source_col).agg(F.sum(size_col)).collect()), key=lambda r: (r[0] is None, str(r[0]).encode() if r[0] is not None else b""))
    aims = targets([n for _, n in got], weights, cap)
    total = sum(n for _, n in got)
    rows = []
    for k, ((name, n), aim) in enumerate(zip(got, aims, strict=True)):
        passes = int(aim // n) if n else 0
        passes -= passes and aim - passes * n < 0
        rows.append((name, k, n, float(aim), max(1, min(MOST_BLOCKS, n // block_words)), passes, float(aim - passes * n)))
    kind = df.schema[source_col].dataType
    schema = T.StructType([T.StructField("__source", kind), T.StructField("__s", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("__blocks", T.LongType()), T.StructField("__passes", T.IntegerType()), T.StructField("__rest", T.DoubleType())])
    sources = spark.createDataFrame(rows, schema)
    if len(rows) <= 20_000:
        sources = F.broadcast(sources)
    small = _block_columns(stats, sources, source_col, id_col, size_col, seed)

    # Blocks in permuted order; which of them the last pass takes whole, and which one it cuts.
    order = Window.partitionBy("__s").orderBy(F.xxhash64(F.lit(seed + 2), "__s", "__block"), "__block")
    blocks = small.groupBy("__s", "__block", "__passes", "__rest").agg(F.sum(size_col).alias("words"))
    blocks = blocks.withColumn("end", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("start", F.col("end") - F.col("words"))
    whole, part = F.col("end") <= F.col("__rest"), (F.col("start") < F.col("__rest")) & (F.col("end") > F.col("__rest"))
    blocks = cut(blocks.select("__s", "__block", "__passes", whole.alias("whole"), part.alias("part"), (F.col("__rest") - F.col("start")).alias("want")))
    limit = small.join(blocks.where("part").select("__s", "__block", "want"), ["__s", "__block"]).groupBy("__s", "__block").applyInPandas(
        lambda g: _fill(g, size_col), "__s int, __block long, lows array<long>, limits array<long>, gaps array<double>")

    # Block copies per source down the tree; each shard's run of the permuted copies.
    copies = blocks.withColumn("copy", F.explode(F.when(F.col("whole") | F.col("part"), F.sequence(F.lit(0), F.col("__passes"))).when(F.col("__passes") > 0, F.sequence(F.lit(0), F.col("__passes") - 1)).otherwise(F.array().cast("array<int>"))))
    copies = copies.withColumn("rank", F.row_number().over(Window.partitionBy("__s").orderBy(F.xxhash64(F.lit(seed + 3), "__s", "__block", "copy"), "__block", "copy")) - 1)
    count = np.zeros(len(rows), np.int64)
    for s, n in copies.groupBy("__s").count().collect():
        count[s] = n
    n_shards = max(1, round(total / shard_words))
    runs = quotas(spark, count, n_shards, seed)
    shards = runs.select("__s", "shard", F.explode(F.transform(F.sequence("lo", F.col("hi") - 1), lambda x: x.cast("int"))).alias("rank"))
    copies = copies.join(shards, ["__s", "rank"])
    per_block = copies.groupBy("__s", "__block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("__all"), F.first("__passes").alias("__full"), F.max("part").alias("__part"))
    per_block = cut(per_block.join(limit, ["__s", "__block"], "left"))
    if count.sum() <= BROADCAST_COPIES:  # a row a block, and as many placements in all
        per_block = F.broadcast(per_block)
    out = _block_columns(df, sources.drop("__passes", "__rest"), source_col, id_col, size_col, seed).join(per_block, ["__s", "__block"], "left")
    taken = F.exists(F.arrays_zip("lows", "limits", "gaps"), lambda x: (F.col("__key") >= x["lows"]) & (F.col("__key") <= x["limits"]) & (F.col(size_col) <= x["gaps"]))
    kept = F.filter("__all", lambda p: ~F.col("__part") | (p["copy"] < F.col("__full")) | F.coalesce(taken, F.lit(False)))
    out = out.withColumn("placements", F.coalesce(kept, F.array().cast("array<struct<copy:int,shard:int>>")))
    return out.drop("__s", "__block", "__blocks", "__key", "__all", "__full", "__part", "lows", "limits", "gaps")


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the columns of ``df``, a row per time taken, sorted by a hash inside each shard."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))  # whole, so that no name of it can clash
    rows = row.select("__row", F.coalesce(F.col(f"__row.`{id_col}`"), F.xxhash64(F.col(f"__row.`{text_col}`")).cast(df.schema[id_col].dataType)).alias("__id"), F.col(f"__row.`{source_col}`").alias("__src"), n_words(F.col(f"__row.`{text_col}`")).alias("__size"))
    p = plan(rows, "__id", "__src", "__size", **options).select("__row", "__id", F.explode("placements").alias("__p"))
    p = p.withColumn("__order", F.xxhash64(F.lit(options.get("seed", SEED) + 4), "__id", "__p.copy"))
    return p.repartition("__p.shard", F.pmod("__order", F.lit(16))).sortWithinPartitions("__p.shard", "__order").select("__row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size"))
    taken = (F.col("size") * F.size("placements")).alias("taken")
    return plan(docs).select("doc_id", "size", "source_size", "target", taken, F.size("placements").alias("copies"), F.col("placements.shard").alias("shards"))
