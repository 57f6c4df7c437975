"""Embedding near-duplicates: exact cosine-threshold links by dual traversal of cover trees.

On unit vectors cosine >= threshold is a distance of at most t = sqrt(2 - 2 * threshold). Equal vectors are one class. The upper part of
the tree is a farthest-first net of a bounded sample; every vector goes to its nearest net point, and a cell keeps its covering radius.
Cells that hold many vectors are dealt into blocks by a hash. Pairs of cells farther apart than their radii and t are pruned; every
other pair of blocks is a task. A task builds a cover tree per block - nested nets with halving radii, each node with its covering
radius - and goes down both trees at once, pruning node pairs by centre distance - radii > t; what is left is compared in double
precision, a bounded matrix at a time.

A task returns link counts and a spanning forest of what it connected, never the pairs of a group, so its output is linear in its rows.

Behaviour: vectors that are null, zero, empty or hold null or non-finite components link with nothing and are their own component;
vectors of different lengths don't link; repeated rows count as links of each other; an empty table gives an empty result; extra
columns are dropped. Components of any finite size are fine: vectors are scaled by their largest one first. In data without structure
(distances that concentrate) bounds prune little and the work is that of all pairs of blocks; it stays exact. There are ``MOST_CELLS``
cells at most, whose net every task and the driver hold; beyond about 25 million vectors cells have several blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table

THRESHOLD, SAMPLE, BLOCK, MOST_BLOCK, MOST_CELLS, NODES, CHUNK = 0.9, 2048, 8192, 1 << 16, 512, 256, 512
#: Vectors held by at least this share of all rows, 1 / COMMON at most, are broadcast with their results.
COMMON = 0.001


def block_size(n: int) -> int:
    """Vectors of a block: more of them in larger tables, as each block travels once per block that it can meet; bounded by memory."""
    return min(max(BLOCK, n // 16), MOST_BLOCK)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, initial=0)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ c.T), 0))


def farthest_first(x: np.ndarray, most: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Net points in the order of farthest-first traversal with the radius at which each came, and each point's nearest net point and distance.
    The prefix with radii above r is an r-net, so prefixes are nested."""
    picked, radii = [0], [2.0]
    near = distances(x, x[:1])[:, 0]
    own = np.zeros(len(x), np.int64)
    while len(picked) < most:
        far = int(near.argmax())
        if near[far] <= stop:
            break
        picked.append(far)
        radii.append(float(near[far]))
        d = distances(x, x[far : far + 1])[:, 0]
        closer = d < near
        own[closer], near = len(picked) - 1, np.minimum(near, d)
    return np.array(picked), np.array(radii), own, near


class CoverTree:
    """Nested levels with halving radii over unit vectors; nodes of the last level hold the points."""

    def __init__(self, x: np.ndarray, t: float, most: int = NODES):
        picked, radii, own, near = farthest_first(x, most, t / 4)
        self.order = np.argsort(own, kind="stable")
        self.starts = np.searchsorted(own[self.order], np.arange(len(picked) + 1))
        self.x = x[self.order]
        centre = x[picked]
        sizes = []
        r = 2.0
        while True:
            r /= 2
            k = max(1, int((radii > r).sum()))
            if not sizes or k > sizes[-1]:
                sizes.append(k)
            if k == len(picked):
                break
        self.levels = [None] * len(sizes)  # (centres, covering radii, first child, children)
        cover = np.zeros(len(picked))
        np.maximum.at(cover, own, near)
        self.levels[-1] = (centre, cover, None)
        for level in range(len(sizes) - 2, -1, -1):
            c, below, rb = centre[: sizes[level]], self.levels[level + 1][0], self.levels[level + 1][1]
            d = distances(below, c)
            parent = d.argmin(1)
            cover = np.zeros(len(c))
            np.maximum.at(cover, parent, d[np.arange(len(below)), parent] + rb)
            o = np.argsort(parent, kind="stable")
            self.levels[level] = (c, cover, (o, np.searchsorted(parent[o], np.arange(len(c) + 1))))

    def children(self, level: int, node: int) -> np.ndarray:
        o, s = self.levels[level][2]
        return o[s[node] : s[node + 1]]


def leaf_pairs(a: CoverTree, b: CoverTree, t: float) -> np.ndarray:
    """Pairs (leaf of a, leaf of b), as a boolean matrix, that can hold points within t of each other."""
    la = lb = 0
    alive = np.ones((len(a.levels[0][0]), len(b.levels[0][0])), bool)
    while True:
        (ca, ra, _), (cb, rb, _) = a.levels[la], b.levels[lb]
        alive &= distances(ca, cb) - ra[:, None] - rb[None, :] <= t + 1e-9
        down_a, down_b = la + 1 < len(a.levels), lb + 1 < len(b.levels)
        if not (down_a or down_b):
            return alive
        if down_a:
            o, s = a.levels[la][2]
            up = np.empty(len(o), np.int64)
            up[o] = np.repeat(np.arange(len(ca)), np.diff(s))
            alive, la = alive[up], la + 1
        if down_b:
            o, s = b.levels[lb][2]
            up = np.empty(len(o), np.int64)
            up[o] = np.repeat(np.arange(len(cb)), np.diff(s))
            alive, lb = alive[:, up], lb + 1


def join_blocks(x: np.ndarray, wx: np.ndarray, y: np.ndarray | None, wy: np.ndarray | None, threshold: float):
    """Links between (or, with y None, inside) blocks: weighted link counts of both sides and forest edges over x then y."""
    t = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    same = y is None
    a = CoverTree(x, t)
    b = a if same else CoverTree(y, t)
    wy = wx if same else wy
    alive = leaf_pairs(a, b, t)
    nx = len(x)
    nx_links, ny_links = np.zeros(nx, np.int64), np.zeros(len(wy), np.int64)
    root = np.arange(nx + (0 if same else len(wy)))
    shift = 0 if same else nx
    edges: list[tuple[int, int]] = []
    leaf_of_b = np.repeat(np.arange(len(b.starts) - 1), np.diff(b.starts))
    p = 0
    while p < len(a.starts) - 1:
        # Leaves in a row that come to a chunk share a product with all columns that any of them needs.
        q = p + 1
        while q < len(a.starts) - 1 and a.starts[q + 1] - a.starts[p] <= CHUNK:
            q += 1
        cols = np.flatnonzero(alive[p:q].any(0)[leaf_of_b])
        if len(cols):
            for lo in range(int(a.starts[p]), int(a.starts[q]), CHUNK):
                hi = min(lo + CHUNK, int(a.starts[q]))
                left = a.x[lo:hi]
                hit = left @ (b.x if len(cols) == len(b.x) else b.x[cols]).T >= threshold
                for r in np.flatnonzero(hit.any(1)):
                    i = int(a.order[lo + r])
                    js = b.order[cols[np.flatnonzero(hit[r])]]
                    js = js[js != i] if same else js
                    if not len(js):
                        continue
                    nx_links[i] += wy[js].sum()
                    ny_links[js] += wx[i] if not same else 0
                    for g in np.unique(root[js + shift]):
                        if g != root[i]:
                            j = int(js[np.flatnonzero(root[js + shift] == g)[0]])
                            edges.append((i, j + shift))
                            root[root == g] = root[i]
        p = q
    return nx_links, ny_links, edges


def matrix(col) -> np.ndarray:
    """Rows of equal-length lists as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def valid(vec: str):
    v = F.col(vec)
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")) & e.isNotNull())
    return v.isNotNull() & fine & F.exists(v, lambda e: e != 0)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    spark = df.sparkSession
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(valid(vec_col), F.lit(False)).alias("ok"))
    reps = cut(df.where("ok").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("w")).withColumn("dim", F.size("v")))
    got = reps.groupBy("dim").agg(F.count("*").alias("n"), F.sum("w").alias("rows")).collect()
    dims, n_rows = {r["dim"]: r["n"] for r in got}, sum(r["rows"] for r in got)
    block = {dim: block_size(n) for dim, n in dims.items()}
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("dim", "rep", "v").collect()
    nets: dict[int, np.ndarray] = {}
    for dim, n in dims.items():
        rows = sorted((r["rep"], r["v"]) for r in sample if r["dim"] == dim)
        cells = min(MOST_CELLS, max(1, 4 * n // (3 * block[dim])))
        x = unit(np.array([v for _, v in rows])) if rows else None
        # Without a sampled vector the zero point is the only centre: at distance 1 from every unit vector.
        nets[dim] = x[farthest_first(x, cells, 0.0)[0]] if rows and cells > 1 else np.zeros((1, dim))

    def assign(batches):
        for b in batches:
            dim = b.column(3).to_numpy(zero_copy_only=False)
            cell, near = np.zeros(len(dim), np.int32), np.zeros(len(dim))
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = unit(matrix(b.column(2).take(pa.array(at))))
                sq = 1 + (nets[d] ** 2).sum(1)[None, :] - 2 * (x @ nets[d].T)
                cell[at], near[at] = sq.argmin(1), np.sqrt(np.maximum(sq.min(1), 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(near)], names=[*b.schema.names, "cell", "near"])

    kind = reps.schema["v"].dataType.simpleString()
    placed = cut(reps.select("rep", "w", "v", "dim").mapInArrow(assign, f"rep long, w long, v {kind}, dim int, cell int, near double"))
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("near").alias("r")).collect()  # at most MOST_CELLS a dimension
    pairs = []
    t = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    for dim in dims:
        own = sorted((u for u in cells if u["dim"] == dim), key=lambda u: u["cell"])
        centre, r = nets[dim][[u["cell"] for u in own]], np.array([u["r"] for u in own])
        for i, u in enumerate(own):
            d = np.sqrt(((centre[i:] - centre[i]) ** 2).sum(1))
            for j in np.flatnonzero(d - r[i:] - r[i] <= t + 1e-9) + i:
                pairs.append((dim, u["cell"], -(-u["n"] // block[dim]), own[j]["cell"], -(-own[j]["n"] // block[dim])))
    tasks = spark.createDataFrame(pairs, "dim int, c int, nc long, d int, nd long")
    tasks = tasks.select("dim", "c", F.explode(F.sequence(F.lit(0), F.col("nc").cast("int") - 1)).alias("p"), "d", "nd")
    tasks = tasks.select("dim", "c", "p", "d", F.explode(F.sequence(F.lit(0), F.col("nd").cast("int") - 1)).alias("q")).where("c < d or p <= q")
    sides = tasks.select("dim", F.col("c").alias("cell"), F.col("p").alias("piece"), "c", "p", "d", "q", F.lit(0).alias("side"))
    sides = sides.unionByName(tasks.where("c < d or p < q").select("dim", F.col("d").alias("cell"), F.col("q").alias("piece"), "c", "p", "d", "q", F.lit(1).alias("side")))
    pieces = spark.createDataFrame([(u["dim"], u["cell"], -(-u["n"] // block[u["dim"]])) for u in cells], "dim int, cell int, pieces long")
    blocks = placed.join(F.broadcast(pieces), ["dim", "cell"]).withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    sent = blocks.select("rep", "w", "v", "dim", "cell", "piece").join(sides, ["dim", "cell", "piece"])

    def run(tb: pa.Table) -> pa.Table:
        side = tb.column("side").to_numpy()
        rep, w, x = tb.column("rep").to_numpy(), tb.column("w").to_numpy(), unit(matrix(tb.column("v")))
        i = np.flatnonzero(side == 0)
        i = i[np.argsort(rep[i])]
        j = np.flatnonzero(side == 1)
        j = j[np.argsort(rep[j])]
        alone = tb.column("c")[0] == tb.column("d")[0] and tb.column("p")[0] == tb.column("q")[0]
        if alone:
            links, _, edges = join_blocks(x[i], w[i], None, None, threshold)
            ids, who = rep[i], [(rep[i], links)]
        elif len(i) and len(j):
            left, right, edges = join_blocks(x[i], w[i], x[j], w[j], threshold)
            ids, who = np.concatenate([rep[i], rep[j]]), [(rep[i], left), (rep[j], right)]
        else:
            ids, who, edges = rep[:0], [], []
        a = np.concatenate([r[n > 0] for r, n in who] + [ids[[u for u, _ in edges]]]) if who else rep[:0]
        n = np.concatenate([n[n > 0] for _, n in who] + [np.zeros(len(edges), np.int64)]) if who else rep[:0]
        b = np.concatenate([r[n_ > 0] for r, n_ in who] + [ids[[v for _, v in edges]]]) if who else rep[:0]
        return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    found = cut(sent.groupBy("dim", "c", "p", "d", "q").applyInArrow(run, "a long, b long, n long"))
    comps = components(found.where("a <> b"))
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    named = reps.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = cut(named.select("v", "w", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    # Rows of common vectors don't meet in one task of a join.
    is_common = F.col("w") >= max(2.0, COMMON * n_rows)
    fine = df.where("ok").join(F.broadcast(named.where(is_common).drop("w")), "v", "left")
    rare = fine.where("component IS NULL").select("id", "v").join(named.where(~is_common).drop("w"), "v")
    fine = fine.where("component IS NOT NULL").select("id", "n_links", "component").unionByName(rare.select("id", "n_links", "component"))
    rest = df.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = fine.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
