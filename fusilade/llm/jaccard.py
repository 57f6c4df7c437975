"""N-gram Jaccard join with count vectors and R-tree bounds.

A document's shingles (``width`` words) are hashed; documents with equal sets form a class. Shingles have a common order, rare ones
first as far as a sketch of fixed size can tell; sets that link share some of their first shingles, so these are the tokens under which
sets meet. Pairs that share enough tokens, and all sets that share a token of many sets, are candidates of each other; a token that many
sets share is reduced to a star, locally first, so that it is a few rows per batch and never gives all its pairs.

Candidates are verified in leaves: sets of a candidate component, ordered by size, of at most ``LEAF`` sets each, and each pair of
leaves whose sizes allow a link is a task. In a task an R-tree indexes the vectors of group counts: it is loaded in bulk, each node split
at the median of the coordinate that varies most, and a node holds the coordinate-wise maxima and the range of sizes. The overlap of a
pair is at most the sum over coordinates of the smaller count: both trees are descended together, node against node, and what is left
is bounded set against set. Pairs that survive are verified on the sets themselves; pairs already connected are skipped, which loses no
component.

Behaviour: null texts and texts without words have no shingles and link with nothing; texts shorter than ``width`` words have one
shingle; repeated rows are in the class of their text; texts that share an id are sets of their own, told apart by class; an empty table
gives an empty result; extra columns are dropped. Shingles are compared by 64-bit hashes, classes by their size and 128 bits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BYTE_WORDS, components, cut, give_back, mix64, n_groups, ranges, spread, table, text_slices, words

WIDTH, PERCENT = 4, 85
DIMS, NODE, LEAST_LEAF, LEAF, FLUSH, MOST_FLUSH = 64, 32, 512, 4096, 600_000, 4_000_000
#: Classes of at least this share of all rows, 1 / COMMON at most, are broadcast with their results.
COMMON = 0.001
#: Cells of the frequency sketch; shared tokens that a light pair needs; classes of a light token.
CELLS, SKETCH_CHUNKS, SHARED, LIGHT = 1 << 22, 64, 4, 16
POLY = 0xD6E8FEB86659FD93
POLY_INV = pow(POLY, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """POLY ** i and POLY ** -i mod 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((POLY, POLY_INV)):
            p = np.full(n + (1 << 16), np.uint64(base))
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def span_sums(data: np.ndarray) -> np.ndarray:
    """Sums from the start, of which ranges' hashes are made."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_WORDS[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit polynomial hashes of byte ranges; ``sums`` are the data's, where they are at hand."""
    inv = powers(len(data) + 1)[1]
    sums = span_sums(data) if sums is None else sums
    return mix64((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def width_hashes(data: np.ndarray, width: int, sums: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of each ``width`` bytes: result[i] covers data[i : i + width]."""
    n = max(len(data) - width + 1, 0)
    return mix64((sums[width : width + n] - sums[:n]) * powers(len(data) + 1)[1][:n])


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of every row, ascending inside the row, and how many each row has."""
    n = len(offsets) - 1
    data = LOWER[data]
    start, end, row = words(data, offsets)
    wh = span_hashes(data, start, end)
    per = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
    counts = np.where(per >= width, per - width + 1, np.minimum(per, 1))
    heads = ranges(first, counts)
    h = np.zeros(len(heads), np.uint64)
    whole = (per >= width)[row[heads]]
    at = heads if whole.all() else heads[whole]
    g = np.zeros(len(at), np.uint64)
    for k in range(width):
        g = mix64(g * np.uint64(3) + wh[at + k] + np.uint64(k + 1))
    h[whole] = g
    if len(at) < len(heads):
        short = row[heads[~whole]]
        s = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = per[short] > k
            s[has] = mix64(s[has] * np.uint64(5) + wh[first[short][has] + k] + np.uint64(k + 77))
        h[~whole] = s
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[(ends - counts)[counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], kept[ends] - kept[ends - counts]


def cell_sums(cell: np.ndarray, value: np.ndarray, cells: int) -> np.ndarray:
    """Sums mod 2**64 by cell; exact, as halves stay below 2**53."""
    lo = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(float), cells).astype(np.uint64)
    hi = np.bincount(cell, (value >> np.uint64(32)).astype(float), cells).astype(np.uint64)
    return lo + (hi << np.uint64(32))


def classes(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of every row's set, as two words."""
    row = np.repeat(np.arange(len(counts)), counts)
    sums = [cell_sums(row, mix64(h ^ np.uint64(salt)), len(counts)) for salt in (0, 0x5BD1E995)]
    size = counts.astype(np.uint64)
    return mix64(mix64(sums[0]) ^ sums[1] + size).view(np.int64), mix64(mix64(sums[1] + np.uint64(1)) ^ sums[0] + size).view(np.int64)


def least_overlap(n, percent: int):
    """Smallest overlap that a set of size n can have with a set it links with: intersection >= percent of the union >= percent of n."""
    return -(-np.asarray(n) * percent // 100)


class Sketch:
    """Counts of shingles by hash cell; of fixed size. It only orders shingles, rare before frequent: any order gives the same links."""

    def __init__(self):
        self.cells = np.zeros(CELLS, np.uint32)
        self.new: list[np.ndarray] = []
        self.held = 0

    def add(self, h: np.ndarray) -> None:
        self.new.append((h & np.uint64(CELLS - 1)).astype(np.uint32))
        self.held += len(h)
        if self.held > CELLS // 2:
            self.count()

    def count(self) -> None:
        if self.held:
            cell, n = np.unique(np.concatenate(self.new), return_counts=True)
            self.cells[cell] += n.astype(np.uint32)
            self.new, self.held = [], 0

    def rows(self):
        """(chunk, compressed counts) of the chunks that are not empty."""
        self.count()
        for k, part in enumerate(self.cells.reshape(SKETCH_CHUNKS, -1)):
            if part.any():
                yield k, zlib.compress(part.astype("<u4").tobytes(), 1)


def sketch_levels(described: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches as a byte per cell, on a logarithmic scale."""

    def total(t: pa.Table) -> pa.Table:
        out = np.zeros(CELLS // SKETCH_CHUNKS, np.uint64)
        for x in t.column("blob").combine_chunks():
            out += np.frombuffer(zlib.decompress(x.as_buffer()), "<u4")
        level = np.minimum(16 * np.log2(1 + out.astype(float)), 255).astype(np.uint8)
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "level": pa.array([level.tobytes()], pa.binary())})

    levels = np.zeros((SKETCH_CHUNKS, CELLS // SKETCH_CHUNKS), np.uint8)
    for k, blob in described.where("chunk >= 0").select("chunk", "blob").groupBy("chunk").applyInArrow(total, "chunk int, level binary").collect():
        levels[k] = np.frombuffer(blob, np.uint8)
    return levels.reshape(-1)


def prefixes(h: np.ndarray, counts: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of every set in the common order, as 40-bit tokens, and the row of each. Sets that link share SHARED of them,
    or as many as their overlap must have where that is less: a prefix leaves out fewer elements than the overlap has, less SHARED."""
    n = len(counts)
    length = np.minimum(counts, counts - least_overlap(counts, percent) + SHARED)
    tokens, rows = [], []
    start = np.concatenate([[0], np.cumsum(counts)])
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        x = h[start[a] : start[b]]
        level = levels[(x & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64)
        row = np.repeat(np.arange(b - a, dtype=np.uint64), counts[a:b])
        key = np.sort(row << np.uint64(48) | level << np.uint64(40) | x >> np.uint64(24))
        at = ranges(start[a:b] - start[a], length[a:b])
        tokens.append(key[at] & np.uint64((1 << 40) - 1))
        rows.append(np.repeat(np.arange(a, b), length[a:b]))
    return (np.concatenate(tokens), np.concatenate(rows)) if tokens else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def by_token(token: np.ndarray, name: np.ndarray, size: np.ndarray):
    """Sorted by (token, class) without repetitions; start and length of each token's run."""
    o = np.lexsort((name, token))
    token, name, size = token[o], name[o], size[o]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
    token, name, size = token[keep], name[keep], size[keep]
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    return token, name, size, head, np.diff(np.append(head, len(token)))


def _pack(token, name, size) -> bytes:
    """Tokens in 5 bytes; classes and sizes by a table."""
    names, first, which = np.unique(name, return_index=True, return_inverse=True)
    parts = [np.array([len(token), len(names)], "<i8"), names.astype("<i8"), size[first].astype("<i4"), which.astype("<u4" if len(names) > 65535 else "<u2"), np.ascontiguousarray(token.astype("<u8").view("u1").reshape(-1, 8)[:, :5])]
    return b"".join(p.tobytes() for p in parts)


def _unpack(buf):
    raw = np.frombuffer(buf, np.uint8)
    n, m = (int(x) for x in raw[:16].view("<i8"))
    names, sizes = raw[16 : 16 + 8 * m].view("<i8"), raw[16 + 8 * m : 16 + 12 * m].copy().view("<i4")
    kind = np.dtype("<u4" if m > 65535 else "<u2")
    at = 16 + 12 * m
    which = raw[at : at + n * kind.itemsize].copy().view(kind)
    token = np.zeros((n, 8), np.uint8)
    token[:, :5] = raw[at + n * kind.itemsize :].reshape(n, 5)
    return token.view("<u8")[:, 0], names[which], sizes[which].astype(np.int64)


def candidates(docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """Edges (a, b) between classes that may link.

    A token of at most ``LIGHT`` classes gives its pairs of fitting sizes; pairs count if they share as many tokens as linked sets must.
    A token of more classes gives a star; whoever shares such a token is in one candidate component with the others."""
    spark = docs.sparkSession
    n_buckets = n_groups(docs)
    most = min(max(FLUSH, 4 * n_buckets), MOST_FLUSH)
    shared = spark.sparkContext.broadcast(levels)  # CELLS bytes

    def out(buckets, blobs):
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def stars(name, head, size):
        heavy = size > LIGHT
        at = ranges(head[heavy] + 1, size[heavy] - 1)
        low = np.repeat(name[head[heavy]], size[heavy] - 1)
        return np.unique(np.stack([name[at], low], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)

    def flush(held):
        token, name, size, head, n = by_token(*(np.concatenate(c) for c in zip(*held, strict=True)))
        edges = stars(name, head, n)
        at = ranges(head, np.minimum(n, LIGHT + 1))  # one more than LIGHT shows that the token is heavy
        token, name, size = token[at], name[at], size[at]
        bucket = ((token ^ (token >> np.uint64(20))) % np.uint64(n_buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        ids = [i for i in range(n_buckets) if ends[i] < ends[i + 1]]
        blobs = [_pack(*(c[order[ends[i] : ends[i + 1]]] for c in (token, name, size))) for i in ids]
        if len(edges):
            side = (mix64(edges[:, 0].copy().view(np.uint64)) % np.uint64(n_buckets)).astype(int)
            for s in np.unique(side):
                ids.append(-1 - int(s))
                blobs.append(edges[side == s].tobytes())
        return out(ids, blobs)

    def map_side(batches):
        held, n = [], 0
        for b in batches:
            for _, _, data, off in text_slices(b.column(0)):
                h, counts = shingles(data, off, width)
                token, row = prefixes(h, counts, shared.value, percent)
                held.append((token, classes(h, counts)[0][row], counts[row]))
                n += len(token)
                if n > most:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)
        give_back()

    def reduce_side(t: pa.Table) -> pa.Table:
        blobs = [x.as_buffer() for x in t.column("blob").combine_chunks()]
        if t.column("bucket")[0].as_py() < 0:
            edges = np.unique(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in blobs]), axis=0)
            return pairs_table(edges, 0, 0)
        _, name, size, head, n = by_token(*(np.concatenate(c) for c in zip(*map(_unpack, blobs), strict=True)))
        edges = stars(name, head, n)
        found = []
        for k in range(2, LIGHT + 1):
            at = head[n == k]
            for i in range(k):
                for j in range(i + 1, k):
                    a, b = size[at + i], size[at + j]
                    ok = (a * 100 >= b * percent) & (b * 100 >= a * percent)
                    found.append((name[at[ok] + i], name[at[ok] + j], np.minimum(SHARED, least_overlap(np.maximum(a, b)[ok], percent))))
        a, b, need = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        o = np.lexsort((b, a))
        a, b, need = a[o], b[o], need[o]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        return pa.concat_tables([pairs_table(edges, 0, 0), pairs_table(np.stack([a[first], b[first]], 1), np.diff(np.append(first, len(a))), need[first])])

    def pairs_table(ab, count, need):
        full = lambda v: pa.array(np.ascontiguousarray(np.broadcast_to(np.asarray(v, np.int64), len(ab))))
        return pa.table({"a": pa.array(np.ascontiguousarray(ab[:, 0])), "b": pa.array(np.ascontiguousarray(ab[:, 1])), "k": full(count), "need": full(need)})

    rows = spread(docs.select("text")).mapInArrow(map_side, "bucket int, blob binary").groupBy("bucket").applyInArrow(reduce_side, "a long, b long, k long, need long")
    # A pair may come from light tokens and, with need 0, from a heavy one.
    return rows.groupBy("a", "b").agg(F.sum("k").alias("k"), F.min("need").alias("need")).where("k >= need").select("a", "b")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on ascending distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    same = int(np.count_nonzero(b[at] == a))
    return 100 * same >= percent * (len(a) + len(b) - same)


class Tree:
    """An R-tree over count vectors, loaded in bulk: level k has 2 ** k nodes, those of the last level hold NODE sets at most.

    ``sets``, ``size``, ``count`` and ``full`` are in the tree's order, ``order`` says where a set came from. A level is its nodes' first
    sets, coordinate-wise maxima, sizes and whether they hold a full coordinate."""

    def __init__(self, sets: list[np.ndarray]):
        count = np.stack([np.minimum(np.bincount((mix64(s) % np.uint64(DIMS)).astype(np.int64), minlength=DIMS), 65535) for s in sets]).astype(np.uint16)
        order, starts, levels = np.arange(len(sets)), np.array([0, len(sets)]), [np.array([0, len(sets)])]
        while np.diff(starts).max() > NODE:
            cuts = [0]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                mid = (i + j) // 2
                part = count[order[i:j]]
                widest = int(part.var(0).argmax())
                order[i:j] = order[i:j][np.argpartition(part[:, widest], mid - i)] if 0 < mid - i < j - i else order[i:j]
                cuts += [int(mid), int(j)]
            starts = np.array(cuts)
            levels.append(starts)
        self.order, self.sets = order, [sets[i] for i in order]
        self.size = np.array([len(s) for s in self.sets])
        self.count = count[order]
        # A coordinate that is full could be larger than it says; the bound is then taken as met.
        self.full = (self.count == 65535).any(1)
        self.levels = [(at[:-1], np.maximum.reduceat(self.count, at[:-1]).astype(np.int64), np.minimum.reduceat(self.size, at[:-1]), np.maximum.reduceat(self.size, at[:-1]), np.logical_or.reduceat(self.full, at[:-1])) for at in levels]
        self.starts = starts


def needed(a, b, percent: int):
    """Smallest overlap of linked sets of these sizes."""
    return np.ceil((np.asarray(a) + np.asarray(b)) * percent / (100 + percent) - 1e-9)


def node_pairs(left: Tree, right: Tree, same: bool, percent: int, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of last-level nodes whose bounds allow a link, by descending both trees together."""
    p = q = np.zeros(1, np.int64)
    at = [0, 0]
    while True:
        (_, top_p, lo_p, hi_p, full_p), (_, top_q, lo_q, hi_q, full_q) = left.levels[at[0]], right.levels[at[1]]
        ok = (hi_p[p] * 100 >= lo_q[q] * percent) & (hi_q[q] * 100 >= lo_p[p] * percent)
        p, q = p[ok], q[ok]
        bound = np.concatenate([np.minimum(top_p[p[k : k + step]], top_q[q[k : k + step]]).sum(1) for k in range(0, len(p), step)]) if len(p) else np.zeros(0)
        ok = (bound >= needed(lo_p[p], lo_q[q], percent)) | full_p[p] | full_q[q]
        p, q = p[ok], q[ok]
        down = [at[0] + 1 < len(left.levels), at[1] + 1 < len(right.levels)]
        if not any(down):
            return p, q
        if down[0]:
            p, q, at[0] = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([q, q]), at[0] + 1
        if down[1]:
            p, q, at[1] = np.concatenate([p, p]), np.concatenate([2 * q, 2 * q + 1]), at[1] + 1
        if same:
            p, q = p[p <= q], q[p <= q]


def tree_join(left: Tree, right: Tree, same: bool, percent: int, tally: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """Edges (i, j) that connect what links, by the sets' places before loading: node bounds, set bounds, then the sets; pairs already
    connected are skipped. ``tally`` counts the pairs that each step leaves."""
    nl, tally = len(left.sets), {} if tally is None else tally
    root = np.arange(nl if same else nl + len(right.sets))
    shift, edges = 0 if same else nl, []
    tally["pairs"] = tally.get("pairs", 0) + (nl * (nl - 1) // 2 if same else nl * len(right.sets))
    for p, q in zip(*node_pairs(left, right, same, percent), strict=True):
        (i0, i1), (j0, j1) = left.starts[p : p + 2], right.starts[q : q + 2]
        a, b = left.count[i0:i1], right.count[j0:j1]
        bound = np.minimum(a[:, None, :], b[None, :, :]).sum(2, dtype=np.int64)
        size_a, size_b = left.size[i0:i1, None], right.size[None, j0:j1]
        ok = (bound >= needed(size_a, size_b, percent)) | left.full[i0:i1, None] | right.full[None, j0:j1]
        ok &= (size_a * 100 >= size_b * percent) & (size_b * 100 >= size_a * percent)
        if same and p == q:
            ok = np.triu(ok, 1)
        tally["nodes"] = tally.get("nodes", 0) + ((i1 - i0) * (i1 - i0 - 1) // 2 if same and p == q else ok.size)
        tally["bounds"] = tally.get("bounds", 0) + int(ok.sum())
        for i in np.flatnonzero(ok.any(1)):
            js = np.flatnonzero(ok[i]) + j0
            i = int(i) + i0
            while len(js := js[root[js + shift] != root[i]]):
                j, js = int(js[0]), js[1:]
                tally["verified"] = tally.get("verified", 0) + 1
                if linked(left.sets[i], right.sets[j], percent):
                    edges.append((int(left.order[i]), int(right.order[j])))
                    root[root == root[j + shift]] = root[i]
    return edges


def leaf_tasks(chosen: DataFrame, percent: int) -> DataFrame:
    """Adds to rows (comp, c1, n, ...) the leaf of each set and its tasks, array of (p, q): the pairs of leaves to be joined.

    A leaf has a sixteenth of its component's sets, between LEAST_LEAF and LEAF."""
    counts = cut(chosen.groupBy("comp", "n").agg(F.count("*").alias("k")))
    by_size = Window.partitionBy("comp").orderBy("n")
    most = F.least(F.lit(LEAF), F.greatest(F.lit(min(LEAST_LEAF, LEAF)), F.ceil(F.sum("k").over(Window.partitionBy("comp")) / 16))).cast("long")
    at = counts.select("comp", "n", "k", (F.sum("k").over(by_size) - F.col("k")).alias("before"), most.alias("most"))
    leaf = F.expr("cast((before + pmod(xxhash64(c1), k)) div most as int)").alias("leaf")
    placed = chosen.join(at, ["comp", "n"]).select(*chosen.columns, leaf)
    bounds = at.withColumn("leaf", F.explode(F.expr("sequence(cast(before div most as int), cast((before + k - 1) div most as int))")))
    bounds = bounds.groupBy("comp", "leaf").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = bounds.alias("x"), bounds.alias("y")
    tasks = x.join(y, (F.col("x.comp") == F.col("y.comp")) & (F.col("x.leaf") <= F.col("y.leaf")) & (F.col("x.hi") * 100 >= F.col("y.lo") * percent))
    tasks = tasks.select(F.col("x.comp").alias("comp"), F.col("x.leaf").alias("p"), F.col("y.leaf").alias("q"))
    sides = tasks.select("comp", F.col("p").alias("leaf"), "p", "q").unionByName(tasks.where("p < q").select("comp", F.col("q").alias("leaf"), "p", "q"))
    return placed.join(sides.groupBy("comp", "leaf").agg(F.collect_list(F.struct("p", "q")).alias("tasks")), ["comp", "leaf"])


_NODE = ("rep", "c1", "c2")


def verified_edges(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of classes, structs of _NODE, from rows (comp, leaf, p, q, rep, c1, c2, n, shingles binary)."""

    def run(t: pa.Table) -> pa.Table:
        leaf, q = t.column("leaf").to_numpy(), t.column("q")[0].as_py()
        p, names = t.column("p")[0].as_py(), [t.column(c).to_numpy() for c in _NODE]
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("shingles").combine_chunks()]
        order = np.lexsort((names[2], names[1], t.column("n").to_numpy()))
        i, j = order[leaf[order] == p], order[leaf[order] == q]
        edges = []
        if p == q:
            tree = Tree([sets[k] for k in i])
            edges = tree_join(tree, tree, True, percent)
        elif len(i) and len(j):
            edges = tree_join(Tree([sets[k] for k in i]), Tree([sets[k] for k in j]), False, percent)
        ends = [i[[u for u, _ in edges]], (i if p == q else j)[[v for _, v in edges]]] if edges else [i[:0]] * 2
        return pa.table({f"{side}_{c}": pa.array(v[e].astype(np.int64)) for side, e in zip("ab", ends, strict=True) for c, v in zip(_NODE, names, strict=True)})

    found = sets.groupBy("comp", "p", "q").applyInArrow(run, ", ".join(f"{side}_{c} long" for side in "ab" for c in _NODE))
    return found.select(*[F.struct(*[F.col(f"{side}_{c}").alias(c) for c in _NODE]).alias(side) for side in "ab"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    names = ["doc", "n", "c1", "c2", "chunk", "blob"]

    def describe(batches):
        sketch = Sketch()
        for b in batches:
            for lo, hi, data, off in text_slices(b.column(1)):
                h, counts = shingles(data, off, width)
                sketch.add(h)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(counts), *map(pa.array, classes(h, counts)), pa.array([-1] * (hi - lo), pa.int32()), pa.nulls(hi - lo, pa.binary())], names=names)
        for k, blob in sketch.rows():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.array([0], pa.int64()),) * 3, pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=names)
        give_back()

    described = cut(spread(docs).mapInArrow(describe, "doc long, n long, c1 long, c2 long, chunk int, blob binary"))
    sets = described.where("chunk < 0").select("doc", "n", "c1", "c2")
    levels = sketch_levels(described)
    reps = sets.where("n > 0").groupBy("n", "c1", "c2").agg(F.min("doc").alias("rep"), F.count("*").alias("rows"))
    comps = components(candidates(docs, levels, width, percent))
    # Leaves and tasks are settled on ids and sizes alone, so that the sets themselves are shuffled once.
    chosen = cut(reps.join(comps.select(F.col("node").alias("c1"), F.col("component").alias("comp")), "c1").select("rep", "comp", "c1", "c2", "n"))
    placed = cut(leaf_tasks(chosen, percent).select("rep", "comp", "c1", "c2", "n", "leaf", "tasks"))
    head = ["comp", "leaf", "tasks", "rep", "c1", "c2", "n"]

    def shingle_rows(batches):
        seen: set[tuple] = set()  # repeated rows of one id, of which a join brings all, stand together
        for b in batches:
            text = b.schema.get_field_index("text")
            want = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("n", "c1", "c2")), strict=True))
            for lo, hi, data, off in text_slices(b.column(text)):
                h, counts = shingles(data, off, width)
                at = np.concatenate([[0], np.cumsum(counts)])
                # An id that several texts share brings in sets of other classes: the class decides.
                keep = []
                for i, got in enumerate(zip(counts.tolist(), *(c.tolist() for c in classes(h, counts)), strict=True)):
                    if got == want[lo + i] and got not in seen:
                        seen.add(got)
                        keep.append(i)
                if len(seen) > 1 << 16:
                    seen.clear()
                taken = b.slice(lo, hi - lo).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns[:text], pa.array([h[at[i] : at[i + 1]].tobytes() for i in keep], pa.binary())], names=[*b.schema.names[:text], "shingles"])
        give_back()

    texts = docs.join(placed, docs["doc"] == placed["rep"]).select(*head, "text")
    again = texts.mapInArrow(shingle_rows, "comp long, leaf int, tasks array<struct<p:int,q:int>>, rep long, c1 long, c2 long, n long, shingles binary")
    again = again.withColumn("task", F.explode("tasks")).select("comp", "leaf", "task.*", *_NODE, "n", "shingles")
    linked_reps = components(verified_edges(again, percent))
    linked_reps = linked_reps.select(*[F.col(f"node.{c}") for c in ("c1", "c2")], F.col("component.rep").alias("component"))
    named = cut(reps.join(linked_reps, ["c1", "c2"], "left").select("n", "c1", "c2", "rows", F.coalesce("component", "rep").alias("component")))
    # Rows of common classes don't meet in one task of a join.
    is_common = F.col("rows") >= max(2.0, COMMON * (named.agg(F.sum("rows")).first()[0] or 0))
    by = ["n", "c1", "c2"]
    out = sets.join(F.broadcast(named.where(is_common).drop("rows")), by, "left")
    rare = out.where("component IS NULL").drop("component").join(named.where(~is_common).drop("rows"), by, "left")
    out = out.where("component IS NOT NULL").select("doc", "n", "component").unionByName(rare.select("doc", "n", "component"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
