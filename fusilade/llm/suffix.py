"""Removal of long byte strings that earlier documents hold, with suffix arrays of shards built by induced sorting.

Where two documents share a string of ``width`` bytes, both choose the same anchor in it: the leftmost smallest hash among its
``SEED``-byte substrings. Windows with the same anchor form a block. Anchors meet by their hash; equal blocks are settled at once (all
but the smallest document lose the block's windows), locally first, so a passage that many documents hold is a row per batch. Where an
anchor has several different blocks that may share a window, the distinct blocks become the text of a shard. Its suffix array is built
by induced sorting: suffixes are classified, leftmost-smaller (LMS) substrings sorted as packed words and named, the string of names
sorted in the same way, and the order induced to the L and then the S suffixes, once a level. Permuted common prefixes between neighbours in the array then group the
windows that are equal; each group's smallest document keeps them.

``copies`` is how many documents of equal blocks, those of the smallest ids, go on to the shards; only the others are settled by the hash
of the block. Any number gives the same result; without a bound (None) a shard holds a group of copies whole.

An anchor with very many distinct blocks is spread over several shards; each gives the smallest document of every distinct window, and
those meet by the window's hash.

Behaviour: null texts are empty; texts shorter than ``width`` lose nothing; matches never cross rows; rows that share an id don't remove
each other's strings, whether they repeat one text or hold several, and each loses what documents of smaller ids hold: a row is known by
its id and a 64-bit hash of its text; rows without id lose and remove nothing; an empty table gives an empty result; extra columns are
kept by ``dedup``, except that columns named as its results are replaced. Blocks are compared by 96 bits of hash, windows inside a shard
bytewise, windows of a spread anchor by 128 bits between shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, mix64, n_groups, ranges, spread, table, text_slices, window_hash
from .jaccard import span_hashes, span_sums, width_hashes

WIDTH, SEED, COPIES = 50, 20, 1
FLUSH, MOST_FLUSH, SHARD_BLOCKS, SHARD_BYTES = 400_000, 4_000_000, 20_000, 1 << 19
#: Bits of a seed's and of a block's hash that are compared and sent.
SEED_BITS, BLOCK_BITS = np.uint64(0xFFFFFFFFFF000000), np.uint64(0xFFFFFFFFFFFFFF00)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, seed: int = SEED):
    """Blocks of each row: (seed hash, block hash, row, first window's offset in the row, number of windows, sides).

    A window of two blocks of one seed has half of its other bytes or more on one side of the seed: ``sides`` are 16 bits of the hashes of
    that many bytes before and after it, so blocks that agree on neither side share no window. A side that a block doesn't reach is 0."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros((0, 2), np.uint16)
    if len(data) < width:
        return none
    sums = span_sums(data)
    h = width_hashes(data, seed, sums)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = width - seed + 1
    out, done = low, 1
    while done < span:
        step = min(done, span - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    p = (out[: len(data) - width + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    per_row = np.maximum(np.diff(offsets) - width + 1, 0)
    i = ranges(offsets[:-1], per_row)
    if not len(i):
        return none
    row = np.repeat(np.arange(len(per_row)), per_row)
    pi = p[i]
    first = np.ones(len(i), bool)
    first[1:] = (pi[1:] != pi[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(first)
    n = np.diff(np.append(head, len(i)))
    start, at = i[head], pi[head]
    block = mix64(span_hashes(data, start, start + n + width - 1, sums) + (at - start).astype(np.uint64))
    half = (width - seed + 1) // 2
    sides = np.zeros((len(at), 2), np.uint16)
    reach = (at - start >= half), (start + n + width - 1 - (at + seed) >= half)
    for side, ok, place in ((0, reach[0], at - half), (1, reach[1], at + seed)):
        sides[ok, side] = span_hashes(data, place[ok], place[ok] + half, sums) >> np.uint64(48) | np.uint64(1) if half else 1
    return h[at], block, row[head], start - offsets[row[head]], n, sides


# --- suffix array of a shard -------------------------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the next one. The end of the text is smaller than everything."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    up = t[change] < t[change + 1]
    at = np.searchsorted(change, np.arange(n), "left")
    s = np.zeros(n, bool)
    inside = at < len(change)
    s[inside] = up[at[inside]]
    return s


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array from the sorted LMS suffixes: L suffixes bucket by bucket upwards, then S suffixes downwards; each step takes all of a
    bucket's suffixes at hand at once, in order."""
    n = len(t)
    l_in: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    s_in: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    lms_char = t[lms]
    order = np.argsort(lms_char, kind="stable")
    lms_by = np.split(lms[order], np.searchsorted(lms_char[order], np.arange(1, symbols)))

    def give(j: np.ndarray, into: list[list[np.ndarray]]) -> None:
        c = t[j]
        o = np.argsort(c, kind="stable")
        j, c = j[o], c[o]
        cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
        for part in np.split(j, cuts):
            if len(part):
                into[int(t[part[0]])].append(part)

    def before(x: np.ndarray, s: bool) -> np.ndarray:
        j = x[x > 0] - 1
        return j[s_type[j] == s]

    last = np.array([n - 1])  # the suffix before the virtual end
    if not s_type[n - 1]:
        l_in[int(t[n - 1])].append(last)
    l_all: list[np.ndarray] = [None] * symbols
    for c in range(symbols):
        got: list[np.ndarray] = []
        now = np.concatenate(l_in[c]) if l_in[c] else np.zeros(0, np.int64)
        while len(now):
            got.append(now)
            j = before(now, False)
            same = t[j] == c
            give(j[~same], l_in)
            now = j[same]
        l_all[c] = np.concatenate(got) if got else np.zeros(0, np.int64)
        if len(lms_by[c]):
            give(before(lms_by[c], False), l_in)
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        got = []
        now = np.concatenate(s_in[c]) if s_in[c] else np.zeros(0, np.int64)
        while len(now):
            got.append(now)
            j = before(now, True)
            same = t[j] == c
            give(j[~same], s_in)
            now = j[same]
        out.append(np.concatenate(got)[::-1] if got else np.zeros(0, np.int64))
        down = l_all[c][::-1]
        if len(down):
            give(before(down, True), s_in)
        out.append(l_all[c])
    return np.concatenate(out[::-1])


def _induce_names(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """As ``_induce``, an element at a time: for alphabets about as large as the string, whose buckets hold few."""
    n, size = len(t), np.bincount(t, minlength=symbols)
    ends = np.cumsum(size)
    sa = [0] * n  # 0 is also "none yet": nothing stands before suffix 0
    tail = ends.tolist()
    for j, c in zip(lms[::-1].tolist(), t[lms[::-1]].tolist(), strict=True):
        tail[c] -= 1
        sa[tail[c]] = j
    # Of each suffix: the bucket of the suffix before it where that is of the type at hand, else -1.
    before = np.full(n, -1, np.int64)
    before[1:] = np.where(s_type[:-1], -1, t[:-1])
    up = before.tolist()
    before[1:] = np.where(s_type[:-1], t[:-1], -1)
    down = before.tolist()
    head = (ends - size).tolist()
    if not s_type[n - 1]:  # the suffix before the virtual end
        c = int(t[n - 1])
        sa[head[c]] = n - 1
        head[c] += 1
    for j in sa:  # sees what is put further on
        c = up[j]
        if c >= 0:
            p = head[c]
            sa[p] = j - 1
            head[c] = p + 1
    tail = ends.tolist()
    for j in reversed(sa):
        c = down[j]
        if c >= 0:
            p = tail[c] - 1
            sa[p] = j - 1
            tail[c] = p
    return np.array(sa)


def _sorted_substrings(t: np.ndarray, lms: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions in the order of prefixes that hold their LMS substrings, and which prefix differs from the one before: symbols
    are packed into words, and those that still tie are told apart by the next word until the longest substring among them is passed."""
    n, bits = len(t), int(symbols).bit_length()
    per = 63 // bits
    padded = np.concatenate([t.astype(np.int64) + 1, np.zeros(per, np.int64)])  # the end is smaller than everything
    word = np.zeros(n + 1, np.int64)
    for k in range(per):
        word = word << bits | padded[k : n + 1 + k]
    length = np.append(lms[1:] - lms[:-1] + 1, n - lms[-1] + 1)  # the last one with the end of the text
    first = word[lms]
    order = np.argsort(first, kind="stable")
    differ = np.ones(len(lms), bool)
    differ[1:] = first[order[1:]] != first[order[:-1]]
    done = per
    while True:
        head = np.flatnonzero(differ)
        size = np.diff(np.append(head, len(lms)))
        open_ = (size > 1) & (np.maximum.reduceat(length[order], head) > done)
        if not open_.any():
            return lms[order], differ
        at = ranges(head[open_], size[open_])
        group = np.repeat(np.arange(int(open_.sum())), size[open_])
        x = order[at]
        w = word[np.minimum(lms[x] + done, n)]
        o = np.lexsort((w, group))
        order[at], w = x[o], w[o]
        differ[at[1:]] |= w[1:] != w[:-1]
        done += per


def suffix_array(t: np.ndarray, symbols: int = 256) -> np.ndarray:
    """Suffix array of a string of numbers below ``symbols``."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    # Bytes are worked off a bucket at a time, names, whose alphabet is nearly as large as their string, an element at a time.
    induce = _induce if symbols <= 256 else _induce_names
    s_type = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    if not len(lms):
        return induce(t, s_type, lms, symbols)
    order, differ = _sorted_substrings(t, lms, symbols)
    if not differ.all():
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(differ) - 1
        order = lms[suffix_array(rank[lms], max(int(differ.sum()), 257))]
    return induce(t, s_type, order, symbols)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """PLCP, cut at ``most``: in text order, the common prefix of each suffix with its predecessor in the array; 8 bytes at a time."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([t, np.zeros(most + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + most, 8), (1, 1)).copy().view("<u8")[:, 0]
    out = np.zeros(n, np.int64)
    alive = np.flatnonzero(phi >= 0)
    for k in range(0, most, 8):
        x = words[alive + k] ^ words[phi[alive] + k]
        equal = x == 0
        rest = x[~equal]
        low = rest & (~rest + np.uint64(1))
        out[alive[~equal]] = k + (np.log2(low.astype(float)) // 8).astype(np.int64)
        alive = alive[equal]
    out[alive] = most
    out = np.minimum(out, most)
    return np.minimum(out, n - np.maximum(np.arange(n), phi))


def smallest_owner(blocks: list[bytes], owner: np.ndarray, width: int = WIDTH):
    """For every window of the blocks, in order: number of its block, offset, smallest owner of an equal window, and two hashes of it."""
    lengths = np.array([len(b) for b in blocks], np.int64)
    # 0 stands between blocks; bytes that are 0 in the text stay 0 too, which the lengths of windows tell apart.
    joined = np.frombuffer(b"\0".join(blocks) + b"\0", np.uint8)
    start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    sa = suffix_array(joined)
    plcp = permuted_lcp(joined, sa, width)
    window = ranges(start, lengths - width + 1)
    block = np.repeat(np.arange(len(blocks)), lengths - width + 1)
    valid = np.zeros(len(joined), np.int64) - 1
    valid[window] = np.arange(len(window))
    # Only windows count; between two of them in the array the common prefix is the least in between.
    group = np.cumsum(plcp[sa] < width)
    keep = valid[sa] >= 0
    group, member = group[keep], valid[sa[keep]]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(group)))
    low = np.repeat(np.minimum.reduceat(owner[block[member]], head), size) if len(head) else np.zeros(0, np.int64)
    result = np.empty(len(window), np.int64)
    result[member] = low
    return block, window - start[block], result, joined[: len(joined) - 1], window


# --- the dataflow --------------------------------------------------------------------------------------------------------------


def _settle(k: np.ndarray, b: np.ndarray, doc: np.ndarray, copies: int | None) -> np.ndarray:
    """Of anchors (seed, block, document): which are of the ``copies`` smallest documents of their seed and block. The others lose the
    block, since a smaller document keeps it."""
    if copies is None or not len(k):
        return np.ones(len(k), bool)
    key = (k & SEED_BITS) | (b >> np.uint64(40))
    order = np.argsort(key)
    new = np.ones(len(k), bool)
    ks, bs = key[order], b[order]
    new[1:] = ks[1:] != ks[:-1]
    if ((bs[1:] != bs[:-1]) & ~new[1:]).any():  # two blocks that agree in the first bits
        order = np.lexsort((b, k))
        ks, bs = k[order], b[order]
        new[1:] = (ks[1:] != ks[:-1]) | (bs[1:] != bs[:-1])
    head = np.flatnonzero(new)
    docs = doc[order]
    size, left, most = np.diff(np.append(head, len(k))), docs, np.iinfo(np.int64).max
    for _ in range(copies):
        low = np.repeat(np.minimum.reduceat(left, head), size)
        left = np.where(left == low, most, left)
    kept = np.empty(len(k), bool)
    kept[order] = left == most
    return kept


def _lost(doc: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Byte runs (document, row, start, end) that anchors lose, joined where they touch."""
    lo = at.astype(np.int64)
    return merge(doc, row, lo, lo + n + width - 1)


def merge(doc: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins overlapping or touching runs of each row; the result is in (document, row, start) order."""
    if not len(doc):
        return doc, row, lo, hi
    o = np.lexsort((lo, row, doc))
    doc, row, lo, hi = doc[o], row[o], lo[o], hi[o]
    number = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
    far = int(hi.max()) + 2
    reach = np.maximum.accumulate(hi + number * far)
    head = np.ones(len(doc), bool)
    head[1:] = (lo[1:] + number[1:] * far) > reach[:-1]
    at = np.flatnonzero(head)
    ends = np.append(at[1:], len(doc)) - 1
    return doc[at], row[at], lo[at], reach[ends] - number[ends] * far


_RUNS = "kind int, doc long, row long, lo long, hi long, k long, b long"


def _runs(kind: int, doc, row, lo, hi, k=None, b=None) -> pa.RecordBatch:
    n = len(doc)
    zero = np.zeros(n, np.int64)
    words = [zero if x is None else np.ascontiguousarray(x).view(np.int64) for x in (k, b)]
    cols = [np.full(n, kind, np.int32), *(np.ascontiguousarray(x).astype(np.int64) for x in (doc, row, lo, hi)), *words]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "doc", "row", "lo", "hi", "k", "b"])


def _pack(doc, row, own, k, b, at, n, sides) -> bytes:
    """Anchors column by column, narrow: 40 bits of seed, 56 of block, document and row by table, offset, windows, sides."""
    used, which = np.unique(own, return_inverse=True)
    parts = [np.array([len(own), len(used)], "<i8"), doc[used], row[used], which.astype("<u4" if len(used) > 65535 else "<u2"),
             k.view("u1").reshape(-1, 8)[:, 3:], b.view("u1").reshape(-1, 8)[:, 1:], at.astype("<u4"), n.astype("<u2"), sides.T.astype("<u2")]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def _unpack(buf) -> tuple[np.ndarray, ...]:
    """(doc, row, k, b, at, n, sides) of a blob."""
    raw = np.frombuffer(buf, np.uint8)
    n, m = (int(x) for x in raw[:16].view("<i8"))
    p = 16

    def take(kind, count):
        nonlocal p
        size = np.dtype(kind).itemsize * count
        out = raw[p : p + size].copy().view(kind)
        p += size
        return out

    docs, rows = take("<i8", m), take("<i8", m)
    which = take("<u4" if m > 65535 else "<u2", n)
    hashes = []
    for w in (5, 7):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, 8 - w :] = take("u1", n * w).reshape(n, w)
        hashes.append(wide.view("<u8")[:, 0])
    return docs[which], rows[which], *hashes, take("<u4", n), take("<u2", n), take("<u2", 2 * n).reshape(2, n).T


def shared_blocks(docs: DataFrame, width: int, seed: int, copies: int | None = COPIES) -> DataFrame:
    """Rows of kind 0: runs [lo, hi) that a row loses; kind 1: blocks to be told apart, with seed k and block b."""
    n_buckets = n_groups(docs)
    most = min(max(FLUSH, 4 * n_buckets), MOST_FLUSH)

    def out(buckets, blobs):
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def flush(texts, held):
        # In the order of the texts, so that columns of a blob ascend and compress.
        doc, row = (np.concatenate(c) for c in zip(*texts, strict=True))
        k, b, own, at, n, sides = (np.concatenate(c) for c in zip(*held, strict=True))
        kept = _settle(k, b, doc[own], copies)
        lost = _lost(doc[own[~kept]], row[own[~kept]], at[~kept], n[~kept], width)
        k, b, own, at, n, sides = (c[kept] for c in (k, b, own, at, n, sides))
        bucket = ((k >> np.uint64(24)) % np.uint64(n_buckets)).astype(np.uint16 if n_buckets < 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        ids, ends = np.unique(bucket[order], return_index=True)
        k, b, own, at, n, sides = (c[order] for c in (k, b, own, at, n, sides))
        spans = zip(ends, np.append(ends[1:], len(order)), strict=True)
        yield out(ids.astype(np.int32), [_pack(doc, row, *(c[i:j] for c in (own, k, b, at, n, sides))) for i, j in spans])
        if len(lost[0]):
            side = (mix64(lost[0].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
            ids = np.unique(side)
            yield out([-1 - int(s) for s in ids], [np.stack([r[side == s] for r in lost]).tobytes() for s in ids])

    def map_side(batches):
        texts, held, n, rows = [], [], 0, 0
        for batch in batches:
            doc, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for lo, hi, data, off in text_slices(batch.column(2)):
                k, b, r, at, windows, sides = anchors(data, off, width, seed)
                texts.append((doc[lo:hi], row[lo:hi]))
                # The bits that are sent are those that are compared, here and there.
                held.append((k & SEED_BITS, b & BLOCK_BITS, (r + rows).astype(np.int32), at.astype(np.uint32), windows.astype(np.uint16), sides))
                n, rows = n + len(k), rows + hi - lo
                if n > most:
                    yield from flush(texts, held)
                    texts, held, n, rows = [], [], 0, 0
        if n:
            yield from flush(texts, held)
        give_back()

    def reduce_side(t: pa.Table) -> pa.Table:
        blobs = [x.as_buffer() for x in t.column("blob").combine_chunks()]
        if t.column("bucket")[0].as_py() < 0:
            parts = [np.frombuffer(x, np.int64).reshape(4, -1) for x in blobs]
            return pa.Table.from_batches([_runs(0, *merge(*np.concatenate(parts, 1)))])
        doc, row, k, b, at, n, sides = (np.concatenate(c) for c in zip(*map(_unpack, blobs), strict=True))
        kept = _settle(k, b, doc, copies)
        gone = _runs(0, *_lost(doc[~kept], row[~kept], at[~kept], n[~kept], width))
        doc, row, k, b, at, n, sides = (c[kept] for c in (doc, row, k, b, at, n, sides))
        # Blocks that another document's block of the seed agrees with on one side or the other.
        many = np.zeros(len(k), bool)
        for side in sides.T:
            reach = np.flatnonzero(side)
            key = k[reach] | side[reach]
            order = np.argsort(key)
            key, reach = key[order], reach[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else reach
            if len(head):
                several = np.maximum.reduceat(doc[reach], head) != np.minimum.reduceat(doc[reach], head)
                if copies == 1:
                    several &= np.maximum.reduceat(b[reach], head) != np.minimum.reduceat(b[reach], head)
                many[reach] |= np.repeat(several, np.diff(np.append(head, len(key))))
        doc, row, k, b, lo, n = (c[many] for c in (doc, row, k, b, at.astype(np.int64), n))
        return pa.Table.from_batches([gone, _runs(1, doc, row, lo, lo + n + width - 1, k, b)])

    return spread(docs).mapInArrow(map_side, "bucket int, blob binary").groupBy("bucket").applyInArrow(reduce_side, _RUNS)


def tell_apart(docs: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """Runs (doc, row, lo, hi) lost because a block's window also stands in another block of the same seed."""
    per_seed = blocks.groupBy("k").count().select("k", F.ceil(F.col("count") / SHARD_BLOCKS).alias("pieces"))
    n_shards = n_groups(docs) // 2
    # Nearly every seed has few blocks and lies in one shard; the few that are larger are spread, and their windows meet again below.
    large = cut(per_seed.where("pieces > 1"))
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("b", "doc", "row", "lo"), F.col("pieces"))).otherwise(-1)
    blocks = blocks.join(large, "k", "left").withColumn("piece", piece)
    wanted = blocks.groupBy("doc", "row").agg(F.collect_set(F.struct("lo", "hi", "k", "piece")).alias("wanted"))
    names = ["doc", "row", "lo", "k", "piece"]

    def slice_out(batches):
        seen: set[tuple[int, int]] = set()  # repeated rows, which stand together after a join
        for b in batches:
            ids = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            wants, texts = b.column(3), b.column(2)
            if len(seen) > 1 << 16:
                seen.clear()
            cols: list[list] = [[] for _ in names]
            parts: list[bytes] = []
            for i, own in enumerate(ids):
                if own in seen:
                    continue
                seen.add(own)
                raw, want = (texts[i].as_py() or "").encode(), wants[i].values
                lo, hi, k, piece = (want.field(f).to_pylist() for f in ("lo", "hi", "k", "piece"))
                for c, v in zip(cols, ([own[0]] * len(lo), [own[1]] * len(lo), lo, k, piece), strict=True):
                    c += v
                parts += [raw[p:q] for p, q in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(parts, pa.binary())], names=[*names, "block"])

    found = docs.join(wanted, ["doc", "row"]).select("doc", "row", "text", "wanted")
    found = found.mapInArrow(slice_out, "doc long, row long, lo long, k long, piece long, block binary")
    found = found.withColumn("shard", F.when(F.col("piece") < 0, F.pmod(F.xxhash64("k"), F.lit(n_shards))).otherwise(F.xxhash64("k", "piece")))

    def run(t: pa.Table) -> pa.Table:
        doc, row, lo, k, piece = (t.column(c).to_numpy() for c in names)
        blocks = t.column("block").combine_chunks().to_pylist()
        parts, at, size = [], 0, 0
        order = np.argsort(k, kind="stable")
        for i in range(len(blocks) + 1):  # groups of whole seeds, about SHARD_BYTES each
            if i == len(blocks) or (size > SHARD_BYTES and k[order[i]] != k[order[i - 1]]):
                if len(rows := order[at:i]):
                    parts += _shard(doc, row, lo, piece, blocks, rows, width)
                at, size = i, 0
            if i < len(blocks):
                size += len(blocks[order[i]])
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 8
        return pa.table(dict(zip(_WINDOWS, map(pa.array, cols), strict=True)))

    return found.groupBy("shard").applyInArrow(run, ", ".join(f"{c} long" for c in _WINDOWS))


_WINDOWS = ("open", "doc", "row", "lo", "hi", "low", "h1", "h2")


def _shard(doc, row, lo, piece, blocks, rows, width: int):
    """One suffix array over the blocks of ``rows``: runs that are lost (open 0) and, of spread seeds, every window with its smallest
    document in this shard and its hash (open 1)."""
    # A text that repeats itself has a block many times: once is enough for the array.
    seen: dict[tuple, int] = {}
    which = np.array([seen.setdefault((doc[r], blocks[r]), len(seen)) for r in rows])
    block, offset, low, text, window = smallest_owner([x for _, x in seen], np.array([d for d, _ in seen], np.int64), width)
    starts = np.searchsorted(block, np.arange(len(seen) + 1))
    n = (starts[1:] - starts[:-1])[which]
    w = ranges(starts[which], n)  # the windows of every occurrence
    own = np.repeat(rows, n)
    d, x, least = doc[own], lo[own] + offset[w], low[w]
    spread_out = piece[own] >= 0
    gone = np.flatnonzero((least < d) & ~spread_out)
    m = merge(d[gone], row[own[gone]], x[gone], x[gone] + width)
    none = np.zeros(len(m[0]), np.int64)
    yield none, *m, none, none, none
    if spread_out.any():
        o = np.flatnonzero(spread_out)
        h = [window_hash(text, width, base)[window[w[o]]].view(np.int64) for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
        yield np.ones(len(o), np.int64), d[o], row[own[o]], x[o], x[o] + width, least[o], *h


def lost_runs(docs: DataFrame, width: int = WIDTH, seed: int = SEED, copies: int | None = COPIES) -> DataFrame:
    """Per row (doc, row) that loses bytes: runs = array of (lo, hi), which may overlap."""
    if not seed <= width <= seed + 60_000:
        raise ValueError("width must hold a seed, and a block's windows must fit 16 bits")
    found = cut(shared_blocks(docs, width, seed, copies))
    windows = cut(tell_apart(docs, found.where("kind = 1").select("doc", "row", "lo", "hi", "k", "b"), width))
    open_ = windows.where("open = 1")
    lowest = open_.groupBy("h1", "h2").agg(F.min("low").alias("lowest"))
    parts = (found.where("kind = 0"), windows.where("open = 0"), open_.join(lowest, ["h1", "h2"]).where("lowest < doc"))
    runs = [p.select("doc", "row", "lo", "hi") for p in parts]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).groupBy("doc", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED, as_text: bool = False, copies: int | None = COPIES) -> DataFrame:
    """All columns of ``df`` with ``kept`` (binary: the bytes that remain; with ``as_text`` a string without the characters that a cut
    leaves in part), n_bytes, n_removed, n_spans and spans (array of (lo, hi))."""
    added = ("kept", "n_bytes", "n_removed", "n_spans", "spans")
    keep = [f for f in df.schema.fields if f.name not in added]
    df = df.select([F.col(f"`{f.name}`") for f in keep])
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull())
    lost = lost_runs(docs, width, seed, copies).select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("runs").alias("__runs"))
    here = (F.col(id_col).cast("long") == F.col("__doc")) & (F.xxhash64(F.col(text_col)) == F.col("__row"))
    joined = df.join(lost, here, "left").drop("__doc", "__row")
    span_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches):
        for b in batches:
            text_at = b.schema.get_field_index(text_col)
            names = [f.name for f in keep]
            for first, last, data, off in text_slices(b.column(text_at)):
                raw = data.tobytes()
                got: list[list] = [[] for _ in range(5)]
                runs = b.column(b.schema.get_field_index("__runs")).slice(first, last - first)
                flat = runs.flatten()
                lo_all, hi_all = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                ends = np.concatenate([[0], np.cumsum([0 if x is None else x for x in runs.value_lengths().to_pylist()])]).astype(int)
                for i in range(last - first):
                    t = raw[off[i] : off[i + 1]]
                    lo, hi = lo_all[ends[i] : ends[i + 1]], hi_all[ends[i] : ends[i + 1]]
                    if len(lo):
                        zero = np.zeros(len(lo), np.int64)
                        _, _, lo, hi = merge(zero, zero, lo, hi)
                    spans, at, parts = list(zip(lo.tolist(), hi.tolist(), strict=True)), 0, []
                    for p, q in spans:
                        parts.append(t[at:p])
                        at = q
                    parts.append(t[at:])
                    kept = b"".join(parts)
                    given = "".join(x.decode("utf-8", "ignore") for x in parts) if as_text else kept
                    for c, v in zip(got, (given, len(t), len(t) - len(kept), len(spans), [{"lo": p, "hi": q} for p, q in spans]), strict=True):
                        c.append(v)
                arrays = [b.column(b.schema.get_field_index(n)).slice(first, last - first) for n in names]
                kinds = (pa.string() if as_text else pa.binary(), pa.int64(), pa.int64(), pa.int64(), span_type)
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, k) for c, k in zip(got, kinds, strict=True))], names=[*names, *added])
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return joined.mapInArrow(run, f"{fields}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:long,hi:long>>")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
