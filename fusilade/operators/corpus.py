"""Passes over the corpus in the tasks: term counts, document frequencies, rankings of texts and the texts that hold phrases.

A task works on slices of its texts and keeps what it needs of them, so its memory grows neither with its rows nor with the corpus, and
no token is shuffled. Tokens are those of ``text.tokens``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import english as EN

#: Bytes of text that a kernel works on at once; pairs of a text's term and a query that are scored at once; rows that a task holds.
SLICE_BYTES, MOST_PAIRS, HELD = 2 << 20, 1 << 21, 1 << 20
#: Strings that are hashed at once.
HASHED = 1 << 17
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TOKEN = np.zeros(256, bool)
TOKEN[[39, *range(48, 58), *range(97, 123)]] = True
#: The characters outside ASCII whose small letters hold an ASCII letter.
SMALL = (("K", "k"), ("İ", "i̇"))
#: Stands for a null chunk id, before all others as Spark sorts them.
NO_ID = np.iinfo(np.int64).min


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, null as empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    return (np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)), offsets - first


def slices(*columns: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts come to about ``limit`` bytes together; a longer row stands alone."""
    ends = sum(_buffers(c)[1] for c in columns)
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1))
        yield lo, hi
        lo = hi


def tokenized(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all rows, in order, and the row of each."""
    data, offsets = _buffers(col)
    for big, small in SMALL:
        if data.tobytes().find(big.encode()) >= 0:
            col = pc.replace_substring(col, big, small)
            data, offsets = _buffers(col)
    low = LOWER[data]
    inside = TOKEN[low]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    begin = offsets[:-1][offsets[:-1] < len(data)]
    start[begin] = inside[begin]  # tokens don't cross rows
    at = np.flatnonzero(start)
    before = np.concatenate([[0], np.cumsum(inside)])
    own = np.append(before[at], before[-1]).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(at), pa.py_buffer(own), pa.py_buffer(low[inside]))
    return tokens, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at, offsets)))


def _coded(*columns: pa.Array) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct tokens of the columns, and of each column the (code, row) of all its tokens."""
    parts = [tokenized(c) for c in columns]
    one = pa.concat_arrays([t for t, _ in parts]).dictionary_encode()
    codes, cuts = one.indices.to_numpy().astype(np.int64), np.cumsum([len(t) for t, _ in parts])[:-1]
    return one.dictionary, [(c, row) for c, (_, row) in zip(np.split(codes, cuts), parts, strict=True)]


@dataclass
class Counts:
    """Terms of a slice's rows, by row: row, code of the term, occurrences in head and body."""

    terms: pa.Array
    row: np.ndarray
    code: np.ndarray
    head: np.ndarray
    body: np.ndarray


def counted(head: pa.Array | None, content: pa.Array) -> Counts:
    terms, parts = _coded(*([content] if head is None else [content, head]))
    n = max(len(terms), 1)
    (key, body), *rest = [np.unique(row * n + code, return_counts=True) for code, row in parts]
    heads = np.zeros(len(key), np.int64)
    if rest:
        (own, k), of_body = rest[0], key
        key = np.sort(np.concatenate([key, own]), kind="stable")  # two ascending runs
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        heads, bodies = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        heads[np.searchsorted(key, own)], bodies[np.searchsorted(key, of_body)] = k, body
        body = bodies
    return Counts(terms, key // n, key % n, heads, body)


def stems(terms: pa.Array, known: dict[str, str | None]) -> pa.Array:
    """The stem of every term, null for stop words; ``known`` is a bounded memory of them."""
    if len(known) > HELD:
        known.clear()
    out = []
    for t in terms.to_pylist():
        if t not in known:
            known[t] = None if t in EN.STOP_WORDS else EN.stem(t) or None
        out.append(known[t])
    return pa.array(out, pa.string())


def _stemmed(c: Counts, known: dict[str, str | None]) -> Counts:
    one = stems(c.terms, known).dictionary_encode()
    code = one.indices.fill_null(-1).to_numpy().astype(np.int64)[c.code]
    has, n = code >= 0, max(len(one.dictionary), 1)
    key, at = np.unique(c.row[has] * n + code[has], return_inverse=True)
    sums = [np.bincount(at, x[has], len(key)).astype(np.int64) for x in (c.head, c.body)]
    return Counts(one.dictionary, key // n, key % n, *sums)


def posting_rows(english: bool):
    """mapInArrow over (chunk_id, head, content): chunk_id, lexeme, tf_head, tf_body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for b in batches:
            for lo, hi in slices(b.column(1), b.column(2)):
                part = b.slice(lo, hi - lo)
                c = counted(part.column(1), part.column(2))
                c = _stemmed(c, known) if english else c
                cols = [part.column(0).take(pa.array(c.row)), c.terms.take(pa.array(c.code)), pa.array(c.head), pa.array(c.body)]
                yield pa.RecordBatch.from_arrays(cols, ["chunk_id", "lexeme", "tf_head", "tf_body"])

    return run


def frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (content): term, df, summed as far as a task can hold them."""
    held: list[pa.Table] = []

    def total() -> pa.Table:
        return pa.concat_tables(held).group_by("term").aggregate([("df", "sum")]).rename_columns(["term", "df"])

    for b in batches:
        for lo, hi in slices(b.column(0)):
            c = counted(None, b.column(0).slice(lo, hi - lo))
            held.append(pa.table({"term": c.terms, "df": np.bincount(c.code, minlength=len(c.terms)).astype(np.int64)}))
            if sum(map(len, held)) > HELD:
                held = [total()]
                if len(held[0]) > HELD // 2:
                    yield from held[0].to_batches()
                    held = []
    if held:
        yield from total().to_batches()


# --- rankings --------------------------------------------------------------------------------------------------------------------
def term_hash(terms: pa.Array) -> np.ndarray:
    """64-bit hashes of strings: a polynomial of their bytes, mixed. Some strings at a time, as a vocabulary has many."""
    if len(terms) > HASHED:
        return np.concatenate([term_hash(terms.slice(k, HASHED)) for k in range(0, len(terms), HASHED)])
    data, offsets = _buffers(terms)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(np.diff(offsets).max(initial=0)), 0xD6E8FEB86659FD93, np.uint64)]))
    length = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], length)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[place])])
    x = sums[offsets[1:]] - sums[offsets[:-1]] + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


class Asked:
    """Which queries ask for a term, and with which weight, from rows (query, term, weight)."""

    def __init__(self, query: np.ndarray, term: pa.Array, weight: np.ndarray):
        one = term.dictionary_encode()
        code = one.indices.to_numpy().astype(np.int64)
        order = np.argsort(code, kind="stable")
        self.terms, self.query, self.weight = one.dictionary, query[order], weight[order]
        self.n = np.bincount(code, minlength=len(self.terms))
        self.start = np.cumsum(self.n) - self.n

    def places(self, terms: pa.Array) -> np.ndarray:
        """The number of each term here, -1 where no query asks for it."""
        return pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy().astype(np.int64)


@dataclass
class Vocabulary:
    """idf of the terms that several chunks hold, by ascending hash; every other term is in one chunk."""

    hashes: np.ndarray
    idf: np.ndarray
    rare: float

    def of(self, terms: pa.Array) -> np.ndarray:
        h = term_hash(terms)
        if not len(self.hashes):
            return np.full(len(h), self.rare)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.idf[at], self.rare)


def weights(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return rounded(np.log1p(tf.astype(float)) * idf, 6)


def pruned(row: np.ndarray, place: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the ``most`` largest weights above 0 of each row, ties by smaller place; ``row`` ascends."""
    has = np.flatnonzero(w > 0)
    r, p, v = row[has], place[has], np.rint(w[has] * 1e6).astype(np.int64)  # weights have six digits
    bits = [int(x.max(initial=0)).bit_length() for x in (r, v, p)]
    if sum(bits) < 64:
        o = has[np.argsort(r << (bits[1] + bits[2]) | ((1 << bits[1]) - 1 - v) << bits[2] | p)]
    else:
        o = has[np.lexsort((p, -v, r))]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else r
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return o[rank < most]


class Best:
    """The first ``depth`` rows of each query by rounded score, then by smaller chunk id. Where queries are so many that a task would hold
    more than ``HELD`` rows, it gives out what it has and starts anew."""

    def __init__(self, n_queries: int, depth: int, digits: int):
        self.depth, self.digits, self.floor = depth, digits, np.full(n_queries, -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        key = rounded(score, self.digits)
        ok = key >= self.floor[query]
        self.held.append((query[ok], chunk[ok], score[ok], key[ok]))
        self.n += int(ok.sum())
        if self.n > max(1 << 16, min(4 * self.depth * len(self.floor), HELD)):
            self.cut()
            if self.n > HELD // 2:
                yield from self.rows()

    def cut(self) -> None:
        query, chunk, score, key = (np.concatenate(c) for c in zip(*self.held, strict=True))
        o = np.lexsort((chunk, -key, query))
        q = query[o]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else q
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = o[rank == self.depth - 1]
        self.floor[query[last]] = key[last]
        o = o[rank < self.depth]
        self.held, self.n = [(query[o], chunk[o], score[o], key[o])], len(o)

    def rows(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.n:
            self.cut()
            yield self.held[0][:3]
        self.held, self.n = [], 0
        self.floor[:] = -np.inf


def scored(row: np.ndarray, place: np.ndarray, values: list[np.ndarray], asked: Asked, n_queries: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, query, sums of values x weight ...) of rows' terms, by place in ``asked``; some rows at a time, ``row`` ascends."""
    n = asked.n[place]
    upto, lo = np.cumsum(n), 0
    while lo < len(row):
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + MOST_PAIRS, "right"))
        if hi < len(row):  # back to a row's start, or on to its end where it is the only one
            at = int(np.searchsorted(row, row[hi], "left"))
            hi = at if at > lo else int(np.searchsorted(row, row[lo], "right"))
        k = n[lo:hi]
        end = np.cumsum(k)
        pair = np.arange(int(end[-1])) + np.repeat(asked.start[place[lo:hi]] - (end - k), k)
        query, w = asked.query[pair], asked.weight[pair]
        base, own = int(row[lo]), np.repeat(row[lo:hi] - row[lo], k)
        cell, cells = own * n_queries + query, (int(row[hi - 1]) - base + 1) * n_queries
        names = None
        if cells > 4 * MOST_PAIRS:
            names, cell = np.unique(cell, return_inverse=True)
            cells = len(names)
        sums = [np.bincount(cell, np.repeat(v[lo:hi], k) * w, cells) for v in values]
        some = np.flatnonzero(np.bincount(cell, minlength=cells))
        which = some if names is None else names[some]
        yield base + which // n_queries, which % n_queries, *(s[some] for s in sums)
        lo = hi


@dataclass
class Leg:
    """What a task needs to rank texts: the lexical leg's terms, or the sparse leg's with the vocabulary and the kept terms of a vector."""

    asked: Asked
    digits: int
    head_weight: float = 0.0
    body_weight: float = 0.0
    english: bool = False
    vocabulary: Vocabulary | None = None
    most: int = 0

    def pairs(self, c: Counts, known: dict[str, str | None], n_queries: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, query, score) of a slice."""
        if self.vocabulary is None:
            place = self.asked.places(stems(c.terms, known) if self.english else c.terms)[c.code]
            at = np.flatnonzero(place >= 0)
            for row, query, head, body in scored(c.row[at], place[at], [c.head[at], c.body[at]], self.asked, n_queries):
                yield row, query, self.head_weight * head + self.body_weight * body
            return
        place = self.asked.places(c.terms)
        wanted = np.zeros(int(c.row[-1]) + 1 if len(c.row) else 0, bool)
        wanted[c.row[(place[c.code] >= 0) & (c.body > 0)]] = True
        at = np.flatnonzero(wanted[c.row] & (c.body > 0))
        row, code = c.row[at], c.code[at]
        w = weights(c.body[at], self.vocabulary.of(c.terms)[code])
        order = np.empty(len(c.terms), np.int64)
        order[pc.sort_indices(c.terms).to_numpy()] = np.arange(len(c.terms))
        kept = pruned(row, order[code], w, self.most)
        kept = kept[place[code[kept]] >= 0]
        yield from scored(row[kept], place[code[kept]], [w[kept]], self.asked, n_queries)


def ranking_rows(names: list[str], ids: pa.Array, depth: int, no_ids: bool, shared):
    """mapInArrow over (chunk_id, head, content): leg, query_id, chunk_id, score of a task's best chunks. ``shared`` broadcasts the legs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value, {}
        best = {n: Best(len(ids), depth, own[n].digits) for n in names}

        def out(name: str, query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            chunks = pa.array(chunk, mask=chunk == NO_ID) if no_ids else pa.array(chunk)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(query), pa.string()), ids.take(pa.array(query)), chunks, pa.array(score)], ["leg", "query_id", "chunk_id", "score"])

        for b in batches:
            chunk = b.column(0).cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
            for lo, hi in slices(b.column(1), b.column(2)):
                c = counted(b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo))
                for name in names:
                    for row, query, score in own[name].pairs(c, known, len(ids)):
                        for got in best[name].add(query, chunk[lo + row], score):
                            yield out(name, *got)
        for name in names:
            for got in best[name].rows():
                yield out(name, *got)

    return run


# --- phrases ---------------------------------------------------------------------------------------------------------------------
def holder_rows(keys: pa.Array, names: list[str], shared):
    """mapInArrow over (text, key ...): key ..., phrase key of the texts that hold a phrase. ``shared`` broadcasts the phrases, each with
    the inner words in a row by which it is met; one without is looked for in all texts."""

    def gram(codes: list[np.ndarray]) -> np.ndarray:
        key = np.zeros(len(codes[0]), np.uint64)
        for c in codes:
            key = key * np.uint64(0xD6E8FEB86659FD93) + c.astype(np.uint64) + np.uint64(1)
        return key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        said, bare = [p.encode() for p, _ in own], [i for i, (_, w) in enumerate(own) if not w]
        listed = sorted({x for _, w in own for x in w})
        code, words, met = {x: i for i, x in enumerate(listed)}, pa.array(listed, pa.string()), {}
        for n in sorted({len(w) for _, w in own if w}):
            at = np.array([i for i, (_, w) in enumerate(own) if len(w) == n])
            key = gram([np.array([code[own[i][1][k]] for i in at]) for k in range(n)])
            order = np.argsort(key, kind="stable")
            met[n] = key[order], at[order]
        for b in batches:
            text = b.column(0)
            for lo, hi in slices(text):
                part = text.slice(lo, hi - lo)
                terms, ((codes, row),) = _coded(part)
                place = pc.index_in(terms, value_set=words).fill_null(-1).to_numpy().astype(np.int64)[codes]
                found = [(np.repeat(np.arange(hi - lo), len(bare)), np.tile(np.array(bare, np.int64), hi - lo))]
                for n, (key, which) in met.items():
                    at = np.flatnonzero(place >= 0)
                    for k in range(1, n):
                        at = at[at + k < len(place)]
                        at = at[(place[at + k] >= 0) & (row[at + k] == row[at])]
                    if not len(at):
                        continue
                    g = gram([place[at + k] for k in range(n)])
                    first = np.searchsorted(key, g, "left")
                    k = np.searchsorted(key, g, "right") - first
                    end = np.cumsum(k)
                    found.append((np.repeat(row[at], k), which[np.arange(int(end[-1])) + np.repeat(first - (end - k), k)]))
                pair = np.unique(np.concatenate([r * len(own) + p for r, p in found]))
                data, off = _buffers(part)
                raw, valid = data.tobytes(), part.is_valid().to_numpy(zero_copy_only=False)
                pair = pair[[bool(valid[r]) and raw.find(said[p], off[r], off[r + 1]) >= 0 for r, p in zip((pair // len(own)).tolist(), (pair % len(own)).tolist(), strict=True)]] if len(pair) else pair
                rows = pa.array(lo + pair // len(own))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in b.columns[1:]), keys.take(pa.array(pair % len(own)))], names)

    return run
