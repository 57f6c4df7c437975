"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts each text into chunks whose borders depend on nearby bytes only, so that passages shared
by documents give equal chunks. A worker encodes each distinct chunk once and keeps it in a bounded cache. At each join the last
pre-tokens of the left chunk and the first of the right one are encoded again; the right chunk is taken over from the first border
at which both encodings agree. Pre-tokenisation looks at most three characters ahead and never behind, hence agreement at one
border is agreement up to the chunk's own end, and the result equals that of encoding the whole text.

Behaviour: a null text is empty (no ids); strings of the file's added tokens in a text become their ids, as the library does by default;
repeated rows give repeated results; an empty table gives an empty result; extra columns are dropped by ``digests`` and kept by
``encode``. Chunk and word caches are bounded, so a worker's memory does not grow with the input. ``path`` names the tokenizer's file on
the workers; None is the public byte-level file, looked up there. A file of another kind (normalised text, other pre-tokens, added tokens
that take spaces with them) has no borders that can be relied on: its texts are encoded whole by the library.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, spread, table, text_slices, window_hash

HASH_BYTES, CHUNK_MASK, HEAD, LOOK = 16, 255, 6, 3
CHUNK_CACHE_CHARS, WORD_CACHE, CACHED_WORD = 4 << 20, 150_000, 64
# Below U+0250 without control separators, NEL and NBSP, the character classes of Python and of the library are the same.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\\t-\\r "
SAFE = re.compile("[\t-\r -~¡-ɏ]*")
FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes and decodes with one tokenizer file; keeps words and chunks met before.

    Ids are held as comma-joined text with their decoding beside them or, in a ``binary`` encoder, as 32-bit words alone."""

    def __init__(self, path: str, binary: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        pre, added = self.tok.pre_tokenizer, self.tok.get_added_tokens_decoder()
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.by_chunks = plain and self.tok.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex
        self.special = {t.content.encode(): i for i, t in added.items()}
        self.cuts = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")") if added else None
        self.binary, self.comma = binary, b"" if binary else ","
        self.most_words = WORD_CACHE * (2 if binary else 1)  # a binary entry takes about half
        self.words: dict = {}
        self.chunks: dict[bytes, tuple] = {}
        self.ready: dict[bytes, tuple[str, list[str]]] = {}
        self.held = self.reused = self.made = 0

    def forget(self) -> None:
        self.words, self.chunks, self.ready, self.held = {}, {}, {}, 0

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; their concatenation is the text."""
        if SAFE.fullmatch(text):
            return FAST.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def made_of(self, ids: list[int]):
        """What is held of ids."""
        return array("i", ids).tobytes() if self.binary else (",".join(map(str, ids)), self.tok.decode(ids, skip_special_tokens=False))

    def word(self, w: str):
        """Ids of a pre-token: comma-joined with their decoding, or binary."""
        got = self.words.get(w)
        if got is None:
            got = self.made_of(self.tok.encode(w, add_special_tokens=False).ids)
            if len(w) <= CACHED_WORD:
                if len(self.words) >= self.most_words:
                    self.words.clear()
                self.words[w] = got
        return got

    def learn(self, words: set[str]) -> None:
        """Encodes and decodes the words not met before, in one call of the library each."""
        new = [w for w in words.difference(self.words) if len(w) <= CACHED_WORD]
        if not new:
            return
        if len(self.words) + len(new) > self.most_words:
            self.words.clear()
        got = [x.ids for x in self.tok.encode_batch_fast(new, add_special_tokens=False)]
        if self.binary:
            self.words.update(zip(new, [array("i", i).tobytes() for i in got], strict=True))
            return
        for w, i, t in zip(new, got, self.tok.decode_batch(got, skip_special_tokens=False), strict=True):
            self.words[w] = ",".join(map(str, i)), t

    def put(self, words: list[str], ids: list, texts: list[str]) -> None:
        get, word = self.words.get, self.word
        if self.binary:
            found = list(map(get, words))
            ids += found if None not in found else [word(w) if i is None else i for w, i in zip(words, found, strict=True)]
            return
        for w in words:
            i, t = get(w) or word(w)
            ids.append(i)
            texts.append(t)

    def cut_tail(self, words: list[str]) -> int:
        """Number of leading pre-tokens that what follows can't change: they end LOOK characters before the end."""
        k, left = len(words), LOOK
        while k and left > 0:
            k -= 1
            left -= len(words[k])
        return k

    def read(self, raw: bytes) -> tuple[str, list[str]]:
        text = raw.decode("utf-8")
        return text, self.split(text)

    def prepare(self, raws: list[bytes]) -> None:
        """Reads the chunks that are new and learns their words at once."""
        self.ready = {raw: self.read(raw) for raw in set(raws).difference(self.chunks)}
        self.learn(set().union(*(words for _, words in self.ready.values())))

    def chunk(self, raw: bytes) -> tuple:
        got = self.chunks.get(raw)
        if got is not None:
            self.reused += 1
            return got
        self.made += 1
        text, words = self.ready.pop(raw, None) or self.read(raw)
        k = self.cut_tail(words)
        if k > HEAD:
            ids, texts = [], []
            self.put(words[HEAD:k], ids, texts)
            got = text, words[:HEAD], self.comma.join(ids), "".join(texts), words[k:]
        else:
            got = text, None, self.comma, "", words
        if self.held + len(raw) > CHUNK_CACHE_CHARS:
            self.chunks.clear()
            self.held = 0
        self.chunks[raw] = got
        self.held += len(raw)
        return got

    def segment(self, pieces: list[bytes], ids: list, texts: list[str]) -> None:
        """Encodes the chunks of a text without special tokens, joins repaired."""
        tail: list[str] = []
        for raw in pieces:
            text, head, core, core_text, rest = self.chunk(raw)
            if head is not None:
                at = 0 if not tail else self.agree(tail, head, ids, texts)
                if at >= 0:
                    self.put(head[at:], ids, texts)
                    ids.append(core)
                    texts.append(core_text)
                    tail = rest
                    continue
            words = self.split("".join(tail) + text)
            k = self.cut_tail(words)
            self.put(words[:k], ids, texts)
            tail = words[k:]
        self.put(self.split("".join(tail)), ids, texts)

    def agree(self, tail: list[str], head: list[str], ids: list, texts: list[str]) -> int:
        """Encodes tail and head together; puts what precedes the first agreed border and returns that border's index in head, or -1."""
        left = "".join(tail)
        words = self.split(left + "".join(head))
        sure = self.cut_tail(words)
        borders, p = {len(left): 0}, len(left)
        for i, w in enumerate(head):
            p += len(w)
            borders[p] = i + 1
        p = 0
        for i in range(sure):
            if p in borders:
                self.put(words[:i], ids, texts)
                return borders[p]
            p += len(words[i])
        return -1

    def encode(self, pieces: list[bytes]):
        """Comma-joined ids and decoded text of a text given as its chunks; of a binary encoder the ids."""
        ids: list = []
        texts: list[str] = []
        raw = b"".join(pieces)
        if not self.by_chunks:
            return self.made_of(self.tok.encode(raw.decode(), add_special_tokens=False).ids)
        if not self.cuts or not self.cuts.search(raw):
            self.segment(pieces, ids, texts)
        else:
            for k, part in enumerate(self.cuts.split(raw)):
                if k % 2:
                    got = self.made_of([self.special[part]])
                    ids.append(got if self.binary else got[0])
                    texts.append("" if self.binary else got[1])
                elif part:
                    data = np.frombuffer(part, np.uint8)
                    self.segment([part[a:b] for a, b in borders(data, np.array([0, len(data)]))[0]], ids, texts)
        return b"".join(ids) if self.binary else (",".join(ids), "".join(texts))


def borders(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
    """Content-defined chunks of each row: cuts before a character whose preceding HASH_BYTES hash to 0 under CHUNK_MASK."""
    h = window_hash(data, HASH_BYTES)
    at = np.flatnonzero((h & np.uint64(CHUNK_MASK)) == 0) + HASH_BYTES
    at = at[at < len(data)]
    for _ in range(3):  # on to the start of a character
        at = np.where((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80, at + 1, at) if len(data) else at
    row = np.searchsorted(offsets, at - HASH_BYTES, "right") - 1
    at = at[(at < offsets[row + 1])] if len(at) else at
    at = np.unique(np.concatenate([at, offsets]))
    where = np.searchsorted(at, offsets)
    listed = at.tolist()
    return [[(listed[k], listed[k + 1]) for k in range(where[i], where[i + 1])] for i in range(len(offsets) - 1)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str | None, binary: bool = False) -> Encoder:
    """This worker's encoder of a file; None is looked up here, since the place may differ between machines."""
    key = path or default_path(), binary
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _encoded(batches, path, make, pick, binary=False):
    enc = encoder(path, binary)
    try:
        for b in batches:
            for lo, hi, data, off in text_slices(b.column(pick(b))):
                raw = data.tobytes()
                pieces = [[raw[p:q] for p, q in spans] for spans in borders(data, off)]
                if enc.by_chunks:
                    enc.prepare([x for row in pieces for x in row])
                rows = [enc.encode(row) for row in pieces]
                yield make(b.slice(lo, hi - lo), rows)
    finally:
        enc.forget()  # the worker process lives on and runs other tasks
        give_back()


def encode(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Adds ``token_ids`` array<int> and ``n_tokens`` long; columns of these names are replaced."""
    keep = [f for f in df.schema.fields if f.name not in ("token_ids", "n_tokens")]
    df = df.select([F.col(f"`{f.name}`") for f in keep])

    def make(b, rows):
        flat = np.frombuffer(b"".join(rows), np.int32)
        n = np.array([len(r) // 4 for r in rows], np.int64)
        arr = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([*b.columns, arr, pa.array(n)], names=[*b.schema.names, "token_ids", "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return df.mapInArrow(lambda bs: _encoded(bs, path, make, lambda b: b.schema.get_field_index(text_col), True), f"{fields}, token_ids array<int>, n_tokens long")


def decode(df: DataFrame, ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """Adds ``decoded`` string, the library's decoding of an id array; null ids give null."""

    def run(batches):
        tok = encoder(path).tok
        for b in batches:
            out = [None if x is None else tok.decode(x, skip_special_tokens=False) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "decoded"])

    df = df.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, decoded string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256."""

    def make(b, rows):
        n = [r[0].count(",") + 1 if r[0] else 0 for r in rows]
        sha = lambda k: pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), sha(0), sha(1)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(df.select(id_col, text_col)).mapInArrow(lambda bs: _encoded(bs, path, make, lambda b: 1), f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
