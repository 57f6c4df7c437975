"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte n-grams (2 to 4, lower-cased, everything but letters folded to a space), scaled to
length 1. Each language has several centroids, found by spherical k-means; a text goes to the language of the centroid with the
largest cosine. A centroid's distance threshold, learned from its members, marks a text as rejected when it is farther away.

Document frequencies cover every learnable document. The centroids are fitted on a bounded sample: at most ``per_lang`` documents of
a language and ``sample`` in all, taken by hash order. Scoring covers whole texts.

Behaviour: a null text or one without letters gives ``und`` with score 0; with nothing to learn from, every text does; rows with a
null language teach nothing; repeated rows score alike; an empty table gives an empty result; other columns are not inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import crc_mod, mix64, spread, table, text_slices

DIM, GRAMS, CENTROIDS, PER_LANG, SAMPLE, SHARPNESS, SLACK, SALT = 4096, (2, 3, 4), 4, 400, 4000, 25.0, 1.25, 64


def _fold() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    t[128:] = np.arange(128, 256)
    return t


FOLD = _fold()


def counts(data: np.ndarray, offsets: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Hashed n-gram counts, a row per text. UTF-8 capitals of the Latin-1 block are folded to small letters."""
    n = len(offsets) - 1
    out = np.zeros(n * dim, np.float32)
    x = FOLD[data]
    if len(x) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        x[1:][up] += 0x20
    row = np.repeat(np.arange(n), np.diff(offsets))
    end = offsets[1:][row] if n else row
    pos = np.arange(len(x))
    code = x.astype(np.uint32)
    gram = code.copy()
    for g in range(2, max(GRAMS) + 1):
        if len(x) < g:
            break
        gram = gram[: len(x) - g + 1] << np.uint32(8) | code[g - 1 :]
        if g in GRAMS:
            ok = (pos[: len(gram)] + g <= end[: len(gram)]) & ~((x[: len(gram)] == 32) & (x[1 : len(gram) + 1] == 32))
            key = gram * np.uint32(0x9E3779B1) + np.uint32(g * 0x85EBCA6B & 0xFFFFFFFF)
            key ^= key >> np.uint32(15)
            key *= np.uint32(0x2C1B3C6D)
            key >>= np.uint32(32 - int(dim).bit_length() + 1)
            out += np.bincount(row[: len(gram)][ok] * dim + key[ok], minlength=n * dim).astype(np.float32)
    return out.reshape(n, dim)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _small_slices(col: pa.Array, rows: int = 128):
    for lo, hi, data, off in text_slices(col, 1 << 20):
        for a in range(0, hi - lo, rows):
            b = min(a + rows, hi - lo)
            yield lo + a, lo + b, data[off[a] : off[b]], off[a : b + 1] - off[a]


def kmeans(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; centroids of length 1, and each row's centroid."""
    seeds = [0]
    near = v @ v[0]
    while len(seeds) < min(k, len(v)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, v @ v[seeds[-1]])
    c = v[seeds].copy()
    for _ in range(rounds):
        own = (v @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].sum(0)
                c[j] = m / (np.linalg.norm(m) or 1)
    return c, (v @ c.T).argmax(1)


def fit(learn: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_lang=PER_LANG, sample=SAMPLE, k=CENTROIDS) -> dict:
    """Centroids from labelled rows. Driver memory: at most ``sample`` vectors and one vector of document frequencies."""
    learn = learn.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, lang_col)

    def frequencies(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for lo, hi, data, off in _small_slices(b.column(0)):
                df += (counts(data, off) > 0).sum(0)
                n += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(DIM), -1)), pa.array(np.append(df, n))], names=["g", "n"])

    freq = dict(spread(learn.select(text_col)).mapInArrow(frequencies, "g long, n long").groupBy("g").agg(F.sum("n")).collect())
    n = freq.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([freq.get(g, 0) for g in range(DIM)]))).astype(np.float32) + 1
    langs = sorted(r[0] for r in learn.select(lang_col).distinct().collect())
    if not langs:
        return {"langs": [], "idf": idf, "centroids": np.zeros((0, DIM), np.float32), "of": np.zeros(0, int), "far": np.zeros(0)}
    share = max(1, min(per_lang, sample // len(langs)))
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col)
    # First among the rows of a piece, so that a language with most rows leaves a bounded number for the last choice.
    pieces = Window.partitionBy(lang_col, F.pmod(F.xxhash64(F.lit(1), id_col), F.lit(SALT))).orderBy(F.xxhash64(id_col), id_col)
    ids = learn.select(id_col, lang_col).withColumn("rank", F.row_number().over(pieces)).where(F.col("rank") <= share)
    ids = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= share).select(id_col).distinct()
    picked = learn.join(F.broadcast(ids), id_col, "left_semi").select(lang_col, text_col)

    def vector_rows(batches):
        for b in batches:
            for lo, hi, data, off in _small_slices(b.column(1)):
                c = np.minimum(counts(data, off), 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in c], pa.binary())], names=["lang", "v"])

    rows = picked.mapInArrow(vector_rows, "lang string, v binary").collect()
    rows = sorted((r[0], bytes(r[1])) for r in rows)
    tags = np.array([r[0] for r in rows])
    v = vectors(np.frombuffer(b"".join(r[1] for r in rows), np.uint16).reshape(-1, DIM).astype(np.float32), idf)
    centroids, of, far = [], [], []
    for i, lang in enumerate(langs):
        own = v[tags == lang]
        own = own[(own != 0).any(1)]
        if not len(own):
            continue
        c, which = kmeans(own, k)
        centroids.append(c)
        of += [i] * len(c)
        for j in range(len(c)):
            d = 1 - own[which == j] @ c[j]
            far.append(float(np.quantile(d, 0.99)) * SLACK if len(d) else 1.0)
    if not centroids:
        return {"langs": [], "idf": idf, "centroids": np.zeros((0, DIM), np.float32), "of": np.zeros(0, int), "far": np.zeros(0)}
    return {"langs": langs, "idf": idf, "centroids": np.concatenate(centroids), "of": np.array(of), "far": np.array(far)}


def predict(df: DataFrame, model: dict, id_col="doc_id", text_col="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds lang_pred, score and rejected to the id and the ``keep`` columns."""
    langs, of, far = model["langs"], model["of"], model["far"]

    def run(batches):
        for b in batches:
            names, scores, rejected = [], [], []
            text = b.column(b.num_columns - 1)
            for lo, hi, data, off in _small_slices(text):
                cos = vectors(counts(data, off), model["idf"]) @ model["centroids"].T
                ascii_letters = np.concatenate([[0], np.cumsum(((data | 0x20) >= 97) & ((data | 0x20) <= 122))])
                has = (ascii_letters[off[1:]] - ascii_letters[off[:-1]]) > 0
                by_lang = np.full((hi - lo, max(1, len(langs))), -1.0)
                for j, i in enumerate(of):
                    by_lang[:, i] = np.maximum(by_lang[:, i], cos[:, j])
                best = by_lang.argmax(1)
                p = np.exp(SHARPNESS * (by_lang - by_lang.max(1, keepdims=True)))
                p = p.max(1) / p.sum(1)
                for i in range(hi - lo):
                    letters = has[i] or any(ch.isalpha() for ch in data[off[i] : off[i + 1]].tobytes().decode())
                    known = bool(letters and langs)
                    names.append(langs[best[i]] if known else "und")
                    scores.append(float(p[i]) if known else 0.0)
                    rejected.append(not known or bool(1 - cos[i].max() > far[cos[i].argmax()]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return spread(df.select(id_col, *keep, text_col)).mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = fit(docs.where(~held))
    return predict(docs.withColumn("held_out", held), model, keep=("held_out",))
