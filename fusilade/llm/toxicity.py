"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a learned lexicon (whole words, word beginnings, disguised words), the densest run of hits, hits near
second-person words, rates of capitals, punctuation, exclamation marks, digits and obfuscated words, and lengths. The lexicon comes from
a fold of the labelled sample that the trees don't see, the calibration from a fold that neither sees.

Fitting uses at most ``sample`` labelled rows taken by hash order; scoring covers every row and whole texts.

Behaviour: a null text is empty and scored like one; rows without a label teach nothing, several labels of a document are all used;
repeated rows score alike; an empty table gives an empty result; where the fold of the trees lacks a class (few labels, or one class
alone), the score is the rate of toxic rows in the whole sample (0 without rows); rows that share an id all count towards ``sample``;
other columns are never inputs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import crc_mod, spread, table, text_slices

SAMPLE, LEXICON, MIN_DOCS, STEM = 20_000, 4_000, 3, 5
TREES, DEPTH, RATE, BINS, NEAR, RUN = 80, 3, 0.2, 48, 5, 20
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner euch euer ihr usted ustedes tú ti tuyo tuya vosotros os".split())
LEET = str.maketrans("013457@$!|+", "oieastasilt")
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”‘’„…–—¡¿"
INNER = re.compile(r"[^\w]|_")
NAMES = ("words", "lexicon", "stems", "disguised", "weight", "most", "run", "near_you", "you", "capitals", "caps_words", "punctuation", "exclaim", "digits", "obfuscated", "mean_word")


def normal(word: str) -> tuple[str, bool]:
    """A word without edge punctuation, digits and signs read as letters; whether that changed its inside."""
    core = word.strip(EDGE)
    plain = INNER.sub("", core.translate(LEET)) if not core.isalpha() else core
    return plain, plain != core and any(c.isalpha() for c in core)


class Reader(dict):
    """Word to code: bit 0 second person, bit 1 obfuscated, bit 2 whole-word hit, bit 3 stem hit; above, the weight in 1/64."""

    def __init__(self, lexicon: dict[str, float], limit: int = 200_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, word: str) -> int:
        plain, odd = normal(word)
        whole, stem = self.lexicon.get(plain, 0.0), self.lexicon.get(plain[:STEM] + "*", 0.0) if len(plain) > STEM - 1 else 0.0
        code = (plain in SECOND_PERSON) | odd << 1 | (whole > 0) << 2 | (stem > 0) << 3 | int(64 * max(whole, stem)) << 4
        if len(self) > self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = code
        return code


_CLASS = np.zeros((256, 4), np.int32)  # capitals, punctuation, exclamation, digits
_CLASS[65:91, 0] = 1
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 1] = 1
_CLASS[33, 2] = 1
_CLASS[48:58, 3] = 1


def features(data: np.ndarray, offsets: np.ndarray, reader: Reader) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    sums = [np.concatenate([[0], np.cumsum(_CLASS[:, k][data])]) for k in range(4)]
    raw = data.tobytes()
    size = np.maximum(np.diff(offsets), 1)
    for k, at in enumerate((9, 11, 12, 13)):
        out[:, at] = (sums[k][offsets[1:]] - sums[k][offsets[:-1]]) / size
    for i in range(n):
        text = raw[offsets[i] : offsets[i + 1]].decode()
        words = text.lower().split()
        m = len(words)
        if not m:
            continue
        code = np.fromiter(map(reader.__getitem__, words), np.int64, m)
        weight = (code >> 4) / 64.0
        hit = weight > 0
        out[i, 0] = np.log1p(m)
        out[i, 1] = (code >> 2 & 1).sum() / m
        out[i, 2] = (code >> 3 & 1).sum() / m
        out[i, 3] = (hit & (code & 2 > 0)).sum() / m
        out[i, 14] = (code >> 1 & 1).sum() / m
        out[i, 15] = len(text) / m
        out[i, 10] = sum(map(str.isupper, text.split())) / m
        you = code & 1 > 0
        out[i, 8] = you.mean()
        if hit.any():
            out[i, 4] = weight.sum() / m
            out[i, 5] = weight.max()
            c = np.concatenate([[0], np.cumsum(weight)])
            out[i, 6] = (c[np.minimum(np.arange(m) + RUN, m)] - c[:-1]).max()
            if you.any():
                y = np.concatenate([[0], np.cumsum(you)])
                at = np.flatnonzero(hit)
                near = y[np.minimum(at + NEAR + 1, m)] - y[np.maximum(at - NEAR, 0)] > 0
                out[i, 7] = near.sum() / m
    return out


def boost(x: np.ndarray, y: np.ndarray, trees=TREES, depth=DEPTH, rate=RATE, bins=BINS, l2=1.0) -> dict:
    """Histogram gradient boosting of logistic loss with complete trees; rows go left where value <= cut."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    b = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1)
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    f, forest, nf = np.full(len(y), prior), [], x.shape[1]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node, tree = np.zeros(len(y), np.int64), []
        for level in range(depth):
            k = 1 << level
            best, how = np.zeros(k), np.zeros((k, 2), np.int64) + [0, bins]
            for j in range(nf):
                key = node * bins + b[:, j]
                gs = np.bincount(key, g, k * bins).reshape(k, bins).cumsum(1)
                hs = np.bincount(key, h, k * bins).reshape(k, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < 0.3) | (ht - hs < 0.3)] = 0
                s = gain.argmax(1)
                better = gain[np.arange(k), s] > best + 1e-9
                best = np.where(better, gain[np.arange(k), s], best)
                how[better, 0], how[better, 1] = j, s[better]
            cut = [(int(j), float(cuts[j][s]) if s < len(cuts[j]) else np.inf) for j, s in how]
            tree.append(cut)
            node = 2 * node + (b[np.arange(len(y)), how[node, 0]] > how[node, 1])
        gs, hs = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
        leaf = -rate * gs / (hs + l2)
        f += leaf[node]
        forest.append((tree, leaf))
    return {"prior": prior, "forest": forest}


def raw_score(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["prior"])
    rows = np.arange(len(x))
    for tree, leaf in model["forest"]:
        node = np.zeros(len(x), np.int64)
        for cut in tree:
            j, c = np.array([a for a, _ in cut]), np.array([v for _, v in cut])
            node = 2 * node + (x[rows, j[node]] > c[node])
        f += leaf[node]
    return f


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit with one pseudo-row of each end; knots for linear interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t[0], blocks[-1][1] + t[1], blocks[-1][2], t[3]]
    xs, ys = [], []
    for total, n, lo, hi in blocks:
        v = min(max(total / n, 0.5 / (n + 1)), (n + 0.5) / (n + 1))
        xs += [lo, hi] if hi > lo else [lo]
        ys += [v, v] if hi > lo else [v]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows by hash order: id, text, y. The ids are a bounded broadcast.

    An id of several rows or labels counts as often as it has pairs of them, so the bound holds for rows; one of more than is left ends
    the sample."""
    own = docs.groupBy(id_col).agg(F.count("*").alias("__n"))
    ids = labels.where(F.col(label).isNotNull()).select(F.col(id_col), F.col(label).cast("int").alias("y")).join(own, id_col)
    first = (F.xxhash64(id_col), F.col(id_col), F.col("y"))
    upto = F.sum("__n").over(Window.orderBy(*first).rowsBetween(Window.unboundedPreceding, 0))  # over ``sample`` rows at most
    ids = ids.orderBy(*first).limit(sample).withColumn("__upto", upto).where(F.col("__upto") <= sample).select(id_col, "y")
    return docs.select(id_col, text_col).join(F.broadcast(ids), id_col).select(id_col, text_col, "y")


def fit(docs: DataFrame, labels: DataFrame, label="toxic", id_col="doc_id", text_col="text", sample=SAMPLE) -> dict:
    """Lexicon, trees and calibration from the rows of ``docs`` that have a label. The driver holds ``sample`` feature rows at most."""
    fold = F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(20))
    rows = sample_rows(docs, labels, label, id_col, text_col, sample).select(text_col, "y", F.when(fold < 9, 0).when(fold < 16, 1).otherwise(2).alias("fold"))

    def word_rows(batches):
        tally: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                plain = {normal(w)[0] for w in set((text or "").lower().split())} - {""}
                for w in plain | {w[:STEM] + "*" for w in plain if len(w) >= STEM}:
                    t = tally.setdefault(w[:64], [0, 0])
                    t[1 if y else 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()), pa.array([t[0] for t in tally.values()], pa.int64()), pa.array([t[1] for t in tally.values()], pa.int64())], names=["w", "clean", "toxic"])

    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy(F.col("y") > 0, F.col("fold") == 0).count().collect()}
    clean, toxic = float(sizes.get((False, True), 0)) + 1, float(sizes.get((True, True), 0)) + 1
    odds = F.log((F.col("toxic") + 0.1) / F.lit(toxic)) - F.log((F.col("clean") + 0.1) / F.lit(clean))
    tally = rows.where("fold = 0").select(text_col, "y").mapInArrow(word_rows, "w string, clean long, toxic long").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    top = tally.where(F.col("toxic") >= MIN_DOCS).withColumn("odds", odds).where("odds > 1.5").orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "w").limit(LEXICON).collect()
    lexicon = {r["w"]: float(r["odds"]) for r in top}

    def feature_rows(batches):
        reader = Reader(lexicon)
        for b in batches:
            for lo, hi, data, off in text_slices(b.column(0)):
                x = features(data, off, reader)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "fold", "x"])

    got = sorted((r[0], r[1], bytes(r[2])) for r in rows.where("fold > 0").mapInArrow(feature_rows, "y int, fold int, x binary").collect())
    x = np.frombuffer(b"".join(r[2] for r in got)).reshape(-1, len(NAMES))
    y, f = np.array([float(r[0] > 0) for r in got]), np.array([r[1] for r in got])
    train, hold = f == 1, f == 2
    if len(np.unique(y[train])) < 2:
        known, bad = sum(sizes.values()), sum(n for (hit, _), n in sizes.items() if hit)
        return {"lexicon": lexicon, "constant": bad / known if known else 0.0}
    trees = boost(x[train], y[train])
    if not hold.any():
        hold = train
    return {"lexicon": lexicon, "trees": trees, "iso": isotonic(raw_score(trees, x[hold]), y[hold])}


def score(df: DataFrame, model: dict, id_col="doc_id", text_col="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the ``keep`` columns, score and predicted."""

    def run(batches):
        reader = Reader(model["lexicon"])
        for b in batches:
            for lo, hi, data, off in text_slices(b.column(b.num_columns - 1)):
                if "trees" in model:
                    s = np.interp(raw_score(model["trees"], features(data, off, reader)), *model["iso"])
                else:
                    s = np.full(hi - lo, model["constant"])
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:-1]), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return spread(df.select(id_col, *keep, text_col)).mapInArrow(run, f"{fields}, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    model = fit(docs.where(~held), table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", held), model, keep=("held_out",))
