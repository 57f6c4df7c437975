"""Quality classifier: a linear-chain conditional random field labels every line of a text good or bad.

A line's features are shape rates (capitals, signs, table bars, digits, repeated words, word length, length ...) of itself and of the
lines before and after it. Weights are trained by gradient ascent of the chain's conditional likelihood, each line of a labelled
document carrying the document's label. A document's quality is the mean of its lines' forward-backward marginals weighted by
length, followed by a logistic calibration against the labels.

Fitting uses at most ``sample`` labelled rows taken by hash order, each with all its lines; scoring covers every row and whole texts.

Behaviour: a null or empty text is one empty line and scored like one; rows without a label teach nothing; repeated rows score
alike; an empty table gives an empty result; with one class or none to learn from, the score is that class's rate (1 without rows,
so that a filter keeps what it can't judge); other columns are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_WORDS, crc_mod, mix64, spread, table, text_slices, words
from .toxicity import sample_rows

SAMPLE, STEPS, STEP, L2 = 4_000, 150, 0.15, 1e-3
BASE = 12


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base features of every line, its length in bytes, and the number of lines of each row (1 at least)."""
    n = len(offsets) - 1
    nl = np.flatnonzero(data == 10)
    row_of_nl = np.searchsorted(offsets, nl, "right") - 1
    per_row = np.bincount(row_of_nl, minlength=n) + 1
    first = np.concatenate([[0], np.cumsum(per_row)[:-1]]).astype(np.int64)
    m = int(per_row.sum())
    start, end = np.empty(m, np.int64), np.empty(m, np.int64)
    is_first = np.zeros(m, bool)
    is_first[first] = True
    is_last = np.zeros(m, bool)
    is_last[first + per_row - 1] = True
    start[first], start[~is_first] = offsets[:-1], nl + 1
    end[first + per_row - 1], end[~is_last] = offsets[1:], nl
    length = end - start

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[end] - c[start]

    two = np.zeros(len(data), bool)
    if len(data) > 1:
        two[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = count(((data >= 65) & (data <= 90)) | two)
    letters = count(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0xC0))
    ws, we, _ = words(data, offsets)
    line = np.searchsorted(start, ws, "right") - 1 if m else ws
    wn = np.bincount(line, minlength=m)
    terms = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_WORDS[data] * (np.arange(len(data), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))]) if len(data) else np.zeros(1, np.uint64)
    # Position-weighted sums of equal words at different places differ by a multiple of the plain sum, which is subtracted.
    plain = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_WORDS[data])]) if len(data) else np.zeros(1, np.uint64)
    total = plain[we] - plain[ws]
    wh = mix64(terms[we] - terms[ws] - total * (ws.astype(np.uint64) * np.uint64(2)) + total * np.uint64(0x9E3779B97F4A7C15))
    same = np.zeros(len(ws), bool)
    if len(ws) > 1:
        same[1:] = (wh[1:] == wh[:-1]) & (line[1:] == line[:-1])
    size, w = np.maximum(length, 1), np.maximum(wn, 1)
    f = np.empty((m, BASE))
    f[:, 0] = np.log1p(length) / 8
    f[:, 1] = upper / np.maximum(letters, 1)
    f[:, 2] = letters / size
    f[:, 3] = np.minimum(count(data == 33) / w, 2)
    f[:, 4] = np.minimum(count(data == 124) / w, 2)
    f[:, 5] = np.minimum(count(np.isin(data, np.frombuffer(b"#$%&*+=@^_~<>\\{}[]", np.uint8))) / w, 3)
    f[:, 6] = count((data >= 48) & (data <= 57)) / size
    f[:, 7] = np.bincount(line, same, m) / w
    f[:, 8] = np.minimum(length / w / 10, 3)
    f[:, 9] = np.minimum(count(np.isin(data, np.frombuffer(b".,;:?", np.uint8))) / w, 2)
    f[:, 10] = np.minimum(wn, 5) / 5
    f[:, 11] = length == 0
    return f, length, per_row


def with_neighbours(f: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """A line's features, those of the lines before and after it (0 beyond the text's ends), and a constant."""
    m = len(f)
    first = np.concatenate([[0], np.cumsum(per_row)[:-1]]).astype(np.int64)
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[first] = 0
    after[first + per_row - 1] = 0
    ends = np.zeros((m, 2))
    ends[first, 0] = 1
    ends[first + per_row - 1, 1] = 1
    return np.concatenate([f, f * f, before, after, ends, np.ones((m, 1))], 1)


def forward_backward(e: np.ndarray, t: np.ndarray, per_row: np.ndarray):
    """For chains with state scores e [line, 2] and transitions t [2, 2], all chains a step at a time:
    marginals [line, 2], summed pair marginals [2, 2] and the sum of log partition values."""
    n, m = len(per_row), len(e)
    first = np.concatenate([[0], np.cumsum(per_row)[:-1]]).astype(np.int64)
    order = np.argsort(-per_row, kind="stable")
    first, lengths = first[order], per_row[order]
    alive = [int(np.searchsorted(-lengths, -k, "left")) for k in range(int(lengths.max(initial=0)) + 1)]  # chains longer than k
    a, b, scale = np.empty((m, 2)), np.ones((m, 2)), np.empty(m)
    top = e.max(1, keepdims=True)
    x, tr = np.exp(e - top), np.exp(t)
    for k in range(len(alive) - 1):
        i = first[: alive[k]] + k
        v = x[i] if k == 0 else (a[i - 1] @ tr) * x[i]
        s = v.sum(1)
        a[i], scale[i] = v / s[:, None], s
    pair = np.zeros((2, 2))
    for k in range(len(alive) - 2, 0, -1):
        i = first[: alive[k]] + k
        u = x[i] * b[i] / scale[i][:, None]
        b[i - 1] = u @ tr.T
        pair += (a[i - 1].T @ u) * tr
    return a * b, pair, float(np.log(scale).sum() + top.sum())


def train(x: np.ndarray, per_row: np.ndarray, y: np.ndarray, steps=STEPS, step=STEP, l2=L2) -> dict:
    """Weights of the good state [feature] against the bad one's 0, and transitions, by Adam on the mean log-likelihood."""
    label = np.repeat(y, per_row).astype(int)
    theta = np.zeros(x.shape[1] + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    pairs = np.zeros((2, 2))
    inner = np.bincount(y.astype(int), per_row - 1, 2)
    pairs[0, 0], pairs[1, 1] = inner
    observed = np.concatenate([x[label == 1].sum(0), pairs.ravel()])
    for k in range(1, steps + 1):
        e = np.zeros((len(x), 2))
        e[:, 1] = x @ theta[:-4]
        marginal, pair, _ = forward_backward(e, theta[-4:].reshape(2, 2), per_row)
        g = (observed - np.concatenate([marginal[:, 1] @ x, pair.ravel()])) / len(x) - l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta += step * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return {"w": theta[:-4], "t": theta[-4:].reshape(2, 2)}


def document_scores(crf: dict, f: np.ndarray, length: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of good, as a logit."""
    x = with_neighbours(f, per_row)
    e = np.zeros((len(x), 2))
    e[:, 1] = x @ crf["w"]
    good = forward_backward(e, crf["t"], per_row)[0][:, 1]
    first = np.concatenate([[0], np.cumsum(per_row)[:-1]]).astype(np.int64)
    weight = length + 1e-6
    q = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first) if len(first) else np.zeros(0)
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a one-feature logistic fit by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * z).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
    return max(float(a), 0.0), float(b)


def fit(docs: DataFrame, labels: DataFrame, label="quality", id_col="doc_id", text_col="text", sample=SAMPLE) -> dict:
    """The chain's weights and the calibration. The driver holds the line features of ``sample`` documents at most;
    its memory grows with their lines, its steps with the lines of the longest."""
    rows = sample_rows(docs, labels, label, id_col, text_col, sample).select(text_col, "y")

    def run(batches):
        for b in batches:
            for lo, hi, data, off in text_slices(b.column(0)):
                f, length, per_row = line_features(data, off)
                at = np.concatenate([[0], np.cumsum(per_row)])
                out = [np.concatenate([f[p:q], length[p:q, None]], 1).astype(np.float32).tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(out, pa.binary())], names=["y", "x"])

    got = sorted((int(r[0] > 0), bytes(r[1])) for r in rows.mapInArrow(run, "y int, x binary").collect())
    y = np.array([r[0] for r in got])
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 1.0}
    parts = [np.frombuffer(r[1], np.float32).reshape(-1, BASE + 1).astype(float) for r in got]
    per_row = np.array([len(p) for p in parts])
    all_lines = np.concatenate(parts)
    f, length = all_lines[:, :BASE], all_lines[:, BASE]
    crf = train(with_neighbours(f, per_row), per_row, y)
    return crf | {"calibration": logistic(document_scores(crf, f, length, per_row), y)}


def score(df: DataFrame, model: dict, text_col="text") -> DataFrame:
    """Adds ``score`` and ``predicted`` to all columns; columns of these names are replaced."""
    keep = [f for f in df.schema.fields if f.name not in ("score", "predicted")]

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for lo, hi, data, off in text_slices(b.column(at)):
                if "w" in model:
                    a, c = model["calibration"]
                    s = 1 / (1 + np.exp(-np.clip(a * document_scores(model, *line_features(data, off)) + c, -30, 30)))
                else:
                    s = np.full(hi - lo, model["constant"])
                yield pa.RecordBatch.from_arrays([*(x.slice(lo, hi - lo) for x in b.columns), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return spread(df.select([F.col(f"`{f.name}`") for f in keep])).mapInArrow(run, f"{fields}, score double, predicted int")


def learned(df: DataFrame):
    """The rows that labels may be learned from: those not held out."""
    return df.where(crc_mod("doc_id", 3) != 1)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(learned(docs), table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text"), model).drop("text")
