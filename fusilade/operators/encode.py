"""Encoders as parameters: batches of texts to dense vectors, or to term logits for sparse ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval as H

DENSE_BATCH, SPARSE_BATCH, MOST_TOKENS = 256, 8, 512


def dense(df: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], Sequence]], dims: int, batch: int = DENSE_BATCH) -> DataFrame:
    """(key, vec): ``make`` is called once a task, on the worker, and its encoder gets ``batch`` texts at a time. A null text has no
    vector; a vector of another length than ``dims`` is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                has = part["text"].notna()
                found = iter(encode(part.loc[has, "text"].tolist()) if has.any() else [])
                vecs = [[float(x) for x in next(found)] if h else None for h in has]
                if any(v is not None and len(v) != dims for v in vecs):
                    raise ValueError(f"the encoder does not give {dims} dimensions")
                yield pd.DataFrame({"key": part["key"], "vec": vecs})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, vec array<double>").withColumnRenamed("key", key)


def sparse(df: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str], int], Sequence]], most: int = 256, batch: int = SPARSE_BATCH, tokens: int = MOST_TOKENS) -> DataFrame:
    """(key, term, w): the encoder gets texts and the number of tokens to cut them at, and gives each text's (term, logit) pairs, of all
    positions that are not padding; weights are pooled and pruned in the JVM."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for f in frames:
            f = f[f["text"].notna()]
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                rows = [(k, t, float(v)) for k, pairs in zip(part["key"], encode(part["text"].tolist(), tokens), strict=True) for t, v in pairs]
                yield pd.DataFrame(rows, columns=["key", "term", "logit"])

    kind = df.schema[key].dataType.simpleString()
    logits = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, term string, logit double")
    return H.prune(H.max_pool(logits.withColumnRenamed("key", key), key), most, key)
