"""Token windows: lines packed greedily up to a target, the next window starting with an overlap of whole lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions import text as X


def bounds(counts: np.ndarray, target: int, overlap: int) -> list[tuple[int, int]]:
    """Inclusive line ranges from prefix sums: a window always takes one new line, else as many as fit the target; the carry is the longest
    run of last lines within the overlap."""
    c = np.concatenate([[0], np.cumsum(counts)])
    n, out, s, new = len(counts), [], 0, 0
    while new < n:
        e = max(new, int(np.searchsorted(c, c[s] + target, "right")) - 2)
        out.append((s, e))
        new = e + 1
        s = max(s, min(new, int(np.searchsorted(c, c[new] - overlap, "left"))))
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _spans(counts: pd.Series, target: pd.Series, overlap: pd.Series) -> pd.Series:
    """``bounds`` of a batch of sections; only the token counts travel to Python, the lines stay in the JVM."""
    return pd.Series([bounds(np.asarray(c), t, o) for c, t, o in zip(counts, target, overlap, strict=True)])


def _value(v: int | Column) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("int")


def token_windows(df: DataFrame, keys: list[str], order: str | Column, line: str = "line", head: str | None = None, page: str | None = None, target: int | Column = 450, overlap: int | Column = 60) -> DataFrame:
    """Per section (``keys``): window_no, content (heading, blank line, reflowed lines), first and last page, token_count.

    ``target`` and ``overlap`` may be columns that are the same in all rows of a section. A section's lines are gathered in one row."""
    first = order if isinstance(order, Column) else F.col(order)
    row = F.struct(first.alias("o"), F.col(line).alias("l"), X.n_tokens(line).alias("n"), (F.col(page) if page else F.lit(0)).cast("long").alias("p"))
    shared = [F.first(c, True).alias(n) for c, n in (((F.col(head) if head else F.lit(None)).cast("string"), "head"), (_value(target), "__t"), (_value(overlap), "__v"))]
    own = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__rows"), *shared)
    own = own.withColumn("__spans", _spans(F.col("__rows.n"), F.col("__t"), F.col("__v")))
    one = own.select(*keys, "head", "__rows", F.posexplode("__spans").alias("window_no", "__span"))
    part = F.slice("__rows", F.col("__span")[0] + 1, F.col("__span")[1] - F.col("__span")[0] + 1)
    one = one.select(*keys, "head", "window_no", part.alias("part"))
    body = X.reflow(F.col("part.l"))
    content = F.when(F.col("head").isNotNull(), F.concat("head", F.lit("\n\n"), body)).otherwise(body)
    out = one.select(*keys, "window_no", content.alias("content"), F.array_min("part.p").alias("page_start"), F.array_max("part.p").alias("page_end"))
    return out.select("*", X.n_tokens("content").alias("token_count"))


def numbered(df: DataFrame, doc: list[str], order: list[str], **options) -> DataFrame:
    """Drops what isn't useful, then numbers what is left through each document from 0."""
    return df.where(X.useful("content", **options)).withColumn("chunk_index", F.row_number().over(Window.partitionBy(*doc).orderBy(*order)) - 1)
