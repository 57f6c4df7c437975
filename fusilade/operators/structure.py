"""Structure of a corpus: sizes of type, heading lines, lengths of sections and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as X
from ..functions import vocabulary as V
from . import lines as L

_BODIES = "|".join(b.title() for b in V.HEADING_BODIES)
#: A line that begins with two bodies and an aspect between them.
HEADING_LINE = f"^({_BODIES})\\s+({'|'.join(a.title() for a in V.SCANNED_ASPECTS)})\\s+({_BODIES})(?![A-Za-z0-9_])"


def first_samples(df: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """(by, samples): the first ``n`` values of each group; groups are cut before they are gathered."""
    w = Window.partitionBy(*by).orderBy(*order)
    cut = df.select(*by, F.col(value).alias("v"), F.row_number().over(w).alias("r")).where(F.col("r") <= n)
    return cut.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("samples"))


def size_histogram(df: DataFrame, keys: list[str], order: list[str], size: str = "size", line: str = "line", least: int = 30, step: float = 0.4, n_samples: int = 3) -> DataFrame:
    """(keys, size, chars, is_heading, samples) for sizes of ``least`` characters or more; a heading's size is above the size that holds
    most characters, plus ``step``."""
    chars = df.groupBy(*keys, size).agg(F.sum(F.length(line)).cast("long").alias("chars"))
    own = Window.partitionBy(*keys)
    chars = chars.withColumn("body", F.first(size).over(own.orderBy(F.desc("chars"), size)))
    kept = chars.where(F.col("chars") >= least).select(*keys, size, "chars", (F.col(size) > F.col("body") + step).alias("is_heading"))
    short = df.select(*keys, size, *order, F.substring(line, 1, 60).alias("s")).where("s <> ''")
    return kept.join(first_samples(short, [*keys, size], order, "s", n_samples), [*keys, size], "left")


def heading_scan(df: DataFrame, keys: list[str], order: list[str], line: str = "line", pattern: str = HEADING_LINE, n_samples: int = 8) -> DataFrame:
    """(keys, n, samples): how many lines begin like a heading, and the first of them."""
    hit = df.where(F.col(line).rlike(pattern))
    return hit.groupBy(*keys).agg(F.count("*").alias("n")).join(first_samples(hit.withColumn("s", F.substring(line, 1, 50)), keys, order, "s", n_samples), keys)


def section_sizes(df: DataFrame, keys: list[str], order: list[str], is_head, line: str = "line") -> DataFrame:
    """(keys, section_no, n_tokens) of the text from a heading to the next; what comes before the first and after the last is left out."""
    s = L.sections(df, keys, order, is_head).where("section_no > 0")
    sized = s.groupBy(*keys, "section_no").agg(F.sum(X.n_tokens(line)).cast("long").alias("n_tokens"))
    last = F.max("section_no").over(Window.partitionBy(*keys))
    return sized.withColumn("last", last).where("section_no < last AND n_tokens > 0").drop("last")


def paragraph_sizes(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n_tokens) of every paragraph that has tokens; blank lines divide."""
    parts = F.split(F.coalesce(text, F.lit("")), "\\n[ \\t\\r\\n\\f]*\\n")
    return df.select(*keys, F.explode(parts).alias("p")).select(*keys, X.n_tokens("p").cast("long").alias("n_tokens")).where("n_tokens > 0")


def judged_precision(ranking: DataFrame, judged: DataFrame, k: int, judge: str = "relevant") -> DataFrame:
    """(query_id, precision): share of the top ``k`` that a judge calls relevant; what it hasn't seen is not. ``judged`` is unique by chunk_id."""
    top = ranking.where(F.col("rank") <= k).join(judged.select("chunk_id", judge), "chunk_id", "left")
    return top.groupBy("query_id").agg((F.sum(F.coalesce(F.col(judge).cast("int"), F.lit(0))) / F.lit(float(k))).alias("precision"))
