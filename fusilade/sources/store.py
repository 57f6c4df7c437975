"""Sources and sinks: JSON lines, HTML layout, upsert, replacement, stage cache, CSV."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], pattern: str | None = None) -> DataFrame:
    """(path, page from 1, text) of binary documents. ``parse`` gives a file's page texts; a file is read and parsed by one task.

    No parser is included. A file that ``parse`` fails on fails the query."""
    files = spark.read.format("binaryFile")
    files = (files.option("pathGlobFilter", pattern) if pattern else files).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                texts = parse(bytes(content))
                yield pd.DataFrame({"path": name, "page": range(1, len(texts) + 1), "text": texts})

    return files.mapInPandas(run, "path string, page int, text string")


def connect(url: str | None, table: str, **options: str) -> Callable[[SparkSession], DataFrame]:
    """A reader of a table behind a JDBC address; without an address it is an error, before any session is needed."""
    if not url:
        raise ValueError("no database address is set")
    return lambda spark: spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


#: Pseudo font sizes of HTML blocks.
HTML_SIZES = {"title": 20.0, "h1": 18.0, "h2": 16.0, "h3": 14.0, "p": 10.0, "li": 10.0}


#: Pseudo font sizes of all headings; other text, bold too, has BODY_SIZE.
HEADING_SIZES, BODY_SIZE = {"title": 20.0, "h1": 18.0, "h2": 16.0, "h3": 14.0, "h4": 13.0, "h5": 12.0, "h6": 11.0}, 10.0
BLOCK_TAGS = (*HEADING_SIZES, *"p li div article section nav header footer main aside ul ol dl dt dd table caption thead tbody tfoot tr td th blockquote pre form fieldset legend figure figcaption address details summary option center hr html head body".split())
#: Patterns of what is never text, block tags, line breaks and other tags; a page may end inside any of them.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script(?:[\s/][^>]*)?>.*?(?:</script\s*>|\z)|<style(?:[\s/][^>]*)?>.*?(?:</style\s*>|\z)|[\x01-\x03]"
BLOCK, BREAK, TAG = rf"(?is)<(/?(?:{'|'.join(BLOCK_TAGS)}))(?:[\s/][^>]*)?>", r"(?is)<br(?:[\s/][^>]*)?>", r"(?s)<[a-zA-Z/!?][^>]*(?:>|\z)"


def html_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, line_no, line, size): all text of a page in order, cut at block tags and br, with the size of the tag before it.

    Scripts, styles, comments and inline tags are left out; text after a closing tag has the body's size. Entities stay as written."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    for pattern, mark in ((BLOCK, "\x01$1\x02"), (BREAK, "\x03"), (TAG, "")):
        text = F.regexp_replace(text, pattern, mark)
    sizes = F.create_map(*[F.lit(x) for pair in HEADING_SIZES.items() for x in pair])

    def block(x):
        part = F.split(x, "\x02")
        return F.transform(F.split(part[1], "\x03"), lambda y: F.struct(y.alias("line"), F.coalesce(sizes[F.lower(part[0])], F.lit(BODY_SIZE)).alias("size")))

    rows = pages.select(key, F.posexplode(F.flatten(F.transform(F.split(F.concat(F.lit("\x02"), text), "\x01"), block))).alias("line_no", "b"))
    return rows.select(key, "line_no", X.strip("b.line").alias("line"), F.col("b.size").alias("size")).where("line <> ''")


def opening_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, line_no, line, size): only the text between an opening tag of HTML_SIZES and the next tag; ``html_lines`` has all text."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)[^>]*>.*?</\\1>", "")
    pattern = F.lit(f"(?is)<({'|'.join(HTML_SIZES)})(?:\\s[^>]*)?>([^<]*)")
    zipped = F.arrays_zip(F.transform(F.regexp_extract_all(body, pattern, 1), F.lower).alias("tag"), F.regexp_extract_all(body, pattern, 2).alias("line"))
    sizes = F.create_map(*[F.lit(x) for pair in HTML_SIZES.items() for x in pair])
    rows = pages.select(key, F.posexplode(zipped).alias("line_no", "b")).select(key, "line_no", X.strip("b.line").alias("line"), sizes[F.col("b.tag")].alias("size"))
    return rows.where("line <> ''")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; the others stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replace_chunks(spark: SparkSession, chunks: DataFrame, path: str, by: str = "document_id") -> None:
    """Overwrites the partitions of the documents at hand, and no others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def zip_strict(chunks: DataFrame, vectors: DataFrame, on: list[str]) -> DataFrame:
    """Joins chunks and vectors one to one; fails when read if either side has a row alone."""
    both = chunks.withColumn("__c", F.lit(1)).join(vectors.withColumn("__v", F.lit(1)), on, "full")
    ok = F.col("__c").isNotNull() & F.col("__v").isNotNull()
    return both.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("chunks and vectors differ in length")).cast("boolean"))).drop("__c", "__v")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's Parquet result: read if it was written whole, else made and written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
