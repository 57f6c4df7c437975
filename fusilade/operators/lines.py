"""Lines, running headers and sections of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as X


def lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no from 0, line stripped), empty lines included."""
    return df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line")).withColumn("line", X.strip("line"))


def running_lines(pages: DataFrame, doc: str, page: str, text: str = "text", share: float = 0.4, least: int = 3) -> DataFrame:
    """(doc, line, n): lines of 3 to 80 characters among the first and last two of at least max(least, share * pages) pages."""
    own = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), X.strip), lambda x: x != "")
    p = pages.select(doc, page, own.alias("x")).withColumn("n_lines", F.size("x"))
    edge = F.concat(F.slice("x", 1, 2), F.when(F.col("n_lines") >= 2, F.slice("x", -2, 2)).otherwise(F.col("x")))
    counted = p.select(doc, F.explode(edge).alias("line")).where(F.length("line").between(3, 80)).groupBy(doc, "line").agg(F.count("*").alias("n"))
    total = pages.groupBy(doc).agg(F.count("*").alias("pages"))
    return counted.join(total, doc).where((F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))).select(doc, "line", "n")


def clean_lines(pages: DataFrame, doc: str, page: str, text: str = "text", **options) -> DataFrame:
    """(doc, page, line_no, line) without empty lines, running lines and bare page numbers."""
    all_lines = lines(pages, [doc, page], text).where((F.col("line") != "") & ~X.is_page_number("line"))
    return all_lines.join(running_lines(pages, doc, page, text, **options).select(doc, "line"), [doc, "line"], "left_anti").select(doc, page, "line_no", "line")


def sections(df: DataFrame, keys: list[str], order: list[str], is_head: Column, head: Column | None = None) -> DataFrame:
    """Adds section_no (0 before the first heading) and head, carried forward; heading lines are marked."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("is_head", F.coalesce(is_head, F.lit(False)))
    return df.withColumn("section_no", F.sum(F.col("is_head").cast("int")).over(w).cast("int")).withColumn("head", F.last(F.when(F.col("is_head"), head if head is not None else F.col("line")), True).over(w))


def toc_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, page) of ``Title; page)`` entries; the first title of a page."""
    pattern = F.lit("([A-Z][^.;\\n]{4,55}?);\\s*(\\d+)\\)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("title"), F.regexp_extract_all(text, pattern, 2).alias("page"))
    out = df.select(key, F.posexplode(pairs).alias("k", "e")).select(key, "k", F.regexp_replace("e.title", "\\s+", " ").alias("title"), F.col("e.page").cast("int").alias("page"))
    return out.withColumn("r", F.row_number().over(Window.partitionBy(key, "page").orderBy("k"))).where("r = 1").select(key, "title", "page")


def toc_offset(toc: DataFrame, page_lines: DataFrame, key: str, from_page: int = 15, default: int = 17) -> DataFrame:
    """(key, offset): median difference between the page where a title of three words or more stands and the page that the table names."""
    norm = lambda c: F.lower(F.regexp_replace(X.strip(c), "[.;:]+$", ""))
    titles = toc.where(F.size(F.split("title", " ")) >= 3).select(key, norm("title").alias("t"), F.col("page").alias("named"))
    seen = page_lines.where(F.col("page") >= from_page).select(key, norm("line").alias("t"), "page").groupBy(key, "t").agg(F.min("page").alias("found"))
    found = titles.join(seen, [key, "t"]).groupBy(key).agg(F.median(F.col("found") - F.col("named")).cast("int").alias("offset"))
    return toc.select(key).distinct().join(found, key, "left").select(key, F.coalesce("offset", F.lit(default)).alias("offset"))


def page_range(pages: DataFrame, key: str, first: int, last: int, page: str = "page", text: str = "text") -> DataFrame:
    """(key, text): the text of the pages ``first`` to ``last`` of each document, in order, joined by line ends."""
    some = pages.where(F.col(page).between(first, last))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    return some.groupBy(key).agg(joined.alias("text"))


def range_sections(starts: DataFrame, items: DataFrame, start: str, at: str, title: str, by: list[str] | None = None) -> DataFrame:
    """Items with the section whose half-open range [start, next start) holds them; the last range is open.

    With ``by`` (document keys) sections and items of a document are merged in order and each item takes the last start before it: one
    shuffle by document, no range join. Without, the bounds are a small table of one document, broadcast if Spark's size check allows."""
    if by:
        own = [c for c in starts.columns if c not in by]
        marks = starts.select(*by, F.struct(F.col(start).cast("long").alias("__at"), F.lit(0).alias("__kind")).alias("__o"), F.struct(*own).alias("__s"), F.lit(None).cast(items.select(F.struct("*").alias("i")).schema["i"].dataType).alias("__i"))
        rows = items.select(*by, F.struct(F.col(at).cast("long").alias("__at"), F.lit(1).alias("__kind")).alias("__o"), F.lit(None).cast(starts.select(F.struct(*own).alias("s")).schema["s"].dataType).alias("__s"), F.struct("*").alias("__i"))
        last = F.last("__s", True).over(Window.partitionBy(*by).orderBy("__o").rowsBetween(Window.unboundedPreceding, 0))
        both = marks.unionByName(rows).withColumn("__s", last).where("__i IS NOT NULL AND __s IS NOT NULL")
        return both.select("__i.*", *[F.col(f"__s.`{c}`").alias(c) for c in own])
    bounds = starts.withColumn("__end", F.lead(start, 1, (1 << 63) - 1).over(Window.orderBy(start)))
    return items.join(bounds, (F.col(at) >= F.col(start)) & (F.col(at) < F.col("__end"))).drop("__end")


def font_sections(df: DataFrame, keys: list[str], order: list[str], size: str = "size", step: float = 1.5) -> DataFrame:
    """Sections of lines with sizes: a heading is ``step`` above the document's most frequent size, 3 characters and 12 words at most."""
    counts = df.groupBy(*keys, size).count()
    mode = counts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), size))).where("r = 1").select(*keys, F.col(size).alias("body_size"))
    df = df.where(~X.is_bullet_header("line")).join(mode, keys)
    is_head = (F.col(size) >= F.col("body_size") + step) & (F.length("line") >= 3) & (F.size(F.split("line", "\\s+")) <= 12)
    return sections(df, keys, order, is_head)


def sign_sections(df: DataFrame, keys: list[str], order: list[str], size: str = "size", step: float = 1.5) -> DataFrame:
    """Body lines of sections found by size or by a run-in heading in capitals: keys, order, line, section_no, head, meta.

    A run-in heading opens its line, whose rest is the section's first line. A chapter named after a sign sets the sign of the generic
    headings after it, which then carry it in front of their own words; other headings leave it as it is."""
    counts = df.groupBy(*keys, size).count()
    mode = counts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), size))).where("r = 1").select(*keys, F.col(size).alias("__body"))
    rows = df.where(~X.is_bullet_header("line")).join(mode, keys)
    run_in = X.run_in_heading("line")
    by_size = (F.col(size) >= F.col("__body") + step) & (F.length("line") >= 3) & (F.size(F.split("line", "\\s+")) <= 12)
    rows = rows.withColumn("__run", run_in).withColumn("__sized", F.col("__run").isNull() & by_size)
    w = Window.partitionBy(*keys).orderBy(*order)
    plain = X.font_heading("line", F.lit(None))
    chapter = F.when(F.col("__sized") & (plain["indicator_type"] == "sign_chapter"), plain["sign"])
    rows = rows.withColumn("__sign", F.last(chapter, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    found = F.when(F.col("__run").isNotNull(), F.col("__run.meta")).when(F.col("__sized"), X.font_heading("line", F.col("__sign")))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__found", found).withColumn("meta", F.last("__found", True).over(upto)).withColumn("section_no", F.count("__found").over(upto).cast("int"))
    generic = (F.col("meta.indicator_type") == "sign_section") & F.col("meta.sign").isNotNull()
    head = F.when(generic, F.concat(F.initcap("meta.sign"), F.lit(" › "), F.col("meta.section"))).otherwise(F.col("meta.section"))
    body = F.when(F.col("__run").isNotNull(), F.col("__run.rest")).when(~F.col("__sized"), F.col("line"))
    return rows.select(*keys, *order, body.alias("line"), "section_no", head.alias("head"), "meta").where("line <> ''")
