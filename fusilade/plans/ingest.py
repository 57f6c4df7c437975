"""From pages to chunks: a registry says how each source is divided; one plan does all of them.

Pages: (slug, page, text). Layout: (slug, page, line_no, line, size), for sources that are divided by type size. A chunk has its number in
the source, its text, pages, tokens and metadata: what its section is, and the vocabulary's terms in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import lines as L
from ..operators import windows as W

REGISTRY = "slug string, title string, author string, strategy string, target int, overlap int"
TRANSIT_TARGET, TRANSIT_OVERLAP = 900, 80
META = ("indicator_type", "context", "transiting", "aspect", "natal", "house", "planet", "sign", "section")
TAGS = {"planets": V.PLANETS, "signs": V.SIGNS, "aspects": V.ASPECTS}


def registry(spark: SparkSession, sources: Iterable[tuple]) -> DataFrame:
    """(slug, title, author, strategy, target, overlap) of every source; slugs are unique."""
    rows = list(sources)
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a slug names two sources")
    return spark.createDataFrame(rows, REGISTRY)


def _meta(**given: Column) -> list[Column]:
    return [given.get(n, F.lit(None)).cast("int" if n == "house" else "string").alias(n) for n in META]


def _sections(clean: DataFrame, found: Column, keep: list[str]) -> DataFrame:
    """Body lines with the section that the last heading line before them opened; those before the first have none."""
    marked = clean.withColumn("found", found)
    s = L.sections(marked, ["slug"], ["page", "line_no"], F.col("found").isNotNull(), F.col("found"))
    return s.where(~F.col("is_head")).select("slug", "page", "line_no", "line", "section_no", *keep)


def transit_sections(clean: DataFrame) -> DataFrame:
    """Sections at headings of aspects, angles and houses; lines before the first heading have the context alone."""
    s = _sections(clean, X.transit_heading("line"), ["head"])
    given = {n: F.col(f"head.{n}") for n in ("indicator_type", "transiting", "aspect", "natal", "house", "section")}
    return s.select("slug", "page", "line_no", "line", "section_no", F.col("head.section").alias("heading"), *_meta(context=F.lit("transit"), **given))


def line_sections(clean: DataFrame, is_head: Column | None = None) -> DataFrame:
    """Sections at lines that look like headings (or that ``is_head`` says are)."""
    found = F.when(X.heading_candidate("line") if is_head is None else is_head, F.struct(F.col("line").alias("section")))
    s = _sections(clean, found, ["head"])
    return s.select("slug", "page", "line_no", "line", "section_no", F.col("head.section").alias("heading"), *_meta(section=F.col("head.section")))


def toc_sections(clean: DataFrame, pages: DataFrame, first: int = 12, last: int = 15, **options) -> DataFrame:
    """Sections by the table of contents, which stands on the pages ``first`` to ``last``: each from its page to the next one's."""
    toc = L.toc_entries(L.page_range(pages, "slug", first, last), "slug", "text")
    offset = L.toc_offset(toc, pages.select("slug", (F.col("page") - 1).alias("page"), F.explode(F.split("text", "\n")).alias("line")), "slug", **options)
    starts = toc.join(offset, "slug").select("slug", (F.col("page") + F.col("offset")).cast("long").alias("start"), F.col("title").alias("heading"))
    s = L.range_sections(starts, clean, "start", "page", "heading", by=["slug"])
    given = {"indicator_type": X.toc_indicator("heading"), "context": F.lit("natal"), "section": F.col("heading")}
    return s.select("slug", "page", "line_no", "line", F.col("start").alias("section_no"), "heading", *_meta(**given))


def font_sections(layout: DataFrame) -> DataFrame:
    """Sections by type size and run-in headings."""
    s = L.sign_sections(layout, ["slug"], ["page", "line_no"])
    given = {n: F.col(f"meta.{n}") for n in ("indicator_type", "planet", "sign", "section")}
    return s.where("section_no > 0").select("slug", "page", "line_no", "line", "section_no", F.col("head").alias("heading"), *_meta(context=F.lit("natal"), **given))


def whole(clean: DataFrame) -> DataFrame:
    """One section without heading."""
    return clean.select("slug", "page", "line_no", "line", F.lit(0).alias("section_no"), F.lit(None).cast("string").alias("heading"), *_meta())


def chunk_sources(pages: DataFrame, sources: DataFrame, layout: DataFrame | None = None, strategies: dict[str, Callable[[DataFrame], DataFrame]] | None = None, running: dict | None = None) -> DataFrame:
    """Chunks of all sources in the registry, each by its strategy; an unknown strategy fails when the data is read.

    (slug, chunk_index, content, page_start, page_end, token_count, metadata ..., planets, signs, aspects). ``strategies`` adds to or
    replaces the known ones: clean lines to lines with section_no, heading and metadata. The registry is joined, by broadcast if Spark
    finds it small."""
    known = {"transit_sections": transit_sections, "line_sections": line_sections, "token_windows": whole} | (strategies or {})
    pages = pages.join(sources.select("slug", "strategy"), "slug")
    clean = L.clean_lines(pages.drop("strategy"), "slug", "page", **(running or {})).join(sources.select("slug", "strategy"), "slug")
    parts = [f(clean.where(F.col("strategy") == name).drop("strategy")) for name, f in known.items()]
    if "toc_sections" not in known:
        parts.append(toc_sections(clean.where("strategy = 'toc_sections'").drop("strategy"), pages.where("strategy = 'toc_sections'").drop("strategy")))
        known["toc_sections"] = toc_sections
    if layout is not None and "font_sections" not in known:
        parts.append(font_sections(layout.join(sources.where("strategy = 'font_sections'").select("slug"), "slug")))
        known["font_sections"] = font_sections
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    fine = F.col("strategy").isin(*known)
    checked = sources.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no strategy "), F.coalesce("strategy", F.lit("null")))).cast("boolean")))
    transit = F.col("strategy") == "transit_sections"
    sized = checked.select("slug", F.when(transit, TRANSIT_TARGET).otherwise(F.col("target")).alias("target"), F.when(transit, TRANSIT_OVERLAP).otherwise(F.col("overlap")).alias("overlap"))
    keys = ["slug", "section_no", *META]
    w = W.token_windows(lines.join(sized, "slug"), keys, F.struct("page", "line_no"), head="heading", page="page", target=F.col("target"), overlap=F.col("overlap"))
    tags = [X.entity_tags("content", terms).alias(n) for n, terms in TAGS.items()]
    return W.numbered(w, ["slug"], ["section_no", "window_no"]).select("slug", "chunk_index", "content", "page_start", "page_end", "token_count", *META, *tags)


def page_paragraphs(pages: DataFrame, **running) -> DataFrame:
    """(slug, page, paragraphs): what is left of each page without running lines and page numbers, as paragraphs; empty pages go."""
    lines = L.lines(pages, ["slug", "page"]).where(~X.is_page_number("line"))
    kept = lines.join(L.running_lines(pages, "slug", "page", **running).select("slug", "line"), ["slug", "line"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    whole_pages = kept.groupBy("slug", "page").agg(text.alias("text"))
    return whole_pages.select("slug", "page", X.paragraphs("text").alias("paragraphs")).where(F.size("paragraphs") > 0)
