"""Text expressions: JVM-side column functions, no UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

TOKEN = "[a-z0-9']+"
BLANK = "[ \\t\\r\\n\\f]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(text: str | Column, pattern: str = TOKEN) -> Column:
    """Lower-cased tokens in order; null text gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(pattern), 0)


def n_tokens(text: str | Column) -> Column:
    return F.size(tokens(text))


def focus_query(question: str | Column, frame: Sequence[str] = V.FRAME_WORDS) -> Column:
    """The question's words without framing words; the question itself, as it was, if nothing is left."""
    stop = _words(frame)
    kept = F.filter(tokens(question), lambda t: ~F.array_contains(stop, t))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(_col(question))


def diagnostic_terms(question: str | Column, stop: Sequence[str] = V.DIAGNOSTIC_STOP_WORDS) -> Column:
    """Distinct words of more than two letters, in order, that are not stop words."""
    s = _words(stop)
    return F.array_distinct(F.filter(tokens(question, "[a-z]+"), lambda t: ~F.array_contains(s, t) & (F.length(t) > 2)))


def entity_tags(text: str | Column, terms: Sequence[str]) -> Column:
    """Sorted distinct terms of a vocabulary that stand in the text as whole words, longest term first; null if there are none."""
    alternatives = "|".join(t.replace(" ", "\\s+") for t in sorted(terms, key=len, reverse=True))
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(f"\\b({alternatives})\\b"), 1)
    found = F.array_sort(F.array_distinct(found))
    return F.when(F.size(found) > 0, found)


def strip(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), f"^{BLANK}+|{BLANK}+$", "")


def is_page_number(line: str | Column) -> Column:
    """Arabic or roman digits alone, six at most."""
    return _col(line).rlike("^[ \\t]*[ivxlcdmIVXLCDM0-9]{1,6}[ \\t]*$")


def is_bullet_header(line: str | Column) -> Column:
    """A running header with a bullet beside its page number."""
    return _col(line).rlike("^[0-9]+[ \\t]*[•·]") | _col(line).rlike("[•·][ \\t]*[0-9]+$")


def dehyphenate(text: str | Column) -> Column:
    """Joins words that a hyphen splits at a line's end."""
    return F.regexp_replace(_col(text), "([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])", "$1$2")


def reflow(lines: Column) -> Column:
    """One line from an array of lines: a hyphen after a letter glues, a space joins; white space collapses."""
    joined = F.regexp_replace(F.array_join(lines, "\n"), "(\\p{L})-\\n", "$1")
    return strip(F.regexp_replace(joined, f"{BLANK}+", " "))


def paragraphs(text: str | Column) -> Column:
    """Blank lines end a paragraph; lines inside it join with a space; an array of paragraphs without empty ones."""
    parts = F.split(dehyphenate(text), "\\n[ \\t]*\\n")
    flat = F.transform(parts, lambda p: strip(F.regexp_replace(F.regexp_replace(p, "\\n", " "), "[ \\t]+", " ")))
    return F.filter(flat, lambda p: p != "")


def useful(text: str | Column, min_words: int = 12, most_codes: float = 0.5) -> Column:
    """At least ``min_words`` words, and at most that share of them without a small letter."""
    w = F.filter(F.split(_col(text), f"{BLANK}+"), lambda t: t != "")
    codes = F.size(F.filter(w, lambda t: ~t.rlike("\\p{Ll}")))
    return (F.size(w) >= min_words) & (codes / F.greatest(F.size(w), F.lit(1)) <= most_codes)


def citation(title: str | Column, author: str | Column, first: str | Column, last: str | Column) -> Column:
    """``Title (Author), p.N`` or ``pp.N-M``."""
    first, last = _col(first).cast("string"), _col(last).cast("string")
    pages = F.when(first == last, F.concat(F.lit("p."), first)).otherwise(F.concat(F.lit("pp."), first, F.lit("-"), last))
    book = F.when(_col(author).isNotNull() & (_col(author) != ""), F.concat(_col(title), F.lit(" ("), _col(author), F.lit(")"))).otherwise(_col(title))
    return F.concat(book, F.lit(", "), pages)


def picked_numbers(reply: str | Column) -> Column:
    """The first JSON array of whole numbers in a reply; empty if there is none."""
    found = F.from_json(F.regexp_extract(_col(reply), "\\[[0-9, \\t\\n]*\\]", 0), "array<int>")
    return F.coalesce(found, F.array().cast("array<int>"))


def preview(text: str | Column, chars: int) -> Column:
    flat = F.translate(_col(text), "\n", " ")
    return F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars), F.lit("…"))).otherwise(flat)


def heading_candidate(line: str | Column) -> Column:
    """Chapter or roman prefix, Title Case of 2 to 6 words, or ALL CAPS of 3 to 40 characters."""
    c, n = _col(line), F.size(F.split(_col(line), " +"))
    title = c.rlike("^(\\p{Lu}[^ ]*)( \\p{Lu}[^ ]*)*$") & n.between(2, 6)
    caps = (F.upper(c) == c) & c.rlike("\\p{Lu}") & F.length(c).between(3, 40)
    return c.rlike("^(Chapter|CHAPTER|Part|PART) ") | c.rlike("^[IVXLC]+\\. ") | title | caps


def _any(words: Sequence[str]) -> str:
    return "(" + "|".join(words) + ")"


def transit_heading(line: str | Column) -> Column:
    """Struct of a transit heading's metadata: aspects, angle aspects and house ingresses; null for other lines."""
    low = F.lower(strip(line))
    bodies = _any(V.HEADING_BODIES)
    aspect, house = f"^{bodies}\\s+{_any(V.HEADING_ASPECTS)}\\s+{bodies}$", f"^{bodies}\\s+in\\s+the\\s+{_any(V.ORDINALS)}\\s+house$"
    natal = F.regexp_extract(low, aspect, 3)
    number = F.array_position(_words(V.ORDINALS), F.regexp_extract(low, house, 2)).cast("int")
    null = F.lit(None)

    def meta(kind, transiting, asp, nat, num):
        return F.struct(kind.alias("indicator_type"), F.lit("transit").alias("context"), transiting.alias("transiting"), asp.cast("string").alias("aspect"), nat.cast("string").alias("natal"), num.cast("int").alias("house"), strip(line).alias("section"))

    kind = F.when(natal.isin("ascendant", "midheaven"), "angle_aspect").otherwise("transit_aspect")
    return F.when(low.rlike(aspect), meta(kind, F.regexp_extract(low, aspect, 1), F.regexp_extract(low, aspect, 2), natal, null)).when(
        low.rlike(house), meta(F.lit("house_ingress"), F.regexp_extract(low, house, 1), null, null, number))


def toc_indicator(title: str | Column) -> Column:
    """Kind of a table-of-contents section; the first rule that fits."""
    low = F.lower(_col(title))
    has = lambda *w: F.greatest(*[low.contains(x) for x in w], F.lit(False))
    return (F.when(has("house"), "house_meaning").when(has("ascendant", "rising"), "ascendant").when(has("aspect"), "aspect_meaning")
            .when(has("sign", "zodiac", "decanate"), "sign_meaning").when(has("planet", "ruler", "sphere"), "planet_meaning").otherwise("section"))


def font_heading(head: str | Column, current_sign: str | Column) -> Column:
    """Struct (indicator_type, planet, sign, section) of a heading found by its size."""
    low = F.lower(strip(head))
    placed, rising = f"^{_any(V.HEADING_BODIES)}\\s+in\\s+{_any(V.SIGNS)}$", f"^{_any(V.SIGNS)}\\s+(ascendant|rising)\\b"
    make = lambda kind, planet, sign: F.struct(F.lit(kind).alias("indicator_type"), planet.cast("string").alias("planet"), sign.cast("string").alias("sign"), strip(head).alias("section"))
    return (F.when(low.rlike(placed), make("planet_in_sign", F.regexp_extract(low, placed, 1), F.regexp_extract(low, placed, 2)))
            .when(low.rlike(rising), make("ascendant", F.lit(None), F.regexp_extract(low, rising, 1)))
            .when(low.isin(*V.SIGNS), make("sign_chapter", F.lit(None), low)).otherwise(make("sign_section", F.lit(None), _col(current_sign))))


def run_in_heading(line: str | Column) -> Column:
    """Struct (meta, rest) of a line that opens with a placement in capitals; null for other lines."""
    c = _col(line)
    pattern = f"^({'|'.join(V.HEADING_BODIES).upper()})\\s+IN\\s+({'|'.join(V.SIGNS).upper()})(?![\\p{{L}}\\p{{N}}_])"
    body, sign = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    meta = F.struct(F.lit("planet_in_sign").alias("indicator_type"), F.lower(body).alias("planet"), F.lower(sign).alias("sign"), F.concat(F.initcap(F.lower(body)), F.lit(" in "), F.initcap(F.lower(sign))).alias("section"))
    return F.when(c.rlike(pattern), F.struct(meta.alias("meta"), strip(F.regexp_replace(c, pattern, "")).alias("rest")))
