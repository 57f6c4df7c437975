import pytest
from pyspark.sql import functions as F

from fusilade.functions import text as X
from fusilade.functions import vocabulary as V
from fusilade.functions.english import lexeme, stem


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("question", "focus"), [
    ("Which combinations in a natal chart make you stubborn?", "stubborn"),
    ("What makes someone confident in their natal chart?", "confident"),
    ("What does Venus in Gemini mean in a natal chart?", "venus gemini"),
    ("Saturn transit through the seventh house", "saturn transit through seventh house"),
    ("What is it?", "What is it?"),
    ("STUBBORN?!", "stubborn"),
])
def test_focus(spark, question, focus):
    assert one(spark, question, X.focus_query) == focus


def test_transit_headings(spark):
    h = one(spark, "Sun Conjunct Moon", X.transit_heading)
    assert (h.indicator_type, h.transiting, h.aspect, h.natal, h.context) == ("transit_aspect", "sun", "conjunct", "moon", "transit")
    assert one(spark, "Sun Conjunct Ascendant", X.transit_heading).indicator_type == "angle_aspect"
    h = one(spark, "Saturn in the Seventh House", X.transit_heading)
    assert (h.indicator_type, h.house) == ("house_ingress", 7)
    assert one(spark, "just some prose", X.transit_heading) is None


@pytest.mark.parametrize(("head", "kind", "sign"), [("Venus in Gemini", "planet_in_sign", "gemini"), ("Aries Ascendant", "ascendant", "aries"), ("Taurus", "sign_chapter", "taurus"), ("DEPENDABILITY", "sign_section", "leo")])
def test_font_headings(spark, head, kind, sign):
    h = one(spark, head, lambda c: X.font_heading(c, F.lit("leo")))
    assert (h.indicator_type, h.sign) == (kind, sign)


def test_tags(spark):
    text = "Venus square Mars while the Moon is in Gemini; the North Node too"
    assert one(spark, text, lambda c: X.entity_tags(c, V.PLANETS)) == ["mars", "moon", "north node", "venus"]
    assert one(spark, text, lambda c: X.entity_tags(c, V.SIGNS)) == ["gemini"]
    assert one(spark, text, lambda c: X.entity_tags(c, V.ASPECTS)) == ["square"]
    assert one(spark, "nothing here", lambda c: X.entity_tags(c, V.SIGNS)) is None


def test_useful(spark):
    assert one(spark, "this is a sentence of prose that has well over twelve words in it", X.useful)
    assert not one(spark, "AB CD EF GH IJ KL MN OP QR ST UV WX", X.useful)
    assert not one(spark, "Sun Moon Mars", X.useful)


def test_lines_of_text(spark):
    assert one(spark, "a won-\nder\nful day", X.dehyphenate) == "a wonder\nful day"
    assert one(spark, "a won-\nder\nful  day\n", lambda c: X.reflow(F.split(c, "\n"))) == "a wonder ful day"
    assert one(spark, "a\nb\n\n \nc", X.paragraphs) == ["a b", "c"]
    assert one(spark, "xiv", X.is_page_number) and one(spark, " 12 ", X.is_page_number) and not one(spark, "chapter", X.is_page_number)
    assert one(spark, "16 • Sun Signs", X.is_bullet_header) and one(spark, "Sun Signs • 17", X.is_bullet_header)
    assert one(spark, "The Rising Sign", X.heading_candidate) and one(spark, "DEPENDABILITY", X.heading_candidate) and not one(spark, "plain words here", X.heading_candidate)
    assert one(spark, "The Houses and You", X.toc_indicator) == "house_meaning"


def test_citation_and_numbers(spark):
    assert one(spark, "Book", lambda c: X.citation(c, F.lit("Author"), F.lit(1), F.lit(1))) == "Book (Author), p.1"
    assert one(spark, "Book", lambda c: X.citation(c, F.lit(None).cast("string"), F.lit(4), F.lit(5))) == "Book, pp.4-5"
    assert one(spark, "these: [1, 4] fit", X.picked_numbers) == [1, 4]
    assert one(spark, "none", X.picked_numbers) == []


# Examples of the published algorithm.
STEMS = (
    "consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist "
    "consolation consol consolatory consolatori consolidate consolid consolingly consol conspicuously conspicu conspiracy conspiraci "
    "conspirator conspir constable constabl knack knack knackeries knackeri kneaded knead knightly knight knitted knit knives knive "
    "knowledge knowledg generously generous happy happi hopping hop hoping hope cries cri ties tie gas gas gaps gap say say by by cry cri "
    "sky sky dying die agreed agre feed feed rolled roll chart's chart hopefulness hope youth youth probably probabl"
).split()


@pytest.mark.parametrize(("word", "want"), list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, want):
    assert stem(word) == want


def test_lexemes(spark):
    rows = spark.createDataFrame([("houses",), ("the",), (None,), ("",), ("42",), ("'",)], "x string").select(lexeme("x").alias("y")).collect()
    assert [r.y for r in rows] == ["hous", None, None, None, "42", "'"]
