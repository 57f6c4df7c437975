"""The engine's operators as queries over the driver's tables, each with SQL that gives the same rows.

``documents`` are the corpus (chunk = document, heading = first line), ``benchmark`` items the questions, ``embeddings`` the dense
vectors (chunk and question meet by id), and a question's gold documents are those whose text holds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import api
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import evaluation as E
from ..operators import lines as L
from ..operators import reports as R
from ..operators import retrieval as H
from ..operators import structure as ST
from ..operators import windows as TW
from ..sources import store as S
from . import ingest as IN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TAGS = ("the", "of", "and", "der", "die", "que", "les")
TOP_N, DEPTH, SPARSE_K = 6, 12, 64
#: Terms a sparse vector keeps in the reference; what has no SQL uses it, and so do the ``_256`` queries at the end.
SPARSE_TERMS = 256


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# --- SQL fragments ----------------------------------------------------------------------------------------------------------------
TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9'']+')"
STRIP = "regexp_replace({0}, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')"
FOCUSED = f"list_filter({TOK.format('text')}, lambda t: NOT list_contains({quoted(V.FRAME_WORDS)}, t))"
HEAD = "split_part(text, chr(10), 1)"
CHUNKS = f"chunks AS (SELECT doc_id AS chunk_id, {HEAD} AS head, text AS content, lang, source FROM documents)"
POSTS = f"""posts AS (SELECT chunk_id, lexeme, sum(h)::BIGINT AS tf_head, sum(b)::BIGINT AS tf_body FROM (
  SELECT chunk_id, unnest({TOK.format('head')}) AS lexeme, 1 AS h, 0 AS b FROM chunks UNION ALL
  SELECT chunk_id, unnest({TOK.format('content')}), 0, 1 FROM chunks) GROUP BY ALL)"""
QUESTIONS = f"q AS (SELECT item_id AS query_id, text AS question, CASE WHEN len({FOCUSED}) > 0 THEN array_to_string({FOCUSED}, ' ') ELSE text END AS focused FROM benchmark)"


def top_sql(name: str, scored: str, depth: int, digits: int = 9) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank
  FROM (SELECT query_id, chunk_id, round(score, {digits}) AS score FROM ({scored}))) WHERE rank <= {depth})"""


def legs_sql(depth: int, chunk_where: str = "TRUE") -> str:
    fts = f"SELECT t.query_id, p.chunk_id, {H.HEAD_WEIGHT} * sum(tf_head) + {H.BODY_WEIGHT}::DOUBLE * sum(tf_body) AS score FROM posts p JOIN terms t ON p.lexeme = t.lexeme GROUP BY ALL"
    dense = """SELECT x.vec_id AS query_id, y.vec_id AS chunk_id, list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) AS score
  FROM vecs x JOIN q ON q.query_id = x.vec_id CROSS JOIN vecs y WHERE y.vec_id IN (SELECT chunk_id FROM chunks)"""
    sparse = "SELECT a.id AS query_id, b.id AS chunk_id, sum(a.w * b.w) AS score FROM qw a JOIN dw b ON a.term = b.term GROUP BY ALL HAVING sum(a.w * b.w) > 0"
    prune = f"SELECT id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, term) AS r FROM ({{0}}) WHERE w > 0) WHERE r <= {SPARSE_K}"
    weigh = "SELECT t.id, t.term, round(ln(1 + t.tf) * i.idf, 6) AS w FROM {0} t JOIN idf i ON i.term = t.term"
    return f"""WITH all_chunks AS (SELECT doc_id AS chunk_id, {HEAD} AS head, text AS content, lang, source FROM documents),
chunks AS (SELECT * FROM all_chunks WHERE {chunk_where}), {POSTS}, {QUESTIONS},
terms AS (SELECT query_id, unnest(list_distinct({TOK.format('focused')})) AS lexeme FROM q),
vecs AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
dtf AS (SELECT id, term, count(*) AS tf FROM (SELECT chunk_id AS id, unnest({TOK.format('content')}) AS term FROM chunks) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM chunks) + 1)::DOUBLE / (count(DISTINCT id) + 1)) AS idf FROM dtf GROUP BY term),
qtf AS (SELECT id, term, count(*) AS tf FROM (SELECT query_id AS id, unnest({TOK.format('focused')}) AS term FROM q) GROUP BY ALL),
dw AS ({prune.format(weigh.format('dtf'))}), qw AS ({prune.format(weigh.format('qtf'))}),
{top_sql('fts', fts, depth)}, {top_sql('dense', dense, depth)}, {top_sql('sparse', sparse, depth, 6)},
joined AS (SELECT query_id, chunk_id, max(CASE WHEN leg = 'fts' THEN rank END) AS fts_rank, max(CASE WHEN leg = 'dense' THEN rank END) AS dense_rank, max(CASE WHEN leg = 'sparse' THEN rank END) AS sparse_rank,
    max(CASE WHEN leg = 'fts' THEN score END) AS fts_score, max(CASE WHEN leg = 'dense' THEN score END) AS dense_score, max(CASE WHEN leg = 'sparse' THEN score END) AS sparse_score
  FROM (SELECT 'fts' AS leg, * FROM fts UNION ALL SELECT 'dense', * FROM dense UNION ALL SELECT 'sparse', * FROM sparse) GROUP BY ALL),
fused AS (SELECT *, round(coalesce(0.7::DOUBLE / (50 + fts_rank), 0) + coalesce(1.0::DOUBLE / (50 + dense_rank), 0) + coalesce(1.0::DOUBLE / (50 + sparse_rank), 0), 9) AS score FROM joined),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM fused) WHERE rank <= {TOP_N})"""


# --- Spark side of the same -------------------------------------------------------------------------------------------------------
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.substring_index("text", "\n", 1).alias("head"), F.col("text").alias("content"), "lang", "source")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")).join(v, "query_id", "left")


def three_legs(spark: SparkSession, sf: str, depth: int = DEPTH, wanted: dict | None = None, terms: int = SPARSE_K) -> DataFrame:
    """Rows of all legs, fused."""
    return H.fuse_rows(search(spark, sf, terms).ranked(questions(spark, sf), depth, wanted), list(H.WEIGHTS), H.WEIGHTS)


def hybrid(spark: SparkSession, sf: str, wanted: dict | None = None, top_n: int = TOP_N, terms: int = SPARSE_K) -> DataFrame:
    return H.top(three_legs(spark, sf, 2 * top_n, wanted, terms), top_n)


def with_chunks(found: DataFrame, of: DataFrame) -> DataFrame:
    """Results with columns of their chunks: ``top_n`` rows a question, which are sent to where the texts are."""
    return of.join(F.broadcast(found), "chunk_id")


# --- expressions ------------------------------------------------------------------------------------------------------------------
@query(f"SELECT query_id AS item_id, focused FROM (WITH {QUESTIONS} SELECT * FROM q)")
def focus_query(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", X.focus_query("text").alias("focused"))


@query(f"""SELECT item_id, (SELECT string_agg(t, ' ' ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest(w) AS t, unnest(range(len(w))) AS i) WHERE NOT list_contains({quoted(V.DIAGNOSTIC_STOP_WORDS)}, t) AND length(t) > 2 GROUP BY t)) AS terms
FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)""")
def diagnostic_terms(spark, sf):
    t = X.diagnostic_terms("text")
    return read(spark, sf, "benchmark").select("item_id", F.when(F.size(t) > 0, F.array_join(t, " ")).alias("terms"))


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda t: list_contains({quoted(TAGS)}, t)))), ',') AS tags FROM documents""")
def entity_tags(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.coalesce(F.array_join(X.entity_tags("text", TAGS), ","), F.lit("")).alias("tags"))


@query("""SELECT doc_id, len(w) >= 12 AND len(list_filter(w, lambda t: NOT regexp_matches(t, '\\p{Ll}')))::DOUBLE / greatest(len(w), 1) <= 0.5 AS keep
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\f]+'), lambda t: t <> '') AS w FROM documents)""")
def useful_filter(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.useful("text").alias("keep"))


@query("SELECT doc_id, md5(regexp_replace(text, '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g')) AS joined FROM documents")
def dehyphenate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(X.dehyphenate("text")).alias("joined"))


@query(f"SELECT doc_id, md5({STRIP.format('''regexp_replace(regexp_replace(text, '(\\p{L})-\\n', '\\1', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')''')}) AS flat FROM documents")
def reflow(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(X.reflow(F.split("text", "\n"))).alias("flat"))


@query(f"SELECT doc_id, len({TOK.format('text')})::INTEGER AS n_tokens FROM documents")
def token_count(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.n_tokens("text").alias("n_tokens"))


@query("SELECT p_partkey, CASE WHEN p_brand <> '' THEN p_name || ' (' || p_brand || ')' ELSE p_name END || ', ' || CASE WHEN p_size % 3 = 0 THEN 'p.' || p_size ELSE 'pp.' || p_size || '-' || (p_size + p_size % 3) END AS citation FROM part")
def citations(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.citation("p_name", "p_brand", "p_size", F.col("p_size") + F.col("p_size") % 3).alias("citation"))


@query("SELECT event_id, len(list_filter(range(1, 6), lambda i: event_id % i = 0))::INTEGER AS n, list_contains(list_filter(range(1, 6), lambda i: event_id % i = 0), 4) AS has_four FROM events")
def picked_numbers(spark, sf):
    listed = F.array_join(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: F.col("event_id") % i == 0), ", ")
    got = X.picked_numbers(F.concat(F.lit("relevant: ["), listed, F.lit("] as judged")))
    return read(spark, sf, "events").select("event_id", F.size(got).alias("n"), F.array_contains(got, 4).alias("has_four"))


@query("SELECT doc_id, doc_id % 2 = 0 AND length(text) > 300 AS is_long, CASE WHEN length(text) > 300 THEN substr(translate(text, chr(10), ' '), 1, 300) || '…' ELSE translate(text, chr(10), ' ') END AS preview, lang, source, '' AS author FROM documents")
def chunk_report(spark, sf):
    d = read(spark, sf, "documents").withColumn("is_long", (F.col("doc_id") % 2 == 0) & (F.length("text") > 300))
    return R.chunk_report(d, ["doc_id", "lang", "source", "author", "is_long"], "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("is_long", F.col("is_long").cast("boolean"))


# --- lines, sections, windows -----------------------------------------------------------------------------------------------------
LINES = f"ls AS (SELECT doc_id, source, i - 1 AS line_no, {STRIP.format('x[i]')} AS line FROM (SELECT doc_id, source, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM documents)))"
RUNNING = f"""{LINES}, own AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS z FROM ls WHERE line <> ''),
edge AS (SELECT source, line FROM own WHERE a <= 2 UNION ALL SELECT source, line FROM own WHERE z <= 2),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
running AS (SELECT e.source, e.line, count(*) AS n FROM edge e JOIN total t ON t.source = e.source WHERE length(e.line) BETWEEN 3 AND 80
  GROUP BY e.source, e.line, t.pages HAVING count(*) >= 3 AND count(*) >= 0.02 * t.pages)"""
SHARE = 0.02


@query(f"WITH {RUNNING} SELECT source, line, n FROM running")
def running_lines(spark, sf):
    return L.running_lines(read(spark, sf, "documents"), "source", "doc_id", share=SHARE)


@query(f"""WITH {RUNNING} SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS body FROM ls
WHERE line <> '' AND NOT regexp_matches(line, '^[ \\t]*[ivxlcdmIVXLCDM0-9]{{1,6}}[ \\t]*$') AND (source, line) NOT IN (SELECT (source, line) FROM running) GROUP BY doc_id""")
def clean_lines(spark, sf):
    c = L.clean_lines(read(spark, sf, "documents"), "source", "doc_id", share=SHARE)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(body).alias("body"))


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\n[ \\t]*\\n'),
  lambda x: {STRIP.format("regexp_replace(regexp_replace(x, '\\n', ' ', 'g'), '[ \\t]+', ' ', 'g')")}), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, len(p)::INTEGER AS n, md5(array_to_string(p, chr(10))) AS body FROM p""")
def paragraphs(spark, sf):
    p = X.paragraphs("text")
    return read(spark, sf, "documents").select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "\n")).alias("body"))


@query(f"""WITH {LINES}, h AS (SELECT *, (length(line) BETWEEN 3 AND 60)::INTEGER AS is_head FROM ls WHERE line <> ''),
s AS (SELECT *, sum(is_head) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM h)
SELECT doc_id, section_no::INTEGER AS section_no, max(CASE WHEN is_head = 1 THEN line END) AS head, count(*) AS n_lines FROM s GROUP BY ALL""")
def heading_sections(spark, sf):
    s = L.sections(L.lines(read(spark, sf, "documents"), ["doc_id"]).where("line <> ''"), ["doc_id"], ["line_no"], F.length("line").between(3, 60))
    return s.groupBy("doc_id", "section_no").agg(F.first("head", True).alias("head"), F.count("*").alias("n_lines"))


WINDOWS = f"""{LINES}, l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, len({TOK.format('line')}) AS n, line FROM ls WHERE line <> ''),
c AS (SELECT doc_id, list(n ORDER BY i) AS n, list(line ORDER BY i) AS lines FROM l GROUP BY doc_id),
w AS (SELECT doc_id, n, lines, 0 AS k, 1::BIGINT AS s, greatest(1, (SELECT max(j) FROM range(1, len(n) + 1) t(j) WHERE list_sum(n[1:j]) <= 120))::BIGINT AS e FROM c
  UNION ALL SELECT doc_id, n, lines, k + 1, s2, greatest(e + 1, coalesce((SELECT max(j) FROM range(s2, len(n) + 1) t(j) WHERE list_sum(n[s2:j]) <= 120), 0)) FROM (
    SELECT *, greatest(s, (SELECT min(x) FROM range(1, e + 2) t(x) WHERE coalesce(list_sum(n[x:e]), 0) <= 20)) AS s2 FROM w WHERE e < len(n)))"""


@query(f"""WITH RECURSIVE {WINDOWS} SELECT doc_id, k::INTEGER AS window_no, (s - 1)::BIGINT AS first_line, (e - 1)::BIGINT AS last_line,
  md5({STRIP.format("regexp_replace(regexp_replace(array_to_string(lines[s:e], chr(10)), '(\\p{L})-\\n', '\\1', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')")}) AS body FROM w""")
def token_windows(spark, sf):
    x = L.lines(read(spark, sf, "documents"), ["doc_id"]).where("line <> ''")
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1)
    w = TW.token_windows(x, ["doc_id"], "i", page="i", target=120, overlap=20)
    return w.select("doc_id", "window_no", F.col("page_start").alias("first_line"), F.col("page_end").alias("last_line"), F.md5("content").alias("body"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line_no, line FROM ls WHERE line <> ''),
u AS (SELECT *, list_filter(regexp_split_to_array(line, '[ \\t\\r\\n\\f]+'), lambda t: t <> '') AS w FROM s)
SELECT doc_id, line_no::INTEGER AS line_no, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INTEGER AS chunk_index FROM u
WHERE len(w) >= 12 AND len(list_filter(w, lambda t: NOT regexp_matches(t, '\\p{{Ll}}')))::DOUBLE / greatest(len(w), 1) <= 0.5""")
def chunk_index(spark, sf):
    x = L.lines(read(spark, sf, "documents"), ["doc_id"]).where("line <> ''").withColumnRenamed("line", "content")
    return TW.numbered(x, ["doc_id"], ["line_no"]).select("doc_id", "line_no", "chunk_index")


@query("""WITH b AS (SELECT item_id AS start, lead(item_id, 1, 9223372036854775807) OVER (ORDER BY item_id) AS until FROM (SELECT item_id * 20 AS item_id FROM benchmark))
SELECT start, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars FROM documents JOIN b ON doc_id >= start AND doc_id < until GROUP BY start""")
def toc_range_join(spark, sf):
    starts = read(spark, sf, "benchmark").select((F.col("item_id") * 20).alias("start"))
    return L.range_sections(starts, read(spark, sf, "documents"), "start", "doc_id", "start").groupBy("start").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))


@query("""SELECT page_id, count(*) AS n, max(tag) AS last_tag FROM (SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?is)<(title|h1|h2|h3|p|li)(?:\\s[^>]*)?>([^<]*)', 1))) AS tag,
  unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?is)<(title|h1|h2|h3|p|li)(?:\\s[^>]*)?>([^<]*)', 2)) AS line FROM pages)
WHERE regexp_replace(line, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g') <> '' GROUP BY page_id""")
def html_layout(spark, sf):
    tag = F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(v), F.lit(k)) for k, v in {"title": 20.0, "h1": 18.0, "h2": 16.0, "h3": 14.0}.items()])), F.col("size"))
    return S.opening_lines(read(spark, sf, "pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.max(F.coalesce(tag, F.lit("p"))).alias("last_tag"))


# --- retrieval --------------------------------------------------------------------------------------------------------------------
@query(f"WITH {CHUNKS}, {POSTS} SELECT * FROM posts")
def postings(spark, sf):
    return H.postings(chunks(spark, sf))


def _leg(name: str):
    @query(legs_sql(DEPTH) + f" SELECT query_id, chunk_id, rank, score FROM {name}")
    def leg(spark, sf, terms=SPARSE_K):
        return search(spark, sf, terms).leg(name, questions(spark, sf), DEPTH).select("query_id", "chunk_id", "rank", "score")

    QUERIES[f"{name}_leg"], ORACLES[f"{name}_leg"] = QUERIES.pop("leg"), ORACLES.pop("leg")


for _name in ("fts", "dense", "sparse"):
    _leg(_name)


@query()
def fts_leg_english(spark, sf):
    """Stems have no SQL; tested on a fixture."""
    return H.text_legs(questions(spark, sf), chunks(spark, sf), DEPTH, ("fts",), english=True).drop("leg")


@query(legs_sql(DEPTH) + " SELECT id AS chunk_id, count(*) AS terms, round(max(w), 6) AS most FROM dw GROUP BY id")
def sparse_prune(spark, sf, terms=SPARSE_K):
    c = chunks(spark, sf)
    tf = H.body_terms(H.postings(c))
    return H.sparse_vectors(tf, H.idf(tf, c), "chunk_id", terms).groupBy("chunk_id").agg(F.count("*").alias("terms"), F.round(F.max("w"), 6).alias("most"))


@query(legs_sql(DEPTH) + " SELECT b.query_id, b.rank, b.chunk_id, b.score, d.lang, d.source, md5(d.text) AS content FROM best b JOIN documents d ON d.doc_id = b.chunk_id")
def hybrid_search(spark, sf, terms=SPARSE_K):
    found = hybrid(spark, sf, terms=terms).select("query_id", "rank", "chunk_id", "score")
    return with_chunks(found, chunks(spark, sf)).select(*found.columns, "lang", "source", F.md5("content").alias("content"))


@query(legs_sql(DEPTH, "lang = 'en'") + " SELECT query_id, rank, chunk_id, score FROM best")
def rrf_filtered(spark, sf, terms=SPARSE_K):
    return hybrid(spark, sf, {"lang": "en"}, terms=terms).select("query_id", "rank", "chunk_id", "score")


ABLATION = legs_sql(40) + """, weights(leg, wf, wd, ws) AS (VALUES ('fused', 0.7::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('dense', 0, 1, 0), ('fts', 1, 0, 0), ('sparse', 0, 0, 1)),
ab AS (SELECT * FROM (SELECT leg, query_id, chunk_id, score, row_number() OVER (PARTITION BY leg, query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM (
  SELECT leg, query_id, chunk_id, round(coalesce(wf / (50 + fts_rank), 0) + coalesce(wd / (50 + dense_rank), 0) + coalesce(ws / (50 + sparse_rank), 0), 9) AS score FROM joined CROSS JOIN weights) WHERE score > 0) WHERE rank <= 20),
gold AS (SELECT b.item_id AS query_id, d.source AS section, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


@query(ABLATION + " SELECT leg, query_id, chunk_id, rank, score FROM ab")
def rrf_ablation(spark, sf, terms=SPARSE_K):
    return H.ablate(three_legs(spark, sf, 40, terms=terms), 20)


@query(legs_sql(DEPTH) + " SELECT query_id, chunk_id, rank, fts_rank::DOUBLE AS fts_rank, dense_rank::DOUBLE AS dense_rank, sparse_rank::DOUBLE AS sparse_rank, fts_score, dense_score, sparse_score, score FROM best")
def leg_diagnostics(spark, sf, terms=SPARSE_K):
    return hybrid(spark, sf, terms=terms).select("query_id", "chunk_id", "rank", *[F.col(f"{n}_rank").cast("double").alias(f"{n}_rank") for n in H.WEIGHTS], "fts_score", "dense_score", "sparse_score", "score")


_TERMS = f"""list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda t: NOT list_contains({quoted(V.DIAGNOSTIC_STOP_WORDS)}, t) AND length(t) > 2)"""


@query(legs_sql(DEPTH).replace(f"r <= {SPARSE_K})", f"r <= {SPARSE_TERMS})") + f""", t AS (SELECT query_id, {_TERMS} AS t FROM (SELECT query_id, regexp_extract_all(lower(question), '[a-z]+') AS w FROM q)),
x AS (SELECT b.query_id, b.chunk_id, b.rank, t.t, lower(coalesce(c.head, '')) AS head, lower(coalesce(c.content, '')) AS content FROM best b JOIN t ON t.query_id = b.query_id JOIN chunks c ON c.chunk_id = b.chunk_id)
SELECT query_id, chunk_id, rank, array_to_string(list_filter(t, lambda y: contains(head, y)), ' ') AS head_terms, array_to_string(list_filter(t, lambda y: contains(content, y) AND NOT contains(head, y)), ' ') AS body_terms FROM x""")
def explain_terms(spark, sf):
    r = with_chunks(hybrid(spark, sf, terms=SPARSE_TERMS), chunks(spark, sf)).join(questions(spark, sf).select("query_id", "question"), "query_id")
    return H.explain(r).select("query_id", "chunk_id", "rank", "head_terms", "body_terms")


# --- evaluation -------------------------------------------------------------------------------------------------------------------
def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a question's text."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("section"), "text")
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))
    return E.holders(d, q, "chunk_id", "text", "query_id", "phrase", keep=("section",)).select("query_id", "section", "chunk_id")


@query("SELECT b.item_id AS query_id, d.source AS section, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gold_resolve(spark, sf):
    return gold(spark, sf)


CASES = ABLATION + """, legs AS (SELECT DISTINCT leg FROM weights),
hits AS (SELECT l.leg, g.query_id, g.section, g.chunk_id, a.rank FROM gold g CROSS JOIN legs l LEFT JOIN ab a ON a.leg = l.leg AND a.query_id = g.query_id AND a.chunk_id = g.chunk_id),
sec AS (SELECT leg, query_id, section, min(rank) AS best FROM hits GROUP BY ALL),
rec AS (SELECT leg, query_id, """ + ", ".join(f"avg(coalesce(best <= {k}, false)::INTEGER) AS recall_at_{k}" for k in E.DEPTHS) + """, coalesce(1.0::DOUBLE / min(best), 0) AS mrr FROM sec GROUP BY ALL),
dc AS (SELECT leg, query_id, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(10, count(*)) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM hits GROUP BY ALL),
cases AS (SELECT r.*, round(d.ndcg, 9) AS ndcg FROM rec r JOIN dc d USING (leg, query_id))"""
METRICS = [*(f"recall_at_{k}" for k in E.DEPTHS), "mrr", "ndcg"]


def _cases(spark: SparkSession, sf: str, terms: int = SPARSE_K) -> DataFrame:
    return E.case_metrics(rrf_ablation(spark, sf, terms), gold(spark, sf), list(H.ABLATIONS))


@query(CASES + " SELECT leg, query_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM cases")
def metrics_by_case(spark, sf, terms=SPARSE_K):
    return _cases(spark, sf, terms).select("leg", "query_id", *[F.round(m, 6).alias(m) for m in METRICS])


@query(CASES + " SELECT leg, count(*) AS cases, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + " FROM cases GROUP BY leg")
def metrics_by_leg(spark, sf, terms=SPARSE_K):
    return E.means(_cases(spark, sf, terms), ["leg"])


@query(CASES + " SELECT query_id % 4 AS class, count(*) AS cases, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + " FROM cases WHERE leg = 'fused' GROUP BY ALL")
def metrics_by_class(spark, sf, terms=SPARSE_K):
    return E.means(_cases(spark, sf, terms).where("leg = 'fused'").withColumn("class", F.col("query_id") % 4), ["class"])


@query(CASES + " SELECT query_id, round(mrr, 6) AS mrr FROM cases WHERE leg = 'fused' ORDER BY mrr, query_id LIMIT 5")
def worst_cases(spark, sf, terms=SPARSE_K):
    return _cases(spark, sf, terms).where("leg = 'fused'").select("query_id", F.round("mrr", 6).alias("mrr")).orderBy("mrr", "query_id").limit(5)


@query(legs_sql(DEPTH) + """, g AS (SELECT b.item_id AS query_id, min(d.source) AS book FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL)
SELECT q.query_id, coalesce(bool_or(b.rank = 1 AND d.source = g.book), false) AS book_first, coalesce(bool_or(d.source = g.book), false) AS book_any, max(b.score) AS most, max(b.score) < 0.04 AS out_of_scope
FROM q JOIN best b ON b.query_id = q.query_id JOIN documents d ON d.doc_id = b.chunk_id LEFT JOIN g ON g.query_id = q.query_id GROUP BY q.query_id""")
def routing_eval(spark, sf, terms=SPARSE_K):
    book = gold(spark, sf).groupBy("query_id").agg(F.min("section").alias("book"))
    r = with_chunks(hybrid(spark, sf, terms=terms), chunks(spark, sf).select("chunk_id", "source")).join(book, "query_id", "left")
    return r.groupBy("query_id").agg(F.coalesce(F.bool_or((F.col("rank") == 1) & (F.col("source") == F.col("book"))), F.lit(False)).alias("book_first"), F.coalesce(F.bool_or(F.col("source") == F.col("book")), F.lit(False)).alias("book_any"), F.max("score").alias("most"), (F.max("score") < 0.04).alias("out_of_scope"))


ROUTED = """, g AS (SELECT b.item_id AS query_id, min(d.source) AS book FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL),
cs AS (SELECT q.query_id, q.query_id % 4 <> 3 AS in_scope, g.book, list_filter(string_split(q.focused, ' '), lambda t: length(t) > 9)[1:2] AS terms FROM q LEFT JOIN g ON g.query_id = q.query_id),
rt AS (SELECT c.query_id, any_value(c.in_scope) AS in_scope, any_value(c.book) AS book, coalesce(bool_or(b.rank = 1 AND d.source = c.book), false) AS book_first, coalesce(bool_or(d.source = c.book), false) AS book_any,
  any_value(c.terms) AS terms, coalesce(string_agg(lower(d.text), ' ' ORDER BY b.rank), '') AS txt, coalesce(max(b.score), 0) AS most
  FROM cs c LEFT JOIN best b ON b.query_id = c.query_id LEFT JOIN documents d ON d.doc_id = b.chunk_id GROUP BY c.query_id),
rc AS (SELECT query_id, in_scope, book, book_first, book_any, len(terms) = 0 OR len(list_filter(terms, lambda t: contains(txt, lower(t)))) > 0 AS term_hit, most FROM rt),
ru AS (SELECT *, CASE WHEN in_scope THEN (book IS NULL OR book_any) AND term_hit ELSE most < 0.04 END AS passed FROM rc)"""


def _routing(spark: SparkSession, sf: str, terms: int) -> DataFrame:
    book = gold(spark, sf).groupBy("query_id").agg(F.min("section").alias("book"))
    long = F.slice(F.filter(F.split(X.focus_query("question"), " "), lambda t: F.length(t) > 9), 1, 2)
    cases = questions(spark, sf).select("query_id", (F.col("query_id") % 4 != 3).alias("in_scope"), long.alias("terms")).join(book, "query_id", "left")
    found = with_chunks(hybrid(spark, sf, terms=terms), chunks(spark, sf).select("chunk_id", F.col("source").alias("book"), "content"))
    return E.routing(found, cases)


@query(legs_sql(DEPTH) + ROUTED + " SELECT query_id, in_scope, book, book_first, book_any, term_hit, most, passed FROM ru")
def routing_cases(spark, sf, terms=SPARSE_K):
    return _routing(spark, sf, terms)


@query(legs_sql(DEPTH) + ROUTED + """ SELECT count(*) AS cases, round(100 * avg(CASE WHEN in_scope AND book IS NOT NULL THEN book_first::INTEGER END)) AS book_first, round(100 * avg(CASE WHEN in_scope AND book IS NOT NULL THEN book_any::INTEGER END)) AS book_any,
round(100 * avg(CASE WHEN in_scope THEN term_hit::INTEGER END)) AS term_hit, round(100 * avg(CASE WHEN NOT in_scope THEN passed::INTEGER END)) AS rejected, round(100 * avg(passed::INTEGER)) AS passed FROM ru""")
def routing_summary(spark, sf, terms=SPARSE_K):
    return E.routing_summary(_routing(spark, sf, terms))


@query(f"""WITH g AS (SELECT DISTINCT b.item_id AS query_id, d.source, {HEAD} AS head FROM (SELECT item_id, text AS t FROM benchmark) b JOIN documents d ON contains(d.text, b.t)), {CHUNKS}
SELECT g.query_id, g.source, md5(g.head) AS head, c.chunk_id FROM g JOIN chunks c ON c.source = g.source AND c.head = g.head""")
def gold_by_section(spark, sf):
    """Labels name a book and a section; all chunks of that section are gold. A label without a chunk fails."""
    c = chunks(spark, sf)
    labels = gold(spark, sf).join(c.select("chunk_id", "source", "head"), "chunk_id").select("query_id", "source", "head").distinct()
    return E.resolve_gold(labels, c, ["source", "head"]).select("query_id", "source", F.md5("head").alias("head"), "chunk_id")


# --- reports, store ---------------------------------------------------------------------------------------------------------------
@query("""SELECT lang, count(*) AS n, min(v) AS least, (list_sort(list(v)))[(count(*) // 2) + 1] AS middle, max(v) AS most, floor(sum(v) / count(*))::BIGINT AS mean,
""" + ", ".join(f"(list_sort(list(v)))[floor({p}::DOUBLE * (count(*) - 1))::BIGINT + 1] AS p{int(p * 100)}" for p in (0.5, 0.9, 0.95)) + " FROM (SELECT lang, n_chars AS v FROM documents) GROUP BY lang")
def chunk_stats(spark, sf):
    return R.size_stats(read(spark, sf, "documents"), "lang", "n_chars")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 25")
def sample_chunks(spark, sf):
    return R.sample(read(spark, sf, "documents").select("doc_id", "lang"), 25, "doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e')")
def grep_chunks(spark, sf):
    return read(spark, sf, "documents").where(F.col("text").rlike("(?i)licen[sc]e")).select("doc_id")


@query("SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE source END AS source FROM documents UNION ALL SELECT -1 - doc_id, lang, 'new' FROM documents WHERE doc_id % 100 = 0")
def upsert_documents(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "source")
    new = d.where("doc_id % 10 = 0").withColumn("source", F.lit("new"))
    return S.upsert(d, new.unionByName(new.where("doc_id % 100 = 0").withColumn("doc_id", -1 - F.col("doc_id"))), "doc_id")


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4 OR role = 'system'""")
def thread_history(spark, sf):
    c = read(spark, sf, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return c.where("r <= 4 OR role = 'system'").select("conv_id", "turn", "role", "text")


@query(legs_sql(DEPTH) + " SELECT query_id, md5(string_agg('[' || rank || '] ' || source || ', p.' || chunk_id || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS sources FROM best b JOIN documents d ON d.doc_id = b.chunk_id GROUP BY query_id")
def prompt_sources(spark, sf, terms=SPARSE_K):
    r = with_chunks(hybrid(spark, sf, terms=terms), chunks(spark, sf))
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), X.citation("source", F.lit(None).cast("string"), "chunk_id", "chunk_id"), F.lit("\n"), "content")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n\n")
    return r.groupBy("query_id").agg(F.md5(joined).alias("sources"))


@query("SELECT f.indicator, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'house') THEN 'house_meaning' WHEN contains(lower(text), 'ascendant') OR contains(lower(text), 'rising') THEN 'ascendant' WHEN contains(lower(text), 'aspect') THEN 'aspect_meaning' WHEN contains(lower(text), 'sign') OR contains(lower(text), 'zodiac') OR contains(lower(text), 'decanate') THEN 'sign_meaning' WHEN contains(lower(text), 'planet') OR contains(lower(text), 'ruler') OR contains(lower(text), 'sphere') THEN 'planet_meaning' ELSE 'section' END AS indicator FROM documents) f GROUP BY ALL")
def toc_indicator(spark, sf):
    return read(spark, sf, "documents").select(X.toc_indicator("text").alias("indicator")).groupBy("indicator").agg(F.count("*").alias("n"))


@query(f"""WITH f AS ({ORACLES["toc_indicator"]}) SELECT indicator, n, row_number() OVER (ORDER BY n DESC, indicator)::INTEGER AS place, (SELECT coalesce(sum(n), 0) FROM f WHERE indicator = 'section')::BIGINT AS untyped FROM f""")
def indicator_counts(spark, sf):
    return R.ordered_counts(read(spark, sf, "documents").select(X.toc_indicator("text").alias("indicator")), "indicator", "section")


@query(f"""WITH st AS ({ORACLES["chunk_stats"]}), sm AS (SELECT lang, md5(string_agg(substr(text, 1, 500), chr(1) ORDER BY r)) AS samples FROM (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e')) WHERE r <= 3 GROUP BY lang)
SELECT st.*, sm.samples FROM st LEFT JOIN sm ON sm.lang = st.lang""")
def chunk_inspector(spark, sf):
    got = R.inspect_chunks(read(spark, sf, "documents"), "lang", "doc_id", "text", "n_chars", "(?i)licen[sc]e")
    return got.withColumn("samples", F.md5(F.array_join("samples", "\x01")))


# --- structure of the corpus ------------------------------------------------------------------------------------------------------
_TAGS = "(?is)<(title|h1|h2|h3|p|li)(?:\\s[^>]*)?>([^<]*)"
_BODY = "regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"
HTML = f"""html AS (SELECT page_id, i, CASE tag WHEN 'title' THEN 20.0 WHEN 'h1' THEN 18.0 WHEN 'h2' THEN 16.0 WHEN 'h3' THEN 14.0 ELSE 10.0 END::DOUBLE AS size, line FROM (
  SELECT page_id, i, lower(t[i]) AS tag, {STRIP.format('l[i]')} AS line FROM (SELECT page_id, t, l, unnest(range(1, len(t) + 1)) AS i FROM (
    SELECT page_id, regexp_extract_all({_BODY}, '{_TAGS}', 1) AS t, regexp_extract_all({_BODY}, '{_TAGS}', 2) AS l FROM pages))) WHERE line <> '')"""


@query(f"""WITH {HTML}, c AS (SELECT page_id, size, sum(length(line))::BIGINT AS chars FROM html GROUP BY ALL),
b AS (SELECT *, first_value(size) OVER (PARTITION BY page_id ORDER BY chars DESC, size) AS body FROM c),
s AS (SELECT page_id, size, string_agg(substr(line, 1, 60), '|' ORDER BY i) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY page_id, size ORDER BY i) AS r FROM html) WHERE r <= 3 GROUP BY ALL)
SELECT page_id, size, chars, size > body + 0.4 AS is_heading, samples FROM b JOIN s USING (page_id, size) WHERE chars >= 30""")
def size_histogram(spark, sf):
    h = ST.size_histogram(S.opening_lines(read(spark, sf, "pages")), ["page_id"], ["line_no"])
    return h.select("page_id", "size", "chars", "is_heading", F.array_join("samples", "|").alias("samples"))


_TEXT = f"regexp_replace(coalesce(html, ''), '{S.HIDDEN}', '', 'g')"
for _pattern, _mark in ((S.BLOCK, "chr(1) || '\\1' || chr(2)"), (S.BREAK, "chr(3)"), (S.TAG, "''")):
    _TEXT = f"regexp_replace({_TEXT}, '{_pattern}', {_mark}, 'g')"
PAGE_LINES = f"""blocks AS (SELECT page_id, i, x[i] AS b FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, string_split(chr(2) || {_TEXT}, chr(1)) AS x FROM pages))),
parts AS (SELECT page_id, i, lower(split_part(b, chr(2), 1)) AS tag, string_split(split_part(b, chr(2), 2), chr(3)) AS y FROM blocks),
html AS (SELECT * FROM (SELECT page_id, i * 1000000 + j AS i, CASE tag {' '.join(f"WHEN '{t}' THEN {n}" for t, n in S.HEADING_SIZES.items())} ELSE {S.BODY_SIZE} END::DOUBLE AS size, {STRIP.format('y[j]')} AS line
  FROM (SELECT *, unnest(range(1, len(y) + 1)) AS j FROM parts)) WHERE line <> '')"""


@query(f"WITH {PAGE_LINES} SELECT page_id, count(*) AS n, sum(length(line))::BIGINT AS chars, max(size) AS most, md5(string_agg(line, chr(10) ORDER BY i)) AS body FROM html GROUP BY page_id")
def html_layout_whole(spark, sf):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return S.html_lines(read(spark, sf, "pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.max("size").alias("most"), F.md5(body).alias("body"))


@query(ORACLES["size_histogram"].replace(f"WITH {HTML}", f"WITH {PAGE_LINES}"))
def size_histogram_whole(spark, sf):
    h = ST.size_histogram(S.html_lines(read(spark, sf, "pages")), ["page_id"], ["line_no"])
    return h.select("page_id", "size", "chars", "is_heading", F.array_join("samples", "|").alias("samples"))


@query(f"""WITH {PAGE_LINES}, k AS (SELECT page_id, size, count(*) AS n FROM html GROUP BY ALL),
m AS (SELECT page_id, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, size) AS r FROM k) WHERE r = 1),
h AS (SELECT html.*, size >= body + 1.5 AND length(line) >= 3 AND len(regexp_split_to_array(line, '[ \\t\\r\\n\\f\\x0B]+')) <= 12 AS is_head FROM html JOIN m USING (page_id)
  WHERE NOT regexp_matches(line, '^[0-9]+[ \\t]*[•·]') AND NOT regexp_matches(line, '[•·][ \\t]*[0-9]+$')),
s AS (SELECT *, sum(is_head::INTEGER) OVER (PARTITION BY page_id ORDER BY i) AS section_no FROM h)
SELECT page_id, section_no::INTEGER AS section_no, max(CASE WHEN is_head THEN line END) AS head, count(*) AS n_lines, max(size) AS size FROM s GROUP BY page_id, section_no""")
def font_sections(spark, sf):
    s = L.font_sections(S.html_lines(read(spark, sf, "pages")), ["page_id"], ["line_no"])
    return s.groupBy("page_id", "section_no").agg(F.first("head", True).alias("head"), F.count("*").alias("n_lines"), F.max("size").alias("size"))


SCANNED = "^[A-Z][a-z]+ [a-z]+ [a-z]+"


@query(f"""WITH {LINES}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM ls WHERE regexp_matches(line, '{SCANNED}'))
SELECT doc_id, count(*) AS n, string_agg(substr(line, 1, 50), '|' ORDER BY r) FILTER (WHERE r <= 8) AS samples FROM h GROUP BY doc_id""")
def heading_scan(spark, sf):
    lines = L.lines(read(spark, sf, "documents"), ["doc_id"])
    return ST.heading_scan(lines, ["doc_id"], ["line_no"], pattern=SCANNED).select("doc_id", "n", F.array_join("samples", "|").alias("samples"))


@query(f"""WITH {LINES} SELECT doc_id, count(*) AS n FROM ls WHERE regexp_matches(line, '^(Chapter|CHAPTER|Part|PART) ') OR regexp_matches(line, '^[IVXLC]+\\. ')
  OR (regexp_matches(line, '^(\\p{{Lu}}[^ ]*)( \\p{{Lu}}[^ ]*)*$') AND len(regexp_split_to_array(line, ' +')) BETWEEN 2 AND 6)
  OR (upper(line) = line AND regexp_matches(line, '\\p{{Lu}}') AND length(line) BETWEEN 3 AND 40) GROUP BY doc_id""")
def heading_candidates(spark, sf):
    return L.lines(read(spark, sf, "documents"), ["doc_id"]).where(X.heading_candidate("line")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, h AS (SELECT *, sum((length(line) BETWEEN 3 AND 60)::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM ls),
s AS (SELECT doc_id, k, sum(len({TOK.format('line')}))::BIGINT AS n FROM h WHERE k > 0 GROUP BY ALL)
SELECT doc_id, k::INTEGER AS section_no, n AS n_tokens FROM (SELECT *, max(k) OVER (PARTITION BY doc_id) AS last FROM s) WHERE k < last AND n > 0""")
def section_sizes(spark, sf):
    return ST.section_sizes(L.lines(read(spark, sf, "documents"), ["doc_id"]), ["doc_id"], ["line_no"], F.length("line").between(3, 60))


@query(f"""SELECT lang, count(*) AS n, min(v) AS least, (list_sort(list(v)))[(count(*) // 2) + 1] AS middle, max(v) AS most, floor(sum(v) / count(*))::BIGINT AS mean,
""" + ", ".join(f"(list_sort(list(v)))[floor({p}::DOUBLE * (count(*) - 1))::BIGINT + 1] AS p{int(p * 100)}" for p in (0.5, 0.9, 0.95)) + f"""
FROM (SELECT lang, len({TOK.format('p')}) AS v FROM (SELECT lang, unnest(regexp_split_to_array(coalesce(text, ''), '\n[ \t\r\n\f]*\n')) AS p FROM documents)) WHERE v > 0 GROUP BY lang""")
def paragraph_stats(spark, sf):
    return R.size_stats(ST.paragraph_sizes(read(spark, sf, "documents"), ["lang"]), "lang", "n_tokens")


@query()
def sign_sections(spark, sf):
    s = L.sign_sections(S.html_lines(read(spark, sf, "pages")), ["page_id"], ["line_no"])
    return s.select("page_id", "line_no", "line", "section_no", "head", F.col("meta.indicator_type").alias("indicator_type"))


# --- the interface ----------------------------------------------------------------------------------------------------------------
def search(spark: SparkSession, sf: str, terms: int = SPARSE_K) -> api.HybridSearch:
    """Each document is a chunk and a book of its own: title = source, author = language, page = id."""
    c = chunks(spark, sf).select("*", F.col("chunk_id").alias("document_id"), F.col("chunk_id").alias("page_start"), F.col("chunk_id").alias("page_end"))
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return api.HybridSearch(c, v, c.select("document_id", F.col("source").alias("title"), F.col("lang").alias("author")), api.Settings(sparse_terms=terms, english=False))


@query(legs_sql(40) + f""", found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM fused)
SELECT f.query_id, f.rank, f.chunk_id, round(f.score, 4) AS score, f.rank <= {TOP_N} AS selected, d.source || CASE WHEN d.lang <> '' THEN ' (' || d.lang || ')' ELSE '' END || ', p.' || f.chunk_id AS citation
FROM found f JOIN documents d ON d.doc_id = f.chunk_id WHERE f.rank <= 20""")
def inspect_candidates(spark, sf, terms=SPARSE_K):
    return search(spark, sf, terms).inspect(questions(spark, sf)).select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"), "selected", "citation")


@query(legs_sql(DEPTH) + """, j AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT b.query_id, sum(coalesce(j.quality, 0)) / 6::DOUBLE AS precision FROM best b LEFT JOIN j ON j.doc_id = b.chunk_id GROUP BY b.query_id""")
def judged_precision(spark, sf, terms=SPARSE_K):
    judged = read(spark, sf, "labels").groupBy(F.col("doc_id").alias("chunk_id")).agg(F.max("quality").alias("relevant"))
    return ST.judged_precision(hybrid(spark, sf, terms=terms), judged, TOP_N)


# --- whole sparse vectors ---------------------------------------------------------------------------------------------------------
def _whole(name: str):
    """The query at the reference's ``SPARSE_TERMS``; the one of plain name keeps the ``SPARSE_K`` of its SQL."""
    f, pruned = QUERIES[name], f"WHERE r <= {SPARSE_K})"
    QUERIES[f"{name}_256"] = lambda spark, sf: f(spark, sf, terms=SPARSE_TERMS)
    assert ORACLES[name].count(pruned) == 2
    ORACLES[f"{name}_256"] = ORACLES[name].replace(pruned, f"WHERE r <= {SPARSE_TERMS})")


for _name in ("sparse_leg", "sparse_prune", "hybrid_search", "rrf_filtered", "rrf_ablation", "leg_diagnostics", "metrics_by_case", "metrics_by_leg", "metrics_by_class", "worst_cases", "routing_eval", "prompt_sources", "inspect_candidates", "judged_precision"):
    _whole(_name)


@query(ORACLES["inspect_candidates"].replace("AS citation\n", "AS citation, md5(CASE WHEN f.rank <= 6 THEN d.text WHEN length(d.text) > 160 THEN substr(translate(d.text, chr(10), ' '), 1, 160) || '…' ELSE translate(d.text, chr(10), ' ') END) AS shown\n"))
def retrieval_inspector(spark, sf, terms=SPARSE_K):
    got = R.inspect_results(search(spark, sf, terms).inspect(questions(spark, sf)))
    return got.select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"), "selected", "citation", F.md5("shown").alias("shown"))


@query(ORACLES["explain_terms"].replace("array_to_string(list_filter(t, lambda y: contains(head, y)), ' ') AS head_terms", "fts_rank::DOUBLE AS fts_rank, dense_rank::DOUBLE AS dense_rank, sparse_rank::DOUBLE AS sparse_rank, score, preview, array_to_string(list_filter(t, lambda y: contains(head, y)), ' ') AS head_terms").replace("SELECT b.query_id, b.chunk_id, b.rank, t.t,", "SELECT b.query_id, b.chunk_id, b.rank, t.t, b.fts_rank, b.dense_rank, b.sparse_rank, b.score, CASE WHEN length(c.content) > 260 THEN substr(translate(c.content, chr(10), ' '), 1, 260) || '…' ELSE translate(c.content, chr(10), ' ') END AS preview,"))
def diagnostic_bench(spark, sf):
    """Per question and result: each leg's rank, the fused score, the terms found in heading and body, a preview."""
    r = with_chunks(hybrid(spark, sf, terms=SPARSE_TERMS), chunks(spark, sf)).join(questions(spark, sf).select("query_id", "question"), "query_id")
    ranks = [F.col(f"{n}_rank").cast("double").alias(f"{n}_rank") for n in H.WEIGHTS]
    return H.explain(r).select("query_id", "chunk_id", "rank", *ranks, "score", X.preview("content", 260).alias("preview"), "head_terms", "body_terms")


# --- ingestion --------------------------------------------------------------------------------------------------------------------
_SECTIONED = f"""{LINES}, k AS (SELECT doc_id, line_no, line, doc_id % 3 AS kind FROM ls WHERE line <> '' AND NOT regexp_matches(line, '^[ \\t]*[ivxlcdmIVXLCDM0-9]{{1,6}}[ \\t]*$') AND doc_id % 3 < 2),
hd AS (SELECT *, kind = 1 AND length(line) BETWEEN 3 AND 60 AS is_head FROM k),
se AS (SELECT *, sum(is_head::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS sec FROM hd),
sh AS (SELECT doc_id, sec, max(CASE WHEN is_head THEN line END) AS head FROM se GROUP BY ALL),
l AS (SELECT doc_id, sec, row_number() OVER (PARTITION BY doc_id, sec ORDER BY line_no) AS i, len({TOK.format('line')}) AS n, line FROM se WHERE NOT is_head),
c AS (SELECT doc_id, sec, list(n ORDER BY i) AS n, list(line ORDER BY i) AS lines FROM l GROUP BY ALL),
w AS (SELECT doc_id, sec, n, lines, 0 AS k, 1::BIGINT AS s, greatest(1, (SELECT max(j) FROM range(1, len(n) + 1) t(j) WHERE list_sum(n[1:j]) <= 120))::BIGINT AS e FROM c
  UNION ALL SELECT doc_id, sec, n, lines, k + 1, s2, greatest(e + 1, coalesce((SELECT max(j) FROM range(s2, len(n) + 1) t(j) WHERE list_sum(n[s2:j]) <= 120), 0)) FROM (
    SELECT *, greatest(s, (SELECT min(x) FROM range(1, e + 2) t(x) WHERE coalesce(list_sum(n[x:e]), 0) <= 20)) AS s2 FROM w WHERE e < len(n))),
b AS (SELECT w.doc_id, w.sec, w.k, sh.head, CASE WHEN sh.head IS NOT NULL THEN sh.head || chr(10) || chr(10) ELSE '' END || {STRIP.format("regexp_replace(regexp_replace(array_to_string(lines[s:e], chr(10)), '(\\p{L})-\\n', '\\1', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')")} AS content FROM w JOIN sh ON sh.doc_id = w.doc_id AND sh.sec = w.sec),
u AS (SELECT *, list_filter(regexp_split_to_array(content, '[ \\t\\r\\n\\f]+'), lambda t: t <> '') AS x FROM b)"""


@query(f"""WITH RECURSIVE {_SECTIONED} SELECT 'd' || doc_id AS slug, (row_number() OVER (PARTITION BY doc_id ORDER BY sec, k) - 1)::INTEGER AS chunk_index, head AS section, len({TOK.format('content')})::INTEGER AS token_count, md5(content) AS content
FROM u WHERE len(x) >= 12 AND len(list_filter(x, lambda t: NOT regexp_matches(t, '\\p{{Ll}}')))::DOUBLE / greatest(len(x), 1) <= 0.5""")
def ingest_chunks(spark, sf):
    """Each document is a source of one page: a third are windows, a third sections at short lines, a third not in the registry."""
    d = read(spark, sf, "documents")
    slug = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("slug")
    strategy = F.when(F.col("doc_id") % 3 == 0, "token_windows").otherwise("line_sections").alias("strategy")
    sources = d.where("doc_id % 3 < 2").select(slug, strategy, F.lit(120).alias("target"), F.lit(20).alias("overlap"))
    short = lambda clean: IN.line_sections(clean, F.length("line").between(3, 60))
    got = IN.chunk_sources(d.select(slug, F.lit(1).alias("page"), "text"), sources, strategies={"line_sections": short})
    return got.select("slug", "chunk_index", "section", "token_count", F.md5("content").alias("content"))


@query(f"""WITH b AS (SELECT source, doc_id AS start, lead(doc_id, 1, 9223372036854775807) OVER (PARTITION BY source ORDER BY doc_id) AS until FROM documents WHERE doc_id % 50 = 7)
SELECT d.doc_id, d.source, b.start FROM documents d JOIN b ON d.source = b.source AND d.doc_id >= b.start AND d.doc_id < b.until""")
def toc_sections_by_source(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source")
    return L.range_sections(d.where("doc_id % 50 = 7").select("source", F.col("doc_id").alias("start")), d, "start", "doc_id", "start", by=["source"])
