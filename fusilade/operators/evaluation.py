"""Rank-quality metrics over all cases and legs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import corpus as C

DEPTHS = (1, 3, 6, 10)


def case_metrics(ranking: DataFrame, gold: DataFrame, legs: list[str], ks=DEPTHS, ndcg_k: int = 10) -> DataFrame:
    """Per leg and query of ``gold`` (query_id, section, chunk_id): recall_at_k, mrr, ndcg; 0 where nothing is found.

    Recall is the share of gold sections with a chunk in the top k; nDCG is binary, its ideal cut at min(k, number of gold chunks). The
    ranking is read once: gold chunks take their rank, then a section's and a query's numbers are sums. A chunk of several sections counts
    for each of them in recall and once in nDCG."""
    cases = gold.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set("section")).alias("sections"))
    all_legs = cases.withColumn("leg", F.explode(F.array(*map(F.lit, legs))))
    best = ranking.groupBy("leg", "query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    hit = all_legs.join(best, ["leg", "query_id", "chunk_id"], "left").select("leg", "query_id", "rank", F.posexplode("sections").alias("nth", "section"))
    first = (F.col("nth") == 0).cast("double")
    gain = F.when(F.col("rank") <= ndcg_k, first / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per_section = hit.groupBy("leg", "query_id", "section").agg(F.min("rank").alias("best"), F.sum(gain).alias("dcg"), F.sum(first).alias("n"))
    found = [F.avg(F.coalesce(F.col("best") <= k, F.lit(False)).cast("double")).alias(f"recall_at_{k}") for k in ks]
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(ndcg_k), F.sum("n").cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    mrr = F.coalesce(1.0 / F.min("best"), F.lit(0.0)).alias("mrr")
    return per_section.groupBy("leg", "query_id").agg(*found, mrr, F.round(F.sum("dcg") / ideal, 9).alias("ndcg"))


def means(cases: DataFrame, by: list[str]) -> DataFrame:
    names = [c for c in cases.columns if c.startswith("recall_at_") or c in ("mrr", "ndcg")]
    return cases.groupBy(*by).agg(F.count("*").alias("cases"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names])


def require_gold(cases: DataFrame, gold: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Gold rows of all cases; fails when the data is read if a case has none."""
    joined = cases.join(gold, on or ["query_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no gold for "), F.col("query_id").cast("string"))).cast(gold.schema["chunk_id"].dataType)
    return joined.withColumn("chunk_id", F.when(F.col("chunk_id").isNull(), missing).otherwise(F.col("chunk_id")))


def holders(texts: DataFrame, phrases: DataFrame, key: str, text: str, phrase_key: str, phrase: str, most: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, phrase_key, keep ...) of the texts that hold a phrase, a row for each text and phrase.

    A phrase's inner words stand as words in every text that holds it, so texts and phrases meet by the first ``most`` of them in a row; the
    phrase itself is then looked for. Phrases with fewer inner words meet by what they have; those with none are looked for in all texts.
    One pass over the texts, which are dealt out by key; the driver holds all phrases, which are collected when this is called."""
    said = phrases.where(F.col(phrase).isNotNull()).select(F.col(phrase_key).alias("k"), F.col(phrase).alias("p"), X.tokens(phrase).alias("w")).toArrow()
    own = [(p, w[1 : 1 + max(0, min(most, len(w) - 2))]) for p, w in zip(said["p"].to_pylist(), said["w"].to_pylist(), strict=True)]
    columns = [key, *keep]
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in columns) + f", `{phrase_key}` {phrases.schema[phrase_key].dataType.simpleString()}"
    shared = texts.sparkSession.sparkContext.broadcast(own)
    run = C.holder_rows(said["k"].combine_chunks(), [*columns, phrase_key], shared)
    return texts.where(F.col(text).isNotNull()).select(F.col(text).alias("__t"), *columns).repartition(key).mapInArrow(run, fields).select(key, phrase_key, *keep)


def resolve_gold(labels: DataFrame, chunks: DataFrame, on: list[str]) -> DataFrame:
    """Gold rows (query_id, on ..., chunk_id) of labels (query_id, on ...), by equality; fails when read if a label names no chunk."""
    return require_gold(labels, chunks.select(*on, "chunk_id"), on)


def routing(results: DataFrame, cases: DataFrame, threshold: float = 0.04) -> DataFrame:
    """Per case: book_first, book_any, term_hit, most, passed.

    ``results``: query_id, rank, book, content, score, as many as a prompt takes. ``cases``: query_id, in_scope, book (null: any) and
    terms, of which one must stand in the results' joined text (none: true). A case out of scope passes with scores below ``threshold``."""
    r = cases.join(results.select("query_id", "rank", F.col("book").alias("__book"), "content", "score"), "query_id", "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", F.lower("content").alias("c"))))), lambda x: x["c"]), " ")
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    same = F.col("__book") == F.col("book")
    out = r.groupBy("query_id", "in_scope", "book", "terms").agg(
        yes(same & (F.col("rank") == 1)).alias("book_first"), yes(same).alias("book_any"), text.alias("text"), F.coalesce(F.max("score"), F.lit(0.0)).alias("most"))
    hit = (F.coalesce(F.size("terms"), F.lit(0)) <= 0) | F.exists("terms", lambda t: F.contains(F.col("text"), F.lower(t)))
    out = out.withColumn("term_hit", F.coalesce(hit, F.lit(True)))
    passed = F.when(F.col("in_scope"), (F.col("book").isNull() | F.col("book_any")) & F.col("term_hit")).otherwise(F.col("most") < threshold)
    return out.select("query_id", "in_scope", "book", "book_first", "book_any", "term_hit", "most", passed.alias("passed"))


def routing_summary(cases: DataFrame) -> DataFrame:
    """One row of whole percentages over ``routing``'s rows; null where no case counts."""
    inside, named = F.col("in_scope"), F.col("in_scope") & F.col("book").isNotNull()
    pct = lambda cond, c, name: F.round(100 * F.avg(F.when(cond, F.col(c).cast("double"))), 0).alias(name)
    return cases.agg(F.count("*").alias("cases"), pct(named, "book_first", "book_first"), pct(named, "book_any", "book_any"), pct(inside, "term_hit", "term_hit"), pct(~inside, "passed", "rejected"), pct(F.lit(True), "passed", "passed"))
