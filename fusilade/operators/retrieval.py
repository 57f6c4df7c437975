"""Hybrid retrieval for batches of queries: lexical, dense and sparse legs, rank fusion, filters, diagnostics.

Chunks: (chunk_id, head, content, ...). A leg is (query_id, chunk_id, rank, score); ranks are cut before anything is joined, and Spark
cuts them on the map side too (WindowGroupLimit). Ties go to the smaller chunk id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import english as EN
from ..functions import text as X
from . import corpus as C

K, FTS_WEIGHT, DENSE_WEIGHT, SPARSE_WEIGHT = 50, 0.7, 1.0, 1.0
HEAD_WEIGHT, BODY_WEIGHT = 1.0, 0.1


def ranked(scored: DataFrame, depth: int, digits: int = 9) -> DataFrame:
    """Top ``depth`` of (query_id, chunk_id, score) per query."""
    scored = scored.withColumn("score", F.round("score", digits))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth).select("query_id", "chunk_id", "rank", "score")


def _english(rows: DataFrame) -> DataFrame:
    """Tokens as stems, without stop words. The vocabulary is stemmed, each token once, and joined; not the occurrences."""
    stems = rows.select("lexeme").distinct().select("lexeme", EN.lexeme("lexeme").alias("stem")).where("stem IS NOT NULL")
    return rows.join(stems, "lexeme").drop("lexeme").withColumnRenamed("stem", "lexeme")


def _one_each(chunks: DataFrame, head: str, content: str) -> tuple[DataFrame, int, bool]:
    """(chunk_id, head, content) with the texts of rows that share an id joined into one, the number of rows, and whether an id is null.

    Ids are counted when this is called; texts are dealt out by id when they are read, however few tasks their scan has."""
    counts = chunks.groupBy("chunk_id").agg(F.count("*").alias("k"))
    n, most, no_ids = counts.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0)), F.count_if(F.col("chunk_id").isNull())).first()
    own = chunks.select("chunk_id", F.col(head).alias("__head"), F.col(content).alias("__content"))
    if most > 1:
        several = counts.where("k > 1").select(F.col("chunk_id").alias("__id"))
        same = F.col("chunk_id").eqNullSafe(F.col("__id"))
        joined = own.join(several, same, "left_semi").groupBy("chunk_id").agg(*[F.concat_ws("\n", F.collect_list(c)).alias(c) for c in ("__head", "__content")])
        own = own.join(several, same, "left_anti").unionByName(joined)
    return own.repartition("chunk_id"), n, no_ids > 0


def postings(chunks: DataFrame, head: str = "head", content: str = "content", english: bool = False) -> DataFrame:
    """The term table (chunk_id, lexeme, tf_head, tf_body), of which the lexical leg, the terms' idf and the sparse vectors can be made.

    Terms are counted where a chunk's text is; nothing but texts is shuffled. English lexemes are stems without stop words."""
    own, kind = _one_each(chunks, head, content)[0], chunks.schema["chunk_id"].dataType.simpleString()
    return own.mapInArrow(C.posting_rows(english), f"chunk_id {kind}, lexeme string, tf_head long, tf_body long")


def english_postings(posts: DataFrame) -> DataFrame:
    """The term table by stems."""
    return _english(posts).groupBy("chunk_id", "lexeme").agg(F.sum("tf_head").alias("tf_head"), F.sum("tf_body").alias("tf_body"))


def body_terms(posts: DataFrame) -> DataFrame:
    """(chunk_id, term, tf) of the contents, from the term table."""
    return posts.where("tf_body > 0").select("chunk_id", F.col("lexeme").alias("term"), F.col("tf_body").alias("tf"))


def term_counts(df: DataFrame, text: Column, key: str) -> DataFrame:
    """(key, term, tf) of a text."""
    return df.select(key, F.explode(X.tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _asked_lexemes(queries: DataFrame, english: bool) -> DataFrame:
    """(query_id, lexeme) of the focused queries."""
    terms = queries.select("query_id", F.explode(F.array_distinct(X.tokens(X.focus_query("question")))).alias("lexeme"))
    return _english(terms).distinct() if english else terms


def fts_leg(queries: DataFrame, posts: DataFrame, depth: int, english: bool = False) -> DataFrame:
    """Chunks with any of the focused query's lexemes, by weighted occurrences, from a term table; ``english`` as the postings were made.

    Where the queries' lexemes can be broadcast, a chunk's score is summed where its terms are and each task cuts its own ranking, so a
    shuffle carries ``depth`` rows a query and task, however common a lexeme is."""
    hit = posts.join(_asked_lexemes(queries, english), "lexeme").groupBy("query_id", "chunk_id")
    return ranked(hit.agg((HEAD_WEIGHT * F.sum("tf_head") + BODY_WEIGHT * F.sum("tf_body")).alias("score")), depth)


#: Terms of several chunks that the driver collects and each worker holds, 16 bytes each; of more, sparse vectors are made by joins.
VOCABULARY = 4_000_000


def text_legs(queries: DataFrame, chunks: DataFrame, depth: int, legs: tuple[str, ...] = ("fts", "sparse"), most: int = 256, english: bool = False, vocabulary: int | None = None) -> DataFrame:
    """(leg, query_id, chunk_id, rank, score) of the lexical and the sparse leg over the chunks' texts: as ``fts_leg`` and ``sparse_leg``
    over ``postings``, by one pass over the texts for both, after one for the terms' idf where the sparse leg is asked for.

    A task keeps ``depth`` chunks a query and leg. The driver holds the terms of all queries and, up to ``vocabulary``, those of several
    chunks; they are collected when this is called. Chunk ids are whole numbers."""
    spark, kind = chunks.sparkSession, chunks.schema["chunk_id"].dataType.simpleString()
    own, n, no_ids = _one_each(chunks, "head", "content")
    found: dict[str, C.Leg] = {}
    rows: dict[str, pa.Table] = {}
    parts: list[DataFrame] = []
    if "fts" in legs:
        rows["fts"] = _asked_lexemes(queries, english).toArrow()
    if "sparse" in legs:
        rows["sparse"] = term_counts(queries, X.focus_query("question"), "query_id").toArrow()
    query_kind = queries.schema["query_id"].dataType.simpleString()
    ids = pa.concat_tables([t.select(["query_id"]) for t in rows.values()])["query_id"].unique()
    flat = lambda c: c.combine_chunks()
    numbers = lambda t: C.pc.index_in(flat(t["query_id"]), value_set=ids).to_numpy().astype(np.int64)

    if "fts" in legs:
        t = rows["fts"]
        found["fts"] = C.Leg(C.Asked(numbers(t), flat(t["lexeme"]), np.ones(len(t))), 9, HEAD_WEIGHT, BODY_WEIGHT, english)
    if "sparse" in legs:
        t = rows["sparse"]
        word = flat(t["term"]).cast(pa.string())
        asked = spark.createDataFrame(pa.table({"term": word.unique(), "asked": pa.array([True] * len(word.unique()))}))
        df = own.select("__content").mapInArrow(C.frequency_rows, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        idf_of = F.log(F.lit(n + 1.0) / (F.col("df") + 1))
        df = df.join(F.broadcast(asked), "term", "left").where("df > 1 OR asked")
        vocabulary = VOCABULARY if vocabulary is None else vocabulary
        known = df.select("term", idf_of.alias("idf")).limit(vocabulary + 1).toArrow()
        if len(known) > vocabulary:
            tf = body_terms(postings(chunks))
            by_joins = sparse_vectors(tf, idf(tf, chunks), "chunk_id", most)
            mine = sparse_vectors(term_counts(queries, X.focus_query("question"), "query_id"), idf(tf, chunks), "query_id", most)
            parts.append(sparse_leg(mine, by_joins, depth).withColumn("leg", F.lit("sparse")).select("leg", "query_id", "chunk_id", "rank", "score"))
        else:
            terms, value = flat(known["term"]).cast(pa.string()), flat(known["idf"]).to_numpy()
            at = C.pc.index_in(word, value_set=terms).fill_null(-1).to_numpy().astype(np.int64)
            w = np.where(at >= 0, C.weights(flat(t["tf"]).to_numpy(), value[at] if len(value) else np.zeros(len(at))), 0.0)
            order = np.empty(len(word), np.int64)
            order[C.pc.sort_indices(word).to_numpy()] = np.arange(len(word))
            query = numbers(t)
            by_query = np.argsort(query, kind="stable")
            kept = by_query[C.pruned(query[by_query], order[by_query], w[by_query], most)]
            hashes = C.term_hash(terms)
            o = np.argsort(hashes)
            rare = float(np.log((n + 1.0) / 2))
            found["sparse"] = C.Leg(C.Asked(query[kept], word.take(pa.array(kept)), w[kept]), 6, vocabulary=C.Vocabulary(hashes[o], value[o], rare), most=most)
    if found and len(ids):
        shared = spark.sparkContext.broadcast(found)
        run = C.ranking_rows(list(found), ids, depth, no_ids, shared)
        scored = own.mapInArrow(run, f"leg string, query_id {query_kind}, chunk_id long, score double").withColumn("chunk_id", F.col("chunk_id").cast(kind))
        digits = F.when(F.col("leg") == "sparse", F.round("score", 6)).otherwise(F.round("score", 9))
        w = Window.partitionBy("leg", "query_id").orderBy(F.desc("score"), "chunk_id")
        scored = scored.withColumn("score", digits).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)
        parts.append(scored.select("leg", "query_id", "chunk_id", "rank", "score"))
    if not parts:
        return spark.createDataFrame([], f"leg string, query_id {query_kind}, chunk_id {kind}, rank int, score double")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _unit(rows: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors among ``rows`` and these vectors at length 1; null, zero and non-finite ones and those of another
    length than ``dims`` are not usable."""
    flat = rows.flatten()
    if dims and not rows.null_count and not flat.null_count and len(flat) == dims * len(rows):
        whole, m = np.arange(len(rows)), flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    else:
        values = rows.to_pylist()
        whole = np.array([i for i, v in enumerate(values) if v and None not in v and (dims is None or len(v) == dims)], np.int64)
        m = np.array([values[i] for i in whole], np.float64).reshape(len(whole), -1 if len(whole) else 0)
    norm = np.sqrt((m * m).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return whole[ok], m[ok] / norm[ok, None]


def _best(score: np.ndarray, chunk: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``depth`` columns of each row by score, then by smaller chunk id."""
    order = np.lexsort((chunk, -score), axis=1)[:, :depth]
    return np.take_along_axis(score, order, 1), np.take_along_axis(chunk, order, 1)


def _step_best(score: np.ndarray, chunk: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_best``, unordered, for whole scores of columns with one chunk each: a key of score and place settles ties, no row is sorted."""
    order = np.argsort(chunk, kind="stable")
    score, chunk, n = score[:, order], chunk[order], len(chunk)
    if n > depth:
        pick = np.argpartition(score * -float(n) + np.arange(n), depth - 1, axis=1)[:, :depth]
        return np.take_along_axis(score, pick, 1), chunk[pick]
    return score, np.broadcast_to(chunk, score.shape)


def _dense_block(vectors: DataFrame, ids: list, unit: np.ndarray, depth: int, step: int) -> DataFrame:
    """One pass over the vectors for one block of queries; a task keeps ``depth`` rows a query, whatever it reads."""
    kind = vectors.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.full((len(ids), 0), -np.inf)
        chunk = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                at_rows, m = _unit(part["vec"], unit.shape[1])
                if not len(at_rows):
                    continue
                own = np.asarray(part["chunk_id"].to_numpy(zero_copy_only=False))[at_rows].astype(np.int64)
                more, ids_of = _step_best(np.rint(unit @ m.T * 1e9), own, depth)
                score, chunk = _best(np.concatenate([score, more], 1), np.concatenate([chunk, ids_of], 1), depth)
        n = score.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(chunk.ravel()), pa.array(score.ravel() / 1e9)], ["query_id", "chunk_id", "score"])

    return vectors.mapInArrow(run, "query_id long, chunk_id long, score double").withColumn("chunk_id", F.col("chunk_id").cast(kind))


def dense_leg(queries: DataFrame, vectors: DataFrame, depth: int, block: int = 4096, step: int = 1024) -> DataFrame:
    """Exact cosine top ``depth``, on scores of nine digits. Queries go in blocks of about ``block`` (told apart by hash, so none is
    left out), each sent to the tasks once as a matrix; a task holds ``block`` x (``step`` + ``depth``) scores at most. The driver holds
    the vectors of all queries. Ids are whole numbers. Vectors that are null, zero, or hold null or non-finite components have no rank;
    a query is compared with the vectors of its own length."""
    q = queries.where("query_vec IS NOT NULL").select("query_id", "query_vec")
    kind = queries.schema["query_id"].dataType.simpleString()
    v, out = vectors.where("vec IS NOT NULL").select("chunk_id", "vec"), None
    for dims, n in q.groupBy(F.size("query_vec")).count().collect():
        own, n_blocks = q.where(F.size("query_vec") == dims), max(1, -(-n // block))
        for k in range(n_blocks):
            rows = (own if n_blocks == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == k)).collect()
            usable, unit = _unit(pa.array([r.query_vec for r in rows], pa.list_(pa.float64())), dims)
            part = _dense_block(v, [rows[i].query_id for i in usable], unit, depth, step) if len(usable) else None
            if part is not None:
                out = part if out is None else out.unionByName(part)
    if out is None:
        out = v.where("false").select(F.lit(0).cast("long").alias("query_id"), "chunk_id", F.lit(0.0).alias("score"))
    return ranked(out.withColumn("query_id", F.col("query_id").cast(kind)), depth)


def prune(weights: DataFrame, most: int = 256, key: str = "chunk_id") -> DataFrame:
    """The largest non-zero weights of each vector."""
    w = Window.partitionBy(key).orderBy(F.desc("w"), "term")
    return weights.where("w > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def sparse_vectors(tf: DataFrame, idf: DataFrame, key: str = "chunk_id", most: int = 256) -> DataFrame:
    """(key, term, w) from (key, term, tf): log1p(tf) * idf, pruned."""
    return prune(tf.join(idf, "term").select(key, "term", F.round(F.log1p("tf") * F.col("idf"), 6).alias("w")), most, key)


def idf(tf: DataFrame, chunks: DataFrame) -> DataFrame:
    """(term, idf) from (chunk_id, term, tf), one row a chunk and term, over all ``chunks``; their number is counted in the same plan."""
    n = chunks.agg((F.count("*") + 1.0).alias("n"))  # one row
    return tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", F.log(F.col("n") / (F.col("df") + 1)).alias("idf"))


def max_pool(logits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Term weights of an encoder's (key, term, logit): max of log1p(relu(logit)) over a text's positions; padding has null logits."""
    return logits.where("logit IS NOT NULL").groupBy(key, "term").agg(F.max(F.log1p(F.greatest("logit", F.lit(0.0)))).alias("w"))


def to_storage(weights: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, sparse): a vector as one map of term to weight, of the terms above 0."""
    pairs = F.array_sort(F.collect_list(F.struct("term", "w")))  # as many as a vector keeps
    return weights.where("w > 0").groupBy(key).agg(F.map_from_entries(pairs).alias("sparse"))


def vector_literal(vec: str | Column, digits: int = 8) -> Column:
    """``[x,...]`` with that many decimals; null for a null vector."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ","), F.lit("]"))


def sparse_leg(query_terms: DataFrame, chunk_terms: DataFrame, depth: int) -> DataFrame:
    """Inverted-index join: sum of weight products over shared terms; chunks that share none get no rank."""
    q = query_terms.select("query_id", "term", F.col("w").alias("qw"))
    return ranked(chunk_terms.join(q, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score")).where("score > 0"), depth, 6)


def leg_rows(legs: dict[str, DataFrame]) -> DataFrame:
    """(leg, query_id, chunk_id, rank, score) of legs."""
    rows = None
    for name, leg in legs.items():
        part = leg.select(F.lit(name).alias("leg"), "query_id", "chunk_id", "rank", "score")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def fuse(legs: dict[str, DataFrame], weights: dict[str, float], k: int = K) -> DataFrame:
    """Reciprocal rank fusion in one aggregation: (query_id, chunk_id, <leg>_rank, <leg>_score ..., score)."""
    return fuse_rows(leg_rows(legs), list(legs), weights, k)


def fuse_rows(rows: DataFrame, legs: list[str], weights: dict[str, float], k: int = K) -> DataFrame:
    """As ``fuse``, from the rows of all legs."""
    of = lambda n, c: F.max(F.when(F.col("leg") == n, F.col(c)))
    out = rows.groupBy("query_id", "chunk_id").agg(*[of(n, "rank").alias(f"{n}_rank") for n in legs], *[of(n, "score").alias(f"{n}_score") for n in legs])
    total = sum((F.coalesce(F.lit(float(weights[n])) / (F.lit(float(k)) + F.col(f"{n}_rank")), F.lit(0.0)) for n in legs), F.lit(0.0))
    return out.withColumn("score", F.round(total, 9))


def top(fused: DataFrame, m: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)


WEIGHTS = {"fts": FTS_WEIGHT, "dense": DENSE_WEIGHT, "sparse": SPARSE_WEIGHT}
ABLATIONS = {"fused": WEIGHTS, "dense": {"fts": 0.0, "dense": 1.0, "sparse": 0.0}, "fts": {"fts": 1.0, "dense": 0.0, "sparse": 0.0}, "sparse": {"fts": 0.0, "dense": 0.0, "sparse": 1.0}}


def ablate(fused: DataFrame, m: int, runs: dict[str, dict[str, float]] = ABLATIONS, k: int = K) -> DataFrame:
    """(leg, query_id, chunk_id, rank, score): the same ranked legs under several weightings, scores of 0 left out."""
    table = F.array(*[F.struct(F.lit(r).alias("leg"), *[F.lit(float(w[n])).alias(n) for n in WEIGHTS]) for r, w in runs.items()])
    rows = fused.withColumn("w", F.explode(table))
    score = sum((F.coalesce(F.col(f"w.{n}") / (F.lit(float(k)) + F.col(f"{n}_rank")), F.lit(0.0)) for n in WEIGHTS), F.lit(0.0))
    rows = rows.select(F.col("w.leg").alias("leg"), "query_id", "chunk_id", F.round(score, 9).alias("score")).where("score > 0")
    return top(rows, m, ("leg", "query_id")).select("leg", "query_id", "chunk_id", "rank", "score")


def _holds(value):
    return lambda x: contains_value(x, value)


def contains_value(c: Column, value) -> Column:
    """Containment of ``value`` in a column: structs and maps hold each named field, arrays hold all that is asked for, scalars are equal."""
    if isinstance(value, dict):
        out = c.isNotNull()
        for k, v in value.items():
            out = out & contains_value(c[k], v)
        return out
    if isinstance(value, list | tuple):
        out = c.isNotNull()
        for v in value:
            out = out & F.exists(c, _holds(v))
        return out
    return c == F.lit(value)


def metadata_filter(chunks: DataFrame, wanted: dict) -> DataFrame:
    """Rows that contain ``wanted``, nested as deep as it is; an empty one is in all. Applied before any leg is ranked; conditions on
    plain columns reach the scan."""
    for key, value in wanted.items():
        chunks = chunks.where(F.coalesce(contains_value(F.col(key), value), F.lit(False)) if isinstance(value, dict | list | tuple) else contains_value(F.col(key), value))
    return chunks


def explain(results: DataFrame, question: str = "question", head: str = "head", content: str = "content") -> DataFrame:
    """Adds head_terms and body_terms: query terms that the heading holds, and those that only the body holds."""
    t = X.diagnostic_terms(question)
    inside = lambda c: F.filter(t, lambda x: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), x))
    return results.withColumn("head_terms", F.array_join(inside(head), " ")).withColumn("body_terms", F.array_join(F.array_except(inside(content), inside(head)), " "))
