"""Search and answers over a corpus of chunks, for batches of questions: one plan, whatever their number.

    search = HybridSearch(chunks, vectors, documents)
    found = search.retrieve(questions)
    replies = answers(questions, prompts(questions, found), generate)

Chunks: chunk_id, document_id, head, content, page_start, page_end and metadata columns. Vectors: chunk_id, vec. Documents: document_id,
title, author. Questions: query_id, question, query_vec (null: no dense leg). Encoders and generators are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import retrieval as H

NOTHING_FOUND = "Nothing in the corpus is relevant to that question."


@dataclass(frozen=True)
class Settings:
    """Results per question, candidates of an inspection, fusion constants, kept sparse terms, the least score (applied last), and whether
    the lexical leg stems English and leaves stop words out."""

    top_n: int = 6
    top_k: int = 20
    rrf_k: int = H.K
    weights: dict[str, float] = field(default_factory=lambda: dict(H.WEIGHTS))
    sparse_terms: int = 256
    floor: float = 0.0
    english: bool = True


class HybridSearch:
    def __init__(self, chunks: DataFrame, vectors: DataFrame, documents: DataFrame, settings: Settings = Settings(), terms: DataFrame | None = None):
        """``terms`` is the chunks' stored term table (``retrieval.postings``), for which no text is read again; without it each search makes it."""
        self.chunks, self.vectors, self.documents, self.settings, self.terms = chunks, vectors, documents, settings, terms

    def leg(self, name: str, questions: DataFrame, depth: int, wanted: dict | None = None) -> DataFrame:
        """One ranked leg; the lexical and the sparse one read the focused question, the dense one its vector."""
        s, c = self.settings, H.metadata_filter(self.chunks, wanted or {})
        if name == "dense":
            return H.dense_leg(questions, self.vectors.join(c.select("chunk_id"), "chunk_id", "left_semi"), depth)
        if self.terms is None:
            return H.text_legs(questions, c, depth, (name,), s.sparse_terms, s.english).drop("leg")
        posts = self.terms.join(c.select("chunk_id"), "chunk_id", "left_semi") if wanted else self.terms
        if name == "fts":
            return H.fts_leg(questions, H.english_postings(posts) if s.english else posts, depth, s.english)
        tf = H.body_terms(posts)
        idf = H.idf(tf, c)
        asked = H.sparse_vectors(H.term_counts(questions, X.focus_query("question"), "query_id"), idf, "query_id", s.sparse_terms)
        return H.sparse_leg(asked, H.sparse_vectors(tf, idf, "chunk_id", s.sparse_terms), depth)

    def legs(self, questions: DataFrame, depth: int, wanted: dict | None = None) -> dict[str, DataFrame]:
        """The ranked legs."""
        return {name: self.leg(name, questions, depth, wanted) for name in H.WEIGHTS}

    def ranked(self, questions: DataFrame, depth: int, wanted: dict | None = None) -> DataFrame:
        """(leg, query_id, chunk_id, rank, score): the rows of all legs, with one pass over the texts for the lexical and the sparse one."""
        if self.terms is not None:
            return H.leg_rows(self.legs(questions, depth, wanted))
        s, c = self.settings, H.metadata_filter(self.chunks, wanted or {})
        texts = H.text_legs(questions, c, depth, most=s.sparse_terms, english=s.english)
        return texts.unionByName(H.leg_rows({"dense": self.leg("dense", questions, depth, wanted)}))

    def candidates(self, questions: DataFrame, m: int, wanted: dict | None = None) -> DataFrame:
        """Top ``m`` per question with each leg's rank and score; legs are ranked to twice that depth."""
        return H.top(H.fuse_rows(self.ranked(questions, 2 * m, wanted), list(H.WEIGHTS), self.settings.weights, self.settings.rrf_k), m)

    def _cited(self, found: DataFrame) -> DataFrame:
        # As many as the questions' results: the texts of all chunks are not shuffled for them.
        out = self.chunks.join(F.broadcast(found), "chunk_id").join(self.documents.select("document_id", "title", "author"), "document_id")
        return out.withColumn("citation", X.citation("title", "author", "page_start", "page_end"))

    def retrieve(self, questions: DataFrame, top_n: int | None = None, wanted: dict | None = None) -> DataFrame:
        """The chunks of each question with citation; those under the floor go after the cut."""
        m = self.settings.top_n if top_n is None else top_n
        return self._cited(self.candidates(questions, m, wanted).where(F.col("score") >= self.settings.floor)).withColumn("selected", F.lit(True))

    def inspect(self, questions: DataFrame, top_k: int | None = None, top_n: int | None = None, wanted: dict | None = None) -> DataFrame:
        """All candidates; the first ``top_n`` are marked as selected."""
        s = self.settings
        k, n = s.top_k if top_k is None else top_k, s.top_n if top_n is None else top_n
        return self._cited(self.candidates(questions, k, wanted)).withColumn("selected", F.col("rank") <= n)


def sources(found: DataFrame) -> DataFrame:
    """(query_id, n, citation, chunk_id, score) as shown to a reader."""
    return found.select("query_id", F.col("rank").alias("n"), "citation", "chunk_id", F.round("score", 4).alias("score"))


def prompts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, prompt): the question and its numbered sources; null without sources. A question has ``top_n`` sources at most."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("citation"), F.lit("\n"), F.col("content"))
    got = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("s"))
    ask = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nSources:\n"), F.col("s"), F.lit("\n\nAnswer from these sources alone and cite them inline as [n]."))
    return questions.select("query_id", "question").join(got, "query_id", "left").select("query_id", ask.alias("prompt"))


def answers(asked: DataFrame, generate: Callable[[list[str]], list[str]]) -> DataFrame:
    """(query_id, answer) from ``prompts``: ``generate`` gets a batch of prompts; questions without sources get a fixed reply."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            has = b["prompt"].notna()
            b["answer"] = NOTHING_FOUND
            if has.any():
                b.loc[has, "answer"] = generate(b.loc[has, "prompt"].tolist())
            yield b[["query_id", "answer"]]

    return asked.mapInPandas(run, "query_id long, answer string")


@dataclass(frozen=True)
class Gateway:
    """Generators by model name, with one temperature and length for all; ``generate`` goes to ``answers``.

    A model takes (prompts, temperature, max_tokens) and gives a text, or an iterable of its pieces, for each; empty pieces are skipped."""

    models: dict[str, Callable[[list[str], float, int], Iterable]]
    model: str
    temperature: float = 0.2
    max_tokens: int = 1024

    def stream(self, asked: list[str]) -> Iterator[Iterator[str]]:
        if self.model not in self.models:
            raise KeyError(f"no model {self.model}")
        for got in self.models[self.model](asked, self.temperature, self.max_tokens):
            yield iter([got]) if isinstance(got, str) else (piece for piece in got if piece)

    def generate(self, asked: list[str]) -> list[str]:
        return ["".join(pieces) for pieces in self.stream(asked)]


def traced(df: DataFrame, name: str | None) -> tuple[DataFrame, Observation | None]:
    """The plan with its number of rows and of questions, and its scores' range, observed as it runs; the plan as it was without a name."""
    if not name:
        return df, None
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min("score").alias("least"), F.max("score").alias("most")), seen


def judge(found: DataFrame, questions: DataFrame, replies: DataFrame, ask: Callable[[list[str]], list[str]], top_n: int = 4) -> DataFrame:
    """(query_id, faithfulness, relevancy, precision): what a judge, given as a generator, says of an answer and its first ``top_n`` sources.

    It must reply with a JSON array of three numbers; anything else gives nulls."""
    used = prompts(questions, found.where(F.col("rank") <= top_n)).join(replies, "query_id")
    text = F.concat("prompt", F.lit("\n\nAnswer:\n"), "answer", F.lit("\n\nReply with [faithfulness, relevancy, precision], each from 0 to 1."))
    said = answers(used.select("query_id", text.alias("prompt")), ask).withColumnRenamed("answer", "reply")
    scores = F.from_json(F.regexp_extract("reply", "\\[[^\\]]*\\]", 0), "array<double>")
    ok = F.when(F.size(scores) == 3, scores)
    return said.select("query_id", *[ok[k].alias(n) for k, n in enumerate(("faithfulness", "relevancy", "precision"))])


def register_sql(spark: SparkSession, legs: dict[str, DataFrame], name: str = "hybrid_search") -> None:
    """A table function over ranked legs, for SQL: ``SELECT * FROM hybrid_search(match_count => 6)``. Weights and the constant have the
    same defaults as ``Settings``; scores of 0 are left out."""
    rows = None
    for leg, df in legs.items():
        part = df.select("query_id", "chunk_id", F.lit(leg).alias("leg"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    rows.createOrReplaceTempView(f"{name}_legs")
    kind = rows.schema["chunk_id"].dataType.simpleString()
    weight = " ".join(f"WHEN '{n}' THEN {n}_weight" for n in H.WEIGHTS)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(match_count INT DEFAULT 6, rrf_k DOUBLE DEFAULT {float(H.K)}, {", ".join(f"{n}_weight DOUBLE DEFAULT {w}" for n, w in H.WEIGHTS.items())})
      RETURNS TABLE (query_id {rows.schema["query_id"].dataType.simpleString()}, chunk_id {kind}, score DOUBLE, rank INT)
      RETURN SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT query_id, chunk_id, round(sum(part), 9) AS score FROM (SELECT query_id, chunk_id, CASE leg {weight} END / (rrf_k + rank) AS part FROM {name}_legs WHERE rank <= 2 * match_count)
        GROUP BY query_id, chunk_id) WHERE score > 0) WHERE rank <= match_count""")
