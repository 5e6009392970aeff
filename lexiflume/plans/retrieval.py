"""Retrieval plans for all queries at once: filters, hybrid search, steps before and after, strategies, context and prompts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiflume.config import DEFAULTS, EngineConfig
from lexiflume.functions import text as X
from lexiflume.operators import correction, embedding, fusion, vectors
from lexiflume.operators.bm25 import Bm25Index, tags, tags_of
from lexiflume.operators.vectors import cosine
from lexiflume.providers import DEFAULT, Providers
from lexiflume.sources.store import kept

# Labels of a context block's lines, in order: metadata, scores with their decimal places, origin; the heading of the content.
BLOCK_LABELS = (
    ("source", "Nguồn"), ("chapter", "Chương"), ("section", "Mục"), ("article", "Điều"), ("article_no", "Số điều"), ("chapter_no", "Số chương"),
    ("section_no", "Số mục"), ("clause_nos", "Số khoản"), ("ref_article_nos", "Số điều viện dẫn"),
)
SCORE_LABELS = (("bm25_score", "Điểm BM25", 4), ("dense_score", "Điểm truy xuất dense", 4), ("rrf", "Điểm RRF", 6), ("rerank_score", "Điểm xếp hạng lại", 4))
ORIGIN_LABELS = (("origin", "Nguồn truy xuất"), ("referenced_article_no", "Số điều được viện dẫn"))
CONTENT_LABEL = "Nội dung:"
#: Fields that a query's text can filter by; clauses count for dense search only.
FILTER_FIELDS = ("article_no", "chapter_no", "section_no")


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def enriched(*names: str) -> Column:
    """"[k: v] [k: v]" and the content below; the content alone without metadata."""
    tagged = F.concat_ws(" ", *[F.when(_present(n), F.concat(F.lit(f"[{n}: "), F.col(n).cast("string"), F.lit("]"))) for n in names])
    return F.when(tagged != "", F.concat(tagged, F.lit("\n"), F.col("content"))).otherwise(F.col("content"))


def index_text(*names: str) -> Column:
    """Metadata values and content joined by spaces."""
    return F.concat_ws(" ", *[F.when(_present(n), F.col(n).cast("string")) for n in names], "content")


def context_block(number: Column, df: DataFrame) -> Column:
    """Numbered block with its metadata lines, scores, origin and content, as far as df has the columns (P05). Null and empty values give no line."""
    kinds = dict(df.dtypes)

    def line(c: str, label: str) -> Column:
        if kinds[c].startswith("array"):
            return F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: ["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]")))
        return F.when(_present(c), F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))

    lines = [line(c, label) for c, label in BLOCK_LABELS if c in kinds]
    lines += [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.format_string(f"%.{places}f", F.round(F.col(c).cast("double"), places)))) for c, label, places in SCORE_LABELS if c in kinds]
    lines += [line(c, label) for c, label in ORIGIN_LABELS if c in kinds]
    return F.concat_ws("\n", F.concat(F.lit("[Đoạn "), number.cast("string"), F.lit("]")), *lines, F.lit(CONTENT_LABEL), F.coalesce("content", F.lit("")))


def prompt(context: Column, question: Column) -> Column:
    """(P06)"""
    return F.concat(F.lit("<context>\n"), context, F.lit("\n</context>\n\n<question>\n"), question, F.lit("\n</question>"))


def analysed(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) with the normalised text as query, the original as asked, the numbers that it names (X29), and as tags and dense_tags what a
    search by BM25 and by vectors must match (F03)."""
    first = lambda c: F.try_element_at(c, F.lit(1))
    q = queries.select("query_id", F.col("query").alias("asked"), X.normalize(F.coalesce("query", F.lit(""))).alias("query"))
    clauses = F.array_distinct(F.concat(X.clause_numbers("query"), X.clause_markers("query")))
    q = q.select("*", first(X.article_numbers("query")).alias("article_no"), first(X.chapter_numbers("query")).alias("chapter_no"), first(X.section_numbers("query")).alias("section_no"), clauses.alias("clause_nos"))
    one = {f: (F.col(f), False) for f in FILTER_FIELDS}
    return q.withColumn("tags", tags(**one)).withColumn("dense_tags", tags(**one, clause_nos=(F.col("clause_nos"), True)))


def dense_scores(pairs: DataFrame, embeddings: DataFrame, rewritten: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """Cosine of each pair (query_id, doc_id): vectors of documents (vec_id, embedding) and of queries (the same ids unless given as (query_id,
    embedding)); a rewritten query vector (query_id, embedding) replaces the query's own (R09). Pairs without both vectors are left out."""
    own = embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")) if query_vectors is None else query_vectors.select("query_id", F.col("embedding").alias("qv"))
    if rewritten is not None:
        own = own.join(rewritten.select("query_id", F.col("embedding").alias("hyde")), "query_id", "full").select("query_id", F.coalesce("hyde", "qv").alias("qv"))
    docs = embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv"))
    return pairs.select("query_id", "doc_id").join(own, "query_id").join(docs, "doc_id").select("query_id", "doc_id", (F.round(cosine("qv", "dv"), 4) + 0.0).alias("dense_score"))


@dataclass
class Retriever:
    """Hybrid retrieval over an index, its chunks (doc_id, chunk_id, content, metadata) and embeddings (vec_id = doc_id, embedding; queries by the same ids
    unless query_vectors are given). pre, post and advanced name steps and a strategy (R18, R19): a strategy stands alone."""

    index: Bm25Index
    chunks: DataFrame
    embeddings: DataFrame
    config: EngineConfig = DEFAULTS
    providers: Providers = DEFAULT
    query_vectors: DataFrame | None = None
    pre: tuple[str, ...] = ()
    post: tuple[str, ...] = ()
    advanced: str | None = None

    def __post_init__(self):
        pre, post = checked_methods(self.advanced, list(self.pre), list(self.post))
        self.pre, self.post = tuple(pre), tuple(post)

    def understood(self, queries: DataFrame) -> DataFrame:
        """The analysed queries after the steps before retrieval (a rewriter unless one of these replaces it), kept. Those without a word are left out: they have
        empty results (R05)."""
        if "hyde" not in self.pre:
            queries = queries.withColumn("query", F.coalesce(self.providers.rewrite(F.col("query")), "query"))
        asked = analysed(queries).where(F.size(X.tokens("query")) > 0)
        for name in self.pre:
            asked = PREPROCESS[name](self, asked)
        return kept(asked)

    def vectors_of(self, asked: DataFrame) -> DataFrame:
        """query_id, embedding: a step's own vector, else the query's."""
        own = self.embeddings.select(F.col("vec_id").alias("query_id"), "embedding") if self.query_vectors is None else self.query_vectors
        own = asked.select("query_id").join(own, "query_id")
        if "hyde_embedding" not in asked.columns:
            return own
        hyde = asked.select("query_id", F.col("hyde_embedding"))
        return hyde.join(own, "query_id", "left").select("query_id", F.coalesce("hyde_embedding", F.col("embedding").cast("array<double>")).alias("embedding"))

    def dense_candidates(self, asked: DataFrame, relax: bool = False) -> DataFrame:
        """query_id, doc_id, dense_score, rank, filter_relaxed: nearest chunks that match a query's filter, clauses included; where none does and relax
        is set, nearest ones of all (F04)."""
        fields = {f: f for f in (*FILTER_FIELDS, "clause_nos") if f in self.chunks.columns}
        held = self.embeddings.join(self.chunks.select(F.col("doc_id").alias("vec_id"), tags_of(self.chunks, fields).alias("tags")), "vec_id")
        wanted = self.vectors_of(asked).join(asked.select("query_id", F.col("dense_tags").alias("tags")), "query_id")
        found = vectors.nearest(wanted, held, self.config.dense_candidates, relax=relax)
        return found.select("query_id", F.col("vec_id").alias("doc_id"), F.round("score", 4).alias("dense_score"), "rank", "filter_relaxed")

    def candidates(self, asked: DataFrame) -> DataFrame:
        """Best of BM25 by filter, scored by vectors and fused; queries that BM25 has nothing for take the nearest chunks (R01). asked: understood queries."""
        hits = kept(self.index.search(asked, self.config.bm25_candidates, self.config.relax_filter))
        dense = dense_scores(hits, self.embeddings, query_vectors=self.vectors_of(asked))
        fused = fusion.hybrid(hits.withColumnRenamed("score", "bm25_score"), dense, self.config.dense_candidates)
        without = kept(asked.join(hits.select("query_id").distinct(), "query_id", "left_anti"))
        if without.isEmpty():
            return fused
        return fused.unionByName(self.dense_candidates(without), allowMissingColumns=True)

    def select(self, queries: DataFrame) -> DataFrame:
        """The reranked hits of each query with their chunk columns, after the steps that follow retrieval."""
        return self.chosen(self.understood(queries))

    def chosen(self, asked: DataFrame) -> DataFrame:
        if self.advanced:
            return strategy(self.advanced)(self, asked)
        hits = self.candidates(asked).join(asked.select("query_id", "query"), "query_id").join(self.chunks, "doc_id")
        # Few rows that take long to score: adaptive execution would put them into a task or two.
        hits = hits.repartition(asked.sparkSession.sparkContext.defaultParallelism, "query_id", "doc_id")
        out = fusion.rerank(hits.withColumn("rerank_score", self.providers.rerank(F.col("query"), F.col("content"))), self.config.rerank_limit).withColumn("origin", F.lit("reranked"))
        for name in self.post:
            out = POSTPROCESS[name](self, asked, out)
        return out

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """query_id, query, filter_applied, filter_relaxed, selected and expanded chunk ids, context and prompt, and of how many blocks the context is (n_blocks,
        one that was cut included); queries without words give empty results (R05)."""
        asked = self.understood(queries)
        chosen = kept(self.chosen(asked))
        cited = chosen.withColumn("ref_article_nos", F.coalesce("ref_article_nos", F.array().cast("array<int>")))
        more = kept(fusion.expand_references(cited.select("query_id", F.col("final_rank").alias("rank"), "chunk_id", "ref_article_nos"), self.chunks, self.config.chunks_per_article))
        after = more.select("query_id", "chunk_id", F.col("position") + 1000, F.col("article_no").alias("referenced_article_no")).toDF("query_id", "chunk_id", "position", "referenced_article_no")
        after = after.join(self.chunks, "chunk_id").withColumn("origin", F.lit("reference"))
        shown = ["query_id", "position", "content", *[c for c, _ in BLOCK_LABELS], *[c for c, _, _ in SCORE_LABELS], *[c for c, _ in ORIGIN_LABELS]]
        first = chosen.withColumn("position", F.col("final_rank"))
        first, after = (df.select(*[c for c in shown if c in df.columns]) for df in (first, after))
        both = first.unionByName(after, allowMissingColumns=True).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
        text = fusion.context(both.select("query_id", "position", context_block(F.col("position"), both).alias("block")), self.config.max_context_chars)
        if "compressed" in chosen.columns:
            short = chosen.groupBy("query_id").agg(F.max("compressed").alias("compressed"))
            text = text.join(short, "query_id").select("query_id", F.col("compressed").alias("context"), "n_blocks")
        ids = lambda df, by, name: df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "chunk_id"))), lambda x: x["chunk_id"]), ",").alias(name))
        relaxed = chosen.groupBy("query_id").agg(F.max("filter_relaxed").alias("filter_relaxed"))
        out = queries.join(ids(chosen, "final_rank", "selected"), "query_id", "left").join(ids(more, "position", "expanded"), "query_id", "left").join(text, "query_id", "left").join(relaxed, "query_id", "left")
        out = out.join(asked.select("query_id", (F.size("dense_tags") > 0).alias("filtered")), "query_id", "left")
        blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
        was = F.coalesce("filter_relaxed", F.lit(False))
        return out.select("query_id", "query", (F.coalesce("filtered", F.lit(False)) & ~was).alias("filter_applied"), was.alias("filter_relaxed"), blank("selected"), blank("expanded"), blank("context"), prompt(F.coalesce("context", F.lit("")), F.coalesce("query", F.lit(""))).alias("prompt"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def fused_variants(index: Bm25Index, queries: DataFrame, providers: Providers = DEFAULT, config: EngineConfig = DEFAULTS, top_k: int | None = None) -> DataFrame:
    """Each query and its expansions searched by themselves, then fused; equal texts are searched once."""
    texts = queries.select("query_id", F.concat(F.array("query"), providers.expand(F.col("query"))).alias("texts")).select("query_id", F.array_distinct("texts").alias("texts"))
    variants = texts.select("query_id", F.posexplode("texts").alias("variant", "query")).withColumn("key", F.xxhash64("query_id", "variant"))
    hits = index.search(variants.select(F.col("key").alias("query_id"), "query"), config.dense_candidates)
    weight = F.when(F.col("variant") == 0, config.original_weight).otherwise(1.0)
    ranked = hits.withColumnRenamed("query_id", "key").join(variants.select("key", "query_id", "variant"), "key").select("query_id", "variant", weight.alias("weight"), "doc_id", (F.col("bm25_rank") - 1).alias("rank0"))
    return fusion.fuse_variants(ranked, config.rrf_k, top_k)


# Strategies: functions of a retriever and understood queries that give what Retriever.select gives.


def rag_fusion(retriever: Retriever, asked: DataFrame, top_k: int | None = None) -> DataFrame:
    found = fused_variants(retriever.index, asked, retriever.providers, retriever.config, top_k or retriever.config.rerank_limit)
    out = found.withColumnsRenamed({"rank": "final_rank", "score": "rrf"}).join(asked.select("query_id", "query"), "query_id").join(retriever.chunks, "doc_id")
    return out.withColumn("origin", F.lit("rag_fusion")).withColumn("filter_relaxed", F.lit(False))


def _screen_and_choose(retriever: Retriever, hits: DataFrame, top_k: int | None) -> DataFrame:
    """hits (query_id, query, chunk_id, content, rank, ...): relevance by yes or no; what is left undecided, at most config.choices of a query, is put to a
    multiple-choice model; both are merged (R08)."""
    c, p = retriever.config, retriever.providers
    answer = p.yes_no(F.col("query"), F.col("content"))
    scored = hits.withColumn("_a", answer).withColumn("score", F.round(correction.choice_score(F.col("_a.p_yes"), F.col("_a.p_no")), 4)).drop("_a")
    marked = kept(correction.screened(scored, c.tau_high, c.tau_low, c.choices))
    hard = marked.where((F.col("kind") == "hard") & (F.col("place") < c.choices))
    put = hard.groupBy("query_id").agg(F.first("query").alias("query"), F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring("content", 1, 1200).alias("t")))), lambda x: x["t"]).alias("passages"))
    picked = put.select("query_id", F.posexplode(X.chosen_letters(p.choose(F.col("query"), F.col("passages")), c.choices)).alias("choice", "place"))
    with_choice = marked.join(picked, ["query_id", "place"], "left")
    return correction.merged(with_choice, top_k or c.rerank_limit, c.choices).withColumn("origin", F.when(F.col("kind") == "keep", "slm_filter_easy_kept").otherwise("slm_filter_llm_reranked"))


def filter_rerank(retriever: Retriever, asked: DataFrame, top_k: int | None = None) -> DataFrame:
    hits = retriever.dense_candidates(asked, relax=retriever.config.relax_filter).join(asked.select("query_id", "query"), "query_id").join(retriever.chunks, "doc_id")
    return _screen_and_choose(retriever, hits, top_k)


#: Strategies by name (R19); further ones register here.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"rag_fusion": rag_fusion, "filter_rerank": filter_rerank}


def strategy(name: str) -> Callable[..., DataFrame]:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy: {name}")
    return STRATEGIES[name]


# Steps before retrieval: functions of a retriever and analysed queries.


def hyde(retriever: Retriever, asked: DataFrame) -> DataFrame:
    """The vector of a hypothetical answer replaces the query's in dense search; BM25 keeps the query."""
    embed = retriever.providers.embed or embedding.hashed_vectors
    made = embed(asked.select(F.col("query_id").alias("id"), retriever.providers.hypothetical(F.col("query")).alias("text")))
    return asked.join(made.select(F.col("id").alias("query_id"), F.col("embedding").alias("hyde_embedding")), "query_id", "left")


PREPROCESS: dict[str, Callable[[Retriever, DataFrame], DataFrame]] = {"base": lambda r, asked: asked, "hyde": hyde}


# Steps after retrieval: functions of a retriever, the queries and their chosen chunks.


def _strips(rows: DataFrame, score: Callable[[Column, Column], Column], key: list[str]) -> DataFrame:
    """Strips of the contents with a score against the query."""
    cut = rows.select(*key, "query", F.posexplode(X.strips("content")).alias("pos", "strip"))
    return cut.withColumn("score", F.round(score(F.col("query"), F.col("strip")), 4))


def crag(retriever: Retriever, asked: DataFrame, chosen: DataFrame) -> DataFrame:
    """Entailment judges each chunk; by each query's action the chunks that are not incorrect stay, refined to their useful strips, and hits of the external
    source come in (R11, R12)."""
    c, p = retriever.config, retriever.providers
    chosen = kept(chosen.withColumn("p", F.round(p.entail(F.col("query"), F.col("content")), 4)))
    judged = chosen.select("query_id", "chunk_id", F.col("final_rank").alias("rank"), "p")
    spark = chosen.sparkSession
    outside = p.external(asked.select("query_id", "query")) if p.external else spark.createDataFrame([], "query_id long, chunk_id string, content string, rank int")
    outside = kept(outside)
    plan = kept(correction.crag(judged, outside.select("query_id", "chunk_id", "rank"), c.crag_upper, c.crag_lower, c.crag_external))
    inside = chosen.join(plan.where("origin = 'internal'").select("query_id", "chunk_id", "action"), ["query_id", "chunk_id"])
    strips = _strips(inside.withColumn("id", F.struct("query_id", "chunk_id")), p.entail, ["id"])
    refined = correction.refine(strips, c.refine_threshold).select("id.query_id", "id.chunk_id", "refined")
    inside = inside.join(refined, ["query_id", "chunk_id"], "left").withColumn("content", F.coalesce("refined", "content")).drop("refined")
    others = plan.where("origin = 'external'").select("query_id", "chunk_id", "action").join(outside, ["query_id", "chunk_id"])
    others = others.join(asked.select("query_id", "query"), "query_id").select("query_id", "chunk_id", "action", "content", "query", (F.col("rank") + 1000).alias("final_rank"), F.lit("external").alias("origin"), F.lit(False).alias("filter_relaxed"))
    both = inside.unionByName(others, allowMissingColumns=True)
    return both.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("final_rank")))


def prompt_compression(retriever: Retriever, asked: DataFrame, chosen: DataFrame) -> DataFrame:
    """The sentences of all of a query's chunks that serve it best, within a budget of tokens, as the context."""
    chosen = kept(chosen)
    cut = _strips(chosen, retriever.providers.entail, ["query_id", "final_rank"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("final_rank", "pos")) - 1
    sentences = cut.select("query_id", place.alias("pos"), F.col("strip").alias("sentence"), "score", F.size(X.tokens("strip")).cast("long").alias("n_tokens"))
    return chosen.join(correction.compress(sentences, retriever.config.compression_target), "query_id", "left")


def _post_filter_rerank(retriever: Retriever, asked: DataFrame, chosen: DataFrame) -> DataFrame:
    return _screen_and_choose(retriever, chosen.withColumn("rank", F.col("final_rank")).drop("final_rank"), None)


POSTPROCESS: dict[str, Callable[[Retriever, DataFrame, DataFrame], DataFrame]] = {"base": lambda r, asked, chosen: chosen, "crag": crag, "prompt_compression": prompt_compression, "filter_rerank": _post_filter_rerank}
#: Steps that may be combined with others.
ADAPTABLE = {"prompt_compression"}


def checked_methods(advanced: str | None, pre: list[str], post: list[str]) -> tuple[list[str], list[str]]:
    """An advanced strategy turns pre and post off; of several methods one at most may be non-adaptable."""
    if advanced:
        strategy(advanced)
        return [], []
    for names, known in ((pre, PREPROCESS), (post, POSTPROCESS)):
        unknown = set(names) - set(known)
        if unknown:
            raise ValueError(f"unknown methods: {sorted(unknown)}")
        fixed = [n for n in names if n not in ADAPTABLE and n != "base"]
        if len(names) > 1 and len(fixed) > 1:
            raise ValueError(f"these methods can't be combined: {fixed}")
    return pre, post
