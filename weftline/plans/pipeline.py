"""Index a corpus; answer a table of questions. Results are written where more than one step reads them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import SIGNALS, Config, EdgeWeights
from weftline.functions.text import language_name
from weftline.functions.vectors import dot
from weftline.operators import diffusion, graph, lexical, retrieval, selection, signals, spectral, weights
from weftline.operators.chunking import chunk_documents, numbered
from weftline.operators.providers import Providers, cache_key, cached, default_providers, entity_terms, require_embedded
from weftline.plans.prompts import answer_prompt
from weftline.plans.view import context_blocks, context_texts
from weftline.sources.stores import IndexStore, ValueCache


class Engine:
    """An index below one path, and the questions put to it."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, providers: Providers | None = None, on_step: Callable[[str], None] | None = None):
        """on_step is told each step's name as it begins."""
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self.providers = providers or default_providers(self.config.embedding_dim)
        self.store, self.on_step = IndexStore(spark, self.path), on_step
        self.run = self._new_run()

    def _new_run(self) -> str:
        """Every indexing and every retrieval has a folder of its own: none overwrites what another's result still reads."""
        self.run = f"{self.path}/work/{uuid.uuid4().hex}"
        return self.run

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        if self.on_step:
            self.on_step(name)
        target = f"{self.run}/{name}"
        df.write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def clean(self, run: str | None = None) -> None:
        """Deletes one run's intermediate tables, or all; results that read them lazily can't be read any more."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run or f"{self.path}/work")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _kept(self, name: str, texts: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Values by content (key, value) for rows (key, text): those an earlier run has kept, others computed and kept."""
        cache = ValueCache(self.spark, f"{self.path}/cache/{name}")
        every, new = cached(texts.select("key", "text").dropDuplicates(["key"]), cache.read(), lambda misses: self._write(compute(misses).select("key", "value"), f"new_{name}"))
        every = self._write(every.select("key", "value"), name)
        cache.append(new.where("value is not null"))
        return every

    # -- indexing ----------------------------------------------------------------------------------------

    def index(self, documents: DataFrame) -> EdgeWeights:
        """Chunks, vectors, six signals, one graph, coordinates, clusters; returns the weights it used.

        documents: (doc_id, source, items). An empty corpus is an error.
        """
        c, p = self.config, self.providers
        run = self._new_run()
        chunks = self._write(numbered(chunk_documents(documents, c.chunking, embed=p.embed_texts)), "chunks")
        if chunks.isEmpty():
            raise ValueError("no text to index")
        rich = chunks.withColumn("language", p.language(F.col("text"), c.fallback_language)).withColumn("tokens", p.token_len(F.col("text")))
        rich = rich.withColumn("key", cache_key(F.col("text"), p.model)).withColumn("utility_questions", p.questions(F.substring("text", 1, c.indexing.question_text_chars), c.indexing.questions_per_chunk))
        vectors = self._kept("embeddings", rich.select("key", "text"), lambda misses: misses.select("key", p.embed(F.col("text"), "document").alias("value")))
        rich = rich.join(vectors.withColumnRenamed("value", "embedding"), "key", "left").drop("key")
        rich = require_embedded(self._write(rich, "embedded"))
        raw = self._write(self.raw_edges(rich), "raw_edges")
        used = c.edge_weights
        nodes = rich.select(F.col("chunk_idx").alias("id"), "chunk_id", "doc_id", "position")
        if c.indexing.edge_weight_mode == "calibrate":
            used = weights.calibrate(raw, used)
        elif c.indexing.edge_weight_mode == "fit":
            used, _ = weights.fit(raw, nodes, used)
        edges = self._write(graph.combine(raw, used, c.indexing.sparsify_threshold), "edges")
        if c.indexing.spectral_mode == "multiplex":
            entries = spectral.multiplex(nodes, raw, used.as_dict())
        else:
            entries = spectral.laplacian(nodes, edges)
        size = rich.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("doc_size"))
        placed = rich.join(size, ["source", "doc_id"]).select(F.col("chunk_idx").alias("id"), "position", "doc_size")
        coords = self._write(spectral.coordinates(placed, entries, c.indexing.spectral_components, c.indexing.spectral_local_nodes), "coords")
        labels = spectral.cluster_labels(coords, c.indexing.clusters)
        final = rich.join(coords.select(F.col("id").alias("chunk_idx"), "coords"), "chunk_idx", "left").join(labels.select(F.col("id").alias("chunk_idx"), F.col("label").alias("cluster_label")), "chunk_idx", "left")
        self.store.save(final.fillna(-1, ["cluster_label"]), nodes, edges)
        self.clean(run)
        return used

    def _terms(self, chunks: DataFrame) -> DataFrame:
        """Rows (chunk_idx, terms) of the entity signal."""
        p = self.providers
        if self.config.indexing.entity_mode != "llm_concepts":
            return chunks.select("chunk_idx", entity_terms(p.all_entities(F.col("text"))).alias("terms"))
        if p.text_concepts is None:
            return p.concepts(chunks)
        keyed = chunks.select("chunk_idx", "text", cache_key(F.col("text"), "concepts").alias("key"))
        kept = self._kept("concepts", keyed, lambda misses: misses.select("key", p.text_concepts(F.col("text")).alias("value")))
        return keyed.join(kept, "key").where("value is not null").select("chunk_idx", F.col("value").alias("terms"))

    def raw_edges(self, chunks: DataFrame) -> DataFrame:
        """All registered signals in one long table."""
        i, p = self.config.indexing, self.providers
        terms = self._terms(chunks)
        asked = chunks.select("chunk_idx", F.posexplode("utility_questions").alias("n", "question")).select((F.col("chunk_idx") * 64 + F.col("n")).alias("question_id"), "chunk_idx", p.embed(F.col("question"), "document").alias("embedding"))
        made = [
            signals.semantic(chunks, i.semantic_k, i.semantic_threshold),
            signals.section(chunks, i.max_section_members),
            signals.entity(terms, i.entity_min_freq),
            signals.adjacency(chunks),
            signals.utility_question(asked, i.question_search_k, i.question_threshold),
            signals.citation(chunks),
        ]
        made += [f(chunks) for name, f in signals.EXTRACTORS.items() if name not in SIGNALS]
        return reduce(DataFrame.unionByName, made)

    # -- questions ---------------------------------------------------------------------------------------

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """Contexts of all questions (query_id, question): rows (query_id, rank, chunk_idx, score, tokens, source, ...)."""
        r, p = self.config.retrieval, self.providers
        self._new_run()
        chunks, edges = self.store.load(), self.store.graph.edges
        asked = self._write(queries.select(F.col("query_id").cast("long").alias("query_id"), "question").withColumn("embedding", p.embed(F.col("question"), "query")), "queries")
        ranked = [retrieval.dense_ranking(asked, chunks, max(r.seed_k, r.question_seed_k))]
        if r.question_seeds:
            asked_of = chunks.select("chunk_idx", F.posexplode("utility_questions").alias("n", "question")).select((F.col("chunk_idx") * 64 + F.col("n")).alias("question_id"), "chunk_idx", p.embed(F.col("question"), "query").alias("embedding"))
            hits = retrieval.dense_ranking(asked, asked_of.select(F.col("question_id").alias("chunk_idx"), "embedding"), 4 * r.question_seed_k).withColumnRenamed("chunk_idx", "question_id")
            ranked.append(retrieval.question_ranking(hits, asked_of, r.question_seed_k))
        lexical_scores = lexical.bm25_scores(chunks, asked, "chunk_idx", "text", "query_id", "question").withColumnRenamed("doc_id", "chunk_idx")
        if r.bm25_seeds:
            top = lexical.top_per_query(lexical_scores, r.bm25_seed_k, "chunk_idx").where("score > 0")
            ranked.append(top.select("query_id", "chunk_idx", (F.col("rank") - 1).alias("rank")))
        seeds = self._write(retrieval.rrf(ranked, r.seed_k, r.rrf_k).select("query_id", F.col("chunk_idx").alias("id")), "seeds")
        pool = self._write(graph.expand(seeds, edges, r.hops, r.max_candidates), "pool")
        # Relevance is scaled by each query's best dense and best lexical score: the pool and those two rows suffice.
        best_lexical = lexical.top_per_query(lexical_scores, 1, "chunk_idx").select("query_id", F.col("chunk_idx").alias("id"))
        needed = pool.select("query_id", "id").unionByName(ranked[0].where("rank = 0").select("query_id", F.col("chunk_idx").alias("id"))).unionByName(best_lexical).distinct()
        vectors = needed.join(chunks.select(F.col("chunk_idx").alias("id"), "embedding"), "id").join(asked.select("query_id", F.col("embedding").alias("q")), "query_id")
        dense = vectors.select("query_id", F.col("id").alias("chunk_idx"), dot(F.col("q"), F.col("embedding")).alias("score"))
        relevance = retrieval.hybrid_relevance(dense, lexical_scores, r.lexical_weight).withColumnRenamed("chunk_idx", "id").join(pool, ["query_id", "id"]).select("query_id", "id", "score")
        relevance = self._write(relevance, "relevance")
        with_relevance = seeds.join(relevance, ["query_id", "id"]).select("query_id", "id", F.col("score").alias("relevance"))
        coords = chunks.select(F.col("chunk_idx").alias("id"), F.col("coords").alias("v"))
        near = diffusion.seed_proximity(pool, with_relevance, coords, r.seed_aggregation, r.seed_topk) if r.diffusion_mode in ("spectral", "hybrid") else None
        walked = diffusion.ppr_proximity(pool, seeds, edges, r.ppr_damping) if r.diffusion_mode in ("ppr", "hybrid") else None
        scored = diffusion.diffuse(relevance, near, walked, r.alpha)
        facts = chunks.select(F.col("chunk_idx").alias("id"), "chunk_id", "tokens", "source", "doc_id", "position", "page", "section_path", "text", F.col("embedding").alias("v"), "coords", F.col("cluster_label").alias("cluster"))
        pool_rows = scored.join(facts, "id").join(asked.select("query_id", "question"), "query_id").withColumn("ce", p.rerank(F.col("question"), F.col("text"))).withColumn("raw", F.col("relevance"))
        pool_rows = self._write(pool_rows, "scored")
        chosen = selection.select(pool_rows.drop("text", "question"), r, edges)
        return chosen.join(pool_rows.drop("score", "v", "coords", "raw", "ce", "cluster"), ["query_id", "id"]).withColumnRenamed("id", "chunk_idx")

    def query(self, queries: DataFrame) -> DataFrame:
        """Rows (query_id, question, answer, context, prompt); the prompt is what a language model would be asked."""
        context = self._write(self.retrieve(queries), "context")
        texts = context_texts(context_blocks(context))
        flat = context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("flat"))
        return queries.join(texts, "query_id", "left").join(flat, "query_id", "left").select("query_id", "question", self.providers.answer(F.col("question"), F.coalesce("flat", F.lit(""))).alias("answer"), "context", answer_prompt(F.col("question"), F.coalesce("context", F.lit("")), language_name(self.providers.language(F.col("question"), self.config.fallback_language))).alias("prompt"))
