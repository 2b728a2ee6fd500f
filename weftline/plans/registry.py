"""All queries by name and, where SQL can express them, the DuckDB SQL that must give the same rows.

Numbers that depend on the order of additions are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.functions import vectors as vx
from weftline.config import View
from weftline.operators import chunking, diffusion, graph, lexical, retrieval, selection, signals, spectral, weights
from weftline.operators.providers import cache_key, cached, default_providers, merge_entities, overlap_reranker, tfidf_concepts
from weftline.plans import view
from weftline.sources.readers import documents_from_table, html_text
from weftline.sources.stores import IndexStore, SessionStore, ValueCache, session_summary, url_section_path
from weftline.streaming.ingest import latest_per_user, windowed_activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: No pair of the embeddings table reaches the default 0.75, so the queries use a lower threshold.
THRESHOLD = 0.30


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), "embedding")


# -- text ------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_distinct FROM documents""")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = tx.tokenize(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("long").alias("n_distinct"))


@query("""SELECT doc_id, substr(sha256(concat_ws(':', source, CAST(doc_id AS VARCHAR), '0', substr(text, 1, 64))), 1, 16) AS chunk_id, substr(sha256(text), 1, 16) AS text_hash FROM documents""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", tx.chunk_id(F.col("source"), F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_id"), tx.text_hash(F.col("text")).alias("text_hash"))


@query("""
    WITH w AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(CAST(greatest(ceil((len(w) - 20) / 80.0), 1) AS BIGINT))) AS position FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(position AS INTEGER) AS position, CAST(len(w[position * 80 + 1 : position * 80 + 100]) AS INTEGER) AS n_words,
        array_to_string(w[position * 80 + 1 : position * 80 + 100], ' ') AS text FROM p""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_windows(t(spark, sf_dir, "documents"), 100, 20)


@query("""
    WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
    SELECT doc_id, CAST(count(*) FILTER (regexp_matches(line, '^#{1,6}\\s+.+$') OR regexp_matches(line, '^\\d+(\\.\\d+)*\\s+\\S[^\\n]{3,}$')) AS INTEGER) AS n_headings,
        CASE WHEN n_headings >= 2 THEN 'structural' ELSE 'semantic' END AS strategy FROM l GROUP BY doc_id""")
def heading_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", tx.heading_count(F.col("text")).alias("n_headings"), tx.select_strategy(F.col("text"), True).alias("strategy"))


_REF_TEXT = "coalesce(text, '') || ' see [1, 2] and [' || CAST(doc_id % 7 AS VARCHAR) || '; 9] (Smith et al. 2019) doi:10.1234/AB.' || CAST(doc_id % 5 AS VARCHAR) || ' at https://example.org/p/' || CAST(doc_id % 11 AS VARCHAR) || '.'"


@query(f"""
    WITH d AS (SELECT doc_id, {_REF_TEXT} AS x FROM documents),
    k AS (SELECT doc_id, list_distinct(list_concat(
        list_transform(flatten(list_transform(regexp_extract_all(x, '\\[(\\d+(?:[,;]\\s*\\d+)*)\\]', 1), lambda g: string_split_regex(g, '[,;]\\s*'))), lambda n: 'ref:' || trim(n)),
        list_transform(regexp_extract_all(x, '(?i)doi:\\s*(10\\.\\d{{4,}}/\\S+)', 1), lambda n: 'doi:' || lower(n)),
        list_transform(regexp_extract_all(x, 'https?://[^\\s>"'']+'), lambda n: 'url:' || regexp_replace(n, '[.,;)]+$', '')))) AS keys FROM d)
    SELECT doc_id, array_to_string(list_sort(keys), ' ') AS keys, len(keys) AS n_keys FROM k""")
def citation_key_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the texts with a line of references added, since the table has none."""
    keys = tx.citation_keys(F.expr(_REF_TEXT.replace("VARCHAR", "STRING")))
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(keys), " ").alias("keys"), F.size(keys).cast("long").alias("n_keys"))


@query(f"""
    WITH d AS (SELECT doc_id, {_REF_TEXT} AS x FROM documents),
    k AS (SELECT doc_id, list_concat(regexp_extract_all(x, '\\[[\\d,\\s–\\-]+\\]'), regexp_extract_all(x, '\\(\\w[^)]{{2,40}}\\d{{4}}\\w?\\)'), regexp_extract_all(x, '(?i)doi:\\s*10\\.\\d{{4,}}/\\S+'),
        list_transform(regexp_extract_all(x, 'https?://\\S+'), lambda n: regexp_replace(n, '[.,;)]+$', ''))) AS refs FROM d)
    SELECT doc_id, array_to_string(list_sort(list_distinct(refs)), ' ') AS refs FROM k""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(tx.extract_references(F.expr(_REF_TEXT.replace("VARCHAR", "STRING")))), " ").alias("refs"))


@query("""
    SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE lang END AS language,
        replace(substr(text, 1, 80), chr(10), ' ') AS label, substr(text, 1, 200) AS preview FROM documents""")
def labels_and_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", tx.language_name(F.col("lang")).alias("language"), tx.label_of(F.col("text"), 80).alias("label"), tx.snippet(F.col("text"), 200).alias("preview"))


def _stop_hits(words: tuple[str, ...]) -> str:
    return f"len(list_filter(w, lambda x: list_contains({list(words)!r}, x)))"


@query(f"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+') AS w FROM documents),
    h AS (SELECT doc_id, lang, text, {", ".join(f"{_stop_hits(words)} AS {code}" for code, words in tx.STOP_WORDS.items())} FROM d)
    SELECT doc_id, lang, CASE WHEN length(trim(text)) < 20 OR greatest(en, fr, de, es) = 0 THEN 'en' WHEN en = greatest(en, fr, de, es) THEN 'en'
        WHEN fr = greatest(en, fr, de, es) THEN 'fr' WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS detected FROM h""")
def detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", "lang", tx.detect_language(F.col("text")).alias("detected"))


@query("""SELECT source, count(DISTINCT sha256(text)) AS n_texts, count(*) AS n_docs, count(*) - count(DISTINCT sha256(text)) AS n_saved FROM documents GROUP BY source""")
def embed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache by content saves when each source is embedded: equal texts are computed once."""
    docs = t(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("key"))
    return docs.groupBy("source").agg(F.count_distinct("key").alias("n_texts"), F.count(F.lit(1)).alias("n_docs")).withColumn("n_saved", F.col("n_docs") - F.col("n_texts"))


@query("""
    WITH h AS (SELECT DISTINCT sha256(text) AS key, lang FROM documents),
    c AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE lang = 'en')
    SELECT h.lang, count(*) AS n_misses FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.key = h.key) GROUP BY h.lang""")
def embed_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts still to be computed once those in English are in the cache."""
    docs = t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), "lang")
    kept = docs.where("lang = 'en'").select("key").distinct()
    return docs.distinct().join(kept, "key", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n_misses"))


# -- lexical ---------------------------------------------------------------------------------------------

_BM25 = """
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents),
    n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(toks)) AS avgdl FROM d),
    p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY ALL),
    s AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM p GROUP BY term),
    m AS (SELECT avg(ln(n - df + 0.5) - ln(df + 0.5)) AS mean_idf FROM s, n),
    i AS (SELECT term, CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * mean_idf ELSE ln(n - df + 0.5) - ln(df + 0.5) END AS idf FROM s, n, m),
    q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
    x AS (SELECT q.item_id AS query_id, p.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * p.len / avgdl))), 6) AS score
        FROM q JOIN p USING (term) JOIN i USING (term), n GROUP BY ALL),
    bm AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 20 AND score > 0)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries over all documents: the 20 best by BM25."""
    return lexical.bm25_topk(t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark"), 20)


@query(f"""
    WITH {_BM25}, r AS (SELECT bm.*, d.n_chars, max(score) OVER (PARTITION BY query_id) AS top FROM bm JOIN documents d USING (doc_id)),
    u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn, sum(n_chars) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE score >= 0.3 * top)
    SELECT query_id, doc_id AS id, CAST(rn AS INTEGER) AS rank, score FROM u WHERE rn = 1 OR used <= 12000""")
def select_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.token_budget_window(_pool(spark, sf_dir), 12000)


@query(f"""WITH {_BM25} SELECT query_id, doc_id AS id, CAST(rank AS INTEGER) AS rank, score FROM bm WHERE rank <= 10""")
def select_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.topk(_pool(spark, sf_dir), 10)


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits, stored: a small table that meets the documents without moving them."""
    return _once(spark, bm25_topk(spark, sf_dir), "hits")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits as candidates, with characters for tokens and hashed words for vectors."""
    docs = t(spark, sf_dir, "documents")
    hits = _hits(spark, sf_dir).select("query_id", F.col("doc_id").alias("id"), "score")
    return hits.join(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("tokens"), "source"), "id").select("query_id", "id", "score", "tokens", "source")


def _rich_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    embed = default_providers(64).embed
    rows = _once(spark, _pool(spark, sf_dir), "pool").join(docs, "id").join(asked, "query_id")
    rich = rows.select("query_id", "id", "score", "tokens", "source", embed(F.col("text"), "document").alias("v"), F.col("score").alias("raw"), F.lit(-1).alias("cluster"), overlap_reranker(F.col("question"), F.col("text")).alias("ce"))
    return _once(spark, rich, "rich-pool")


def _mode(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    from weftline.config import Retrieval

    rich = _rich_pool(spark, sf_dir)
    edges = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"), F.lit(0.5).alias("weight"))
    return selection.select(rich, Retrieval(selection_mode=mode), edges)


@query()
def select_budget_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(spark, sf_dir, "token_budget")


@query()
def select_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(spark, sf_dir, "mmr")


@query()
def select_protected_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(spark, sf_dir, "protected_mmr")


@query()
def select_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(spark, sf_dir, "greedy")


@query()
def select_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode(spark, sf_dir, "anchor_expand_ce")


@query(f"""
    WITH {_BM25}, f AS (SELECT bm.*, d.source, d.text, min(rank) OVER (PARTITION BY query_id, d.source) AS fs FROM bm JOIN documents d USING (doc_id)),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fs, rank) AS n FROM f)
    SELECT query_id, CAST(n AS INTEGER) AS n, source, CASE WHEN rank = fs THEN '=== Source: ' || source || ' ===' || chr(10) ELSE '' END
        || '--- Context ' || n || ' (source: ' || source || ', pos: ' || doc_id || ') ---' || chr(10) || text || chr(10) AS block FROM g""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = _hits(spark, sf_dir).join(docs, "doc_id").select("query_id", "rank", "source", F.col("doc_id").alias("position"), "text")
    return view.context_blocks(rows)


@query(f"""
    WITH {_BM25}, r AS (SELECT query_id, doc_id, score, score / max(score) OVER (PARTITION BY query_id) AS ratio FROM bm)
    SELECT query_id, doc_id, score, round(ratio, 9) AS ratio, CASE WHEN ratio >= 0.66 THEN 'high' WHEN ratio >= 0.33 THEN 'mid' ELSE 'low' END AS bucket FROM r""")
def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.score_buckets(bm25_topk(spark, sf_dir).drop("rank")).withColumn("ratio", F.round("ratio", 9))


# -- vectors and signals ---------------------------------------------------------------------------------

_DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_SEM = f"""
    nn AS (SELECT a.vec_id AS a, b.vec_id AS b, {_DOT.format(a="a.embedding", b="b.embedding")} AS s FROM embeddings a, embeddings b),
    kn AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM nn) WHERE r <= 8 AND a <> b AND s >= {THRESHOLD}),
    sem AS (SELECT least(a, b) AS i, greatest(a, b) AS j, max(s) AS score FROM kn GROUP BY 1, 2)"""


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.semantic(_vectors(spark, sf_dir), 7, THRESHOLD)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _once(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read again: what several steps of a query read is computed once."""
    path = _scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query(f"WITH {_SEM} SELECT 'semantic' AS signal, i, j, round(score, 9) AS score FROM sem")
def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _semantic(spark, sf_dir).withColumn("score", F.round("score", 9))


@query("""
    WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations)
    SELECT DISTINCT 'adjacency' AS signal, id AS i, id + 1 AS j, CAST(1.0 AS DOUBLE) AS score FROM c WHERE nt = turn + 1""")
def adjacency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as chunks of a document."""
    turns = t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_idx"), F.lit("c").alias("source"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"))
    return signals.adjacency(turns)


_PATH = r"list_filter(string_split_regex(regexp_replace(url, '^[a-z]+://', ''), '[/?#]'), lambda p: p <> '')[1:3]"


@query(f"""
    WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), x AS (SELECT page_id, len(path) AS l, path[1:d] AS prefix FROM (SELECT *, unnest(range(1, len(path) + 1)) AS d FROM p)),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY page_id) AS nth FROM x) WHERE nth <= 100)
    SELECT 'section' AS signal, a.page_id AS i, b.page_id AS j, max(len(a.prefix) / greatest(a.l, b.l, 1)) AS score FROM k a JOIN k b ON a.prefix = b.prefix AND a.page_id < b.page_id GROUP BY 2, 3""")
def section_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as heading paths."""
    return signals.section(t(spark, sf_dir, "pages").select(F.col("page_id").alias("chunk_idx"), url_section_path(F.col("url")).alias("section_path")))


_TERMS = """
    e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
    el AS (SELECT doc_id, term FROM e WHERE length(term) >= 8),
    ek AS (SELECT term FROM el GROUP BY term HAVING count(*) >= 2),
    er AS (SELECT doc_id AS id, term FROM el JOIN ek USING (term)),
    ep AS (SELECT a.id AS i, b.id AS j, CAST(count(*) AS DOUBLE) AS n FROM er a JOIN er b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2),
    ent AS (SELECT i, j, n / max(n) OVER () AS score FROM ep)"""


def _entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of eight letters or more that are in two documents at least; scores rounded to nine places."""
    terms = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_idx"), F.explode(F.array_distinct(tx.tokenize(F.col("text")))).alias("key")).where(F.length("key") >= 8)
    return signals.shared_keys(terms, "entity", 2, digits=9, store=lambda df: _once(spark, df, "terms"))


@query(f"WITH {_TERMS} SELECT 'entity' AS signal, i, j, round(score, 9) AS score FROM ent")
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity(spark, sf_dir)


@query("""
    WITH h AS (SELECT DISTINCT page_id AS id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS key FROM pages),
    k AS (SELECT key FROM h GROUP BY key HAVING count(*) >= 2), r AS (SELECT h.* FROM h JOIN k USING (key)),
    p AS (SELECT a.id AS i, b.id AS j, CAST(count(*) AS DOUBLE) AS n FROM r a JOIN r b ON a.key = b.key AND a.id < b.id GROUP BY 1, 2)
    SELECT 'citation' AS signal, i, j, n / max(n) OVER () AS score FROM p""")
def citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that pages share."""
    keys = t(spark, sf_dir, "pages").select(F.col("page_id").alias("chunk_idx"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("key"))
    return signals.shared_keys(keys, "citation", 2, store=lambda df: _once(spark, df, "links"))


@query()
def utility_question_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentences of benchmark passages as questions."""
    p = default_providers(64)
    rows = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_idx"), F.posexplode(p.questions(F.col("text"), 2)).alias("n", "q"))
    return signals.utility_question(rows.select((F.col("chunk_idx") * 8 + F.col("n")).alias("question_id"), "chunk_idx", p.embed(F.col("q"), "document").alias("embedding")), 20, 0.3)


_SEQ = "adj AS (SELECT vec_id AS i, vec_id + 1 AS j, 1.0 AS score FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings))"
_LAB = "lab AS (SELECT a.vec_id AS i, b.vec_id AS j, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.5 END AS score FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3)"
_COMB = f"""{_SEM}, {_SEQ}, {_LAB},
    rawx AS (SELECT 'semantic' AS signal, i, j, score FROM sem UNION ALL SELECT 'adjacency', i, j, score FROM adj UNION ALL SELECT 'section', i, j, score FROM lab),
    rng AS (SELECT signal, min(score) AS lo, max(score) AS hi FROM rawx GROUP BY signal),
    nrm AS (SELECT signal, i, j, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS x FROM rawx JOIN rng USING (signal)),
    wide AS (SELECT i, j, coalesce(max(x) FILTER (signal = 'semantic'), 0) AS semantic, coalesce(max(x) FILTER (signal = 'section'), 0) AS section, coalesce(max(x) FILTER (signal = 'adjacency'), 0) AS adjacency FROM nrm GROUP BY i, j),
    comb AS (SELECT i AS src, j AS dst, semantic, section, adjacency, 0.15 * semantic + 0.2 * section + 0.1 * adjacency AS weight FROM wide WHERE 0.15 * semantic + 0.2 * section + 0.1 * adjacency >= 0.1)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three signals over one key space: nearest vectors, neighbours in id order, and like labels nearby."""
    v = t(spark, sf_dir, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("i"), F.col("vec_id").alias("j"))
    adjacency = v.select(F.col("vec_id").alias("i")).join(after, "i").select(F.lit("adjacency").alias("signal"), "i", "j", F.lit(1.0).alias("score"))
    near = v.select(F.col("vec_id").alias("i"), F.col("label").alias("li"), F.explode(F.array(*(F.col("vec_id") + d for d in (1, 2, 3)))).alias("j"))
    like = near.join(v.select(F.col("vec_id").alias("j"), F.col("label").alias("lj")), "j")
    section = like.select(F.lit("section").alias("signal"), "i", "j", F.when(F.col("li") == F.col("lj"), 1.0).otherwise(0.5).alias("score"))
    return _once(spark, _semantic(spark, sf_dir).unionByName(adjacency).unionByName(section), "raw-edges")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.combine(_raw(spark, sf_dir))


@query(f"WITH {_COMB} SELECT src, dst, round_even(weight, 4) AS weight, round_even(semantic, 4) AS semantic, round_even(section, 4) AS section, round_even(adjacency, 4) AS adjacency FROM comb")
def minmax_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.combine(_raw(spark, sf_dir)).select("src", "dst", "weight", "semantic", "section", "adjacency")


_EDGE_SQL = f"{_SEM}, edge AS (SELECT i AS src, j AS dst, score AS weight FROM sem), node AS (SELECT vec_id AS id FROM embeddings)"


def _sem_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = _once(spark, _semantic(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("score").alias("weight")), "semantic-edges")
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), edges


@query(f"WITH {_EDGE_SQL}, e AS (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge), d AS (SELECT id, count(*) AS degree FROM e GROUP BY id) SELECT id, coalesce(degree, 0) AS degree FROM node LEFT JOIN d USING (id) ORDER BY degree DESC, id LIMIT 50")
def degree_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_by_degree(*_sem_graph(spark, sf_dir), 50)


@query(f"""
    WITH {_EDGE_SQL}, e AS (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge), d AS (SELECT id, count(*) AS degree FROM e GROUP BY id),
    top AS (SELECT id FROM node LEFT JOIN d USING (id) ORDER BY coalesce(degree, 0) DESC, id LIMIT 200)
    SELECT src, dst, round(weight, 9) AS weight FROM edge WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)""")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph induced by the 200 nodes with most edges."""
    nodes, edges = _sem_graph(spark, sf_dir)
    return graph.induced(edges, graph.top_by_degree(nodes, edges, 200)).select("src", "dst", F.round("weight", 9).alias("weight"))


@query(f"WITH {_EDGE_SQL} SELECT (SELECT count(*) FROM node) AS node_count, (SELECT count(*) FROM edge) AS edge_count, (SELECT count(*) FROM node) > 0 AS has_data")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counts(*_sem_graph(spark, sf_dir))


@query(f"""
    WITH {_EDGE_SQL}, b AS (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge)
    SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ' ') AS neighbours FROM b GROUP BY src""")
def neighbour_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shared_neighbours(_sem_graph(spark, sf_dir)[1]).select("src", F.array_join("neighbours", " ").alias("neighbours"))


@query(f"""
    WITH {_EDGE_SQL}, b AS (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge),
    h0 AS (SELECT id AS query_id, id, 0 AS hop FROM node WHERE id % 20 = 0),
    u1 AS (SELECT query_id, id, min(hop) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT query_id, dst, 1 FROM h0 JOIN b ON b.src = h0.id) GROUP BY 1, 2),
    c1 AS (SELECT query_id, id, hop FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, id) AS n FROM u1) WHERE n <= 200),
    u2 AS (SELECT query_id, id, min(hop) AS hop FROM (SELECT * FROM c1 UNION ALL SELECT query_id, dst, 2 FROM c1 JOIN b ON b.src = c1.id WHERE hop = 1) GROUP BY 1, 2)
    SELECT query_id, id, CAST(hop AS INTEGER) AS hop FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hop, id) AS n FROM u2) WHERE n <= 200""")
def bfs_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node whose id is divisible by 20 is the seed of a query of its own."""
    nodes, edges = _sem_graph(spark, sf_dir)
    return graph.expand(nodes.where("id % 20 = 0").select(F.col("id").alias("query_id"), "id"), edges, 2, 200)


@query(f"""
    WITH {_COMB}, s AS (SELECT signal, count(*) AS pairs, CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(count(*)) * stddev_pop(score) END AS importance FROM rawx GROUP BY signal)
    SELECT signal, pairs, round(importance, 6) AS importance FROM s""")
def signal_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.informativeness(_raw(spark, sf_dir)).withColumn("importance", F.round("importance", 6))


@query(f"""
    WITH {_COMB}, b AS (SELECT signal, i, j, max(score) AS score FROM rawx GROUP BY ALL),
    s AS (SELECT signal, CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(count(*)) * stddev_pop(score) END AS x FROM b GROUP BY signal),
    f AS (SELECT signal, greatest(0.01, x / sum(x) OVER ()) AS w FROM s WHERE x > 0),
    n AS (SELECT unnest(['semantic', 'section', 'entity', 'adjacency', 'utility_question', 'citation']) AS signal)
    SELECT n.signal, round(coalesce(w / sum(w) OVER (), 0), 9) AS weight FROM n LEFT JOIN f USING (signal)""")
def calibrate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = weights.calibrate(_raw(spark, sf_dir)).as_dict()
    return spark.createDataFrame([(s, round(w, 9)) for s, w in got.items()], "signal string, weight double")


@query()
def fit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, auc = weights.fit(_raw(spark, sf_dir), t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))
    return spark.createDataFrame([(s, w, auc) for s, w in got.as_dict().items()], "signal string, weight double, auc double")


# -- retrieval -------------------------------------------------------------------------------------------

_DENSE = f"""
    dn AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_idx, {_DOT.format(a="q.embedding", b="c.embedding")} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
    dk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx) - 1 AS rank FROM dn)"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The vectors whose id is divisible by 20 as queries over all."""
    v = _vectors(spark, sf_dir)
    return retrieval.dense_ranking(v.where("chunk_idx % 20 = 0").withColumnRenamed("chunk_idx", "query_id"), v, k)


@query(f"WITH {_DENSE} SELECT query_id, chunk_idx, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM dk WHERE rank < 20")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 20).withColumn("score", F.round("score", 9))


_LISTS = f"""{_DENSE},
    qh AS (SELECT query_id, chunk_idx // 2 AS chunk_idx, min(rank) AS best FROM dk WHERE rank < 80 GROUP BY 1, 2),
    qr AS (SELECT query_id, chunk_idx, row_number() OVER (PARTITION BY query_id ORDER BY best, chunk_idx) - 1 AS rank FROM qh),
    ls AS (SELECT query_id, chunk_idx, rank, 0 AS list_no FROM dk WHERE rank < 20 UNION ALL SELECT query_id, chunk_idx, rank, 1 FROM qr WHERE rank < 20),
    fu AS (SELECT query_id, chunk_idx, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS rrf, min(list_no * 1000 + rank) AS f FROM ls GROUP BY 1, 2)"""


def _question_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as questions: two belong to each chunk."""
    owner = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.floor(F.col("vec_id") / 2).alias("chunk_idx"))
    return retrieval.question_ranking(_dense(spark, sf_dir, 80).withColumnRenamed("chunk_idx", "question_id"), owner, 20)


@query(f"WITH {_LISTS} SELECT query_id, chunk_idx, CAST(rank AS INTEGER) AS rank FROM qr WHERE rank < 20")
def question_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _question_hits(spark, sf_dir)


@query(f"WITH {_LISTS} SELECT query_id, chunk_idx, rrf, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f, chunk_idx) AS rank FROM fu) WHERE rank <= 20")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rrf([_dense(spark, sf_dir, 20), _question_hits(spark, sf_dir)], 20)


@query()
def hybrid_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries over all documents, by hashed words and by BM25."""
    docs, asked, embed = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark"), default_providers(64).embed
    chunks = docs.select(F.col("doc_id").alias("chunk_idx"), embed(F.col("text"), "document").alias("embedding"))
    queries = asked.select(F.col("item_id").alias("query_id"), embed(F.col("text"), "query").alias("embedding"))
    dense = retrieval.dense_scores(queries, chunks)
    lex = lexical.bm25_scores(docs, asked, "doc_id", "text", "item_id", "text").withColumnRenamed("doc_id", "chunk_idx")
    return retrieval.hybrid_relevance(dense, lex, store=lambda df: _once(spark, df, "pairs")).withColumn("score", F.round("score", 9))


# -- spectral and diffusion ------------------------------------------------------------------------------

_SEEDS = f"""
    {_DENSE}, se AS (SELECT query_id, chunk_idx AS sid, score AS rel FROM dk WHERE rank < 5), ca AS (SELECT query_id, chunk_idx AS id FROM dk WHERE rank < 100),
    un AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt({_DOT.format(a="embedding", b="embedding")})) AS v FROM embeddings),
    pr AS (SELECT ca.query_id, ca.id, greatest(se.rel, 0) AS w, {_DOT.format(a="a.v", b="b.v")} AS c FROM ca JOIN un a ON a.id = ca.id JOIN se USING (query_id) JOIN un b ON b.id = se.sid)"""


def _proximity(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    ranked = _dense(spark, sf_dir, 100)
    seeds = ranked.where("rank < 5").select("query_id", F.col("chunk_idx").alias("id"), F.col("score").alias("relevance"))
    coords = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return diffusion.seed_proximity(ranked.select("query_id", F.col("chunk_idx").alias("id")), seeds, coords, mode)


def _scaled(value: str) -> str:
    return f"WITH {_SEEDS}, ag AS (SELECT query_id, id, greatest({value}, 0) AS p FROM pr GROUP BY 1, 2) SELECT query_id, id, round(p / max(p) OVER (PARTITION BY query_id), 9) AS proximity FROM ag"


@query(_scaled("max(c)"))
def seed_proximity_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proximity(spark, sf_dir, "max").withColumn("proximity", F.round("proximity", 9))


@query(_scaled("list_avg(list_reverse_sort(list(c))[1:3])"))
def seed_proximity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proximity(spark, sf_dir, "topk_mean").withColumn("proximity", F.round("proximity", 9))


@query(_scaled("sum(c * w) / sum(w)"))
def seed_proximity_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proximity(spark, sf_dir, "relevance_weighted").withColumn("proximity", F.round("proximity", 9))


@query(f"""
    WITH {_SEEDS}, ag AS (SELECT query_id, id, greatest(max(c), 0) AS p FROM pr GROUP BY 1, 2), sc AS (SELECT query_id, id, p / max(p) OVER (PARTITION BY query_id) AS proximity FROM ag)
    SELECT query_id, id, round(0.5 * score + 0.5 * proximity, 9) AS score FROM sc JOIN dk ON dk.query_id = sc.query_id AND dk.chunk_idx = sc.id""".replace("SELECT query_id, id, round(0.5", "SELECT sc.query_id, sc.id, round(0.5"))
def diffuse_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _dense(spark, sf_dir, 100).select("query_id", F.col("chunk_idx").alias("id"), "score")
    return diffusion.diffuse(ranked, _proximity(spark, sf_dir, "max")).select("query_id", "id", F.round("score", 9).alias("score"))


@query(f"""
    WITH {_EDGE_SQL}, b AS (SELECT src, dst, weight FROM edge UNION ALL SELECT dst, src, weight FROM edge), d AS (SELECT src AS id, sum(weight) AS d FROM b GROUP BY src)
    SELECT src AS i, dst AS j, round(-weight / sqrt(x.d * y.d), 9) AS value FROM b JOIN d x ON x.id = src JOIN d y ON y.id = dst UNION ALL SELECT id, id, 1.0 FROM d""")
def laplacian_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _sem_graph(spark, sf_dir)
    return spectral.laplacian(nodes, edges).withColumn("value", F.round("value", 9))


def _coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _sem_graph(spark, sf_dir)
    placed = nodes.select("id", F.col("id").alias("position"), F.lit(nodes.count()).alias("doc_size"))
    return spectral.coordinates(placed, spectral.laplacian(nodes, edges), 8)


@query()
def spectral_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coords(spark, sf_dir)


@query()
def multiplex_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    entries = spectral.multiplex(nodes, _raw(spark, sf_dir), {"semantic": 0.5, "section": 0.3, "adjacency": 0.2})
    return spectral.coordinates(nodes.select("id", F.col("id").alias("position"), F.lit(nodes.count()).alias("doc_size")), entries, 8)


@query()
def kmeans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.cluster_labels(_coords(spark, sf_dir))


@query()
def ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _sem_graph(spark, sf_dir)
    seeds = nodes.where("id % 20 = 0").select(F.col("id").alias("query_id"), "id")
    return diffusion.ppr_proximity(graph.expand(seeds, edges), seeds, edges)


# -- views, sources, sessions ----------------------------------------------------------------------------


@query("""
    WITH x AS (SELECT unnest(range(len(embedding))) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), s AS (SELECT CAST(dim AS INTEGER) AS dim, var_pop(v) AS variance FROM x GROUP BY dim)
    SELECT dim, round(variance, 12) AS variance, CAST(row_number() OVER (ORDER BY round(variance, 12) DESC, dim) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""")
def axis_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = vx.axis_variance(t(spark, sf_dir, "embeddings").select(F.col("embedding").alias("v")))
    return got.withColumn("variance", F.round("variance", 12))


@query(f"""
    WITH {_COMB} SELECT src, dst, CASE WHEN greatest(semantic, section, adjacency) = 0 THEN NULL WHEN semantic = greatest(semantic, section, adjacency) THEN 'semantic'
        WHEN section = greatest(semantic, section, adjacency) THEN 'section' ELSE 'adjacency' END AS dominant FROM (SELECT src, dst, round_even(semantic, 4) AS semantic, round_even(section, 4) AS section, round_even(adjacency, 4) AS adjacency FROM comb)""")
def dominant_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.edge_view(_graph(spark, sf_dir)).select("src", "dst", "dominant")


@query(f"""
    WITH {_COMB}, r AS (SELECT src, dst, round_even(semantic, 4) AS semantic, round_even(section, 4) AS section, round_even(adjacency, 4) AS adjacency FROM comb),
    u AS (SELECT src, dst, 'semantic' AS signal, semantic AS value FROM r UNION ALL SELECT src, dst, 'section', section FROM r UNION ALL SELECT src, dst, 'adjacency', adjacency FROM r)
    SELECT src, dst, CAST(row_number() OVER (PARTITION BY src, dst ORDER BY value DESC, signal DESC) AS INTEGER) AS place, signal, value FROM u WHERE value > 0""")
def signal_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = view.signal_breakdown(_graph(spark, sf_dir)).select("src", "dst", F.posexplode("breakdown").alias("pos", "part"))
    return parts.select("src", "dst", (F.col("pos") + 1).alias("place"), "part.signal", "part.value")


@query(f"""
    WITH {_EDGE_SQL}, e AS (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge), d AS (SELECT id, count(*) AS degree FROM e GROUP BY id),
    top AS (SELECT id, coalesce(degree, 0) AS degree FROM node LEFT JOIN d USING (id) ORDER BY coalesce(degree, 0) DESC, id LIMIT {View().max_nodes}),
    x AS (SELECT id, degree, CAST(embedding AS DOUBLE[]) AS c FROM top JOIN embeddings ON vec_id = id),
    a AS (SELECT dim, row_number() OVER (ORDER BY round(v, 12) DESC, dim) AS nth FROM (SELECT dim, var_pop(y) AS v FROM (SELECT unnest(range(len(c))) AS dim, unnest(c) AS y FROM x) GROUP BY dim))
    SELECT id, 'vector ' || id AS label, 'vector ' || id AS text, 'v' AS doc, id AS position, degree, c[(SELECT dim FROM a WHERE nth = 1) + 1] AS sx,
        c[(SELECT dim FROM a WHERE nth = 2) + 1] AS sy, c[(SELECT dim FROM a WHERE nth = 3) + 1] AS sz FROM x""")
def graph_nodes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _sem_graph(spark, sf_dir)
    chunks = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), F.concat(F.lit("vector "), F.col("vec_id")).alias("text"), F.lit("/v").alias("source"), F.lit("v").alias("doc_id"), F.col("vec_id").alias("position"), F.array().cast("array<string>").alias("section_path"), F.col("embedding").cast("array<double>").alias("coords"))
    every = edges.select("src", "dst", "weight", F.col("weight").alias("semantic"), *(F.lit(0.0).alias(s) for s in ("section", "entity", "adjacency", "utility_question", "citation")))
    return view.graph_payload(chunks, every)[0].drop("section_path")


@query("""
    SELECT conv_id, count(*) AS n_messages, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS n_user, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)::BIGINT AS n_assistant,
        arg_min(text, (turn, text)) AS first_text, arg_max(text, (turn, text)) AS last_text, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id""")
def conversation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_summary(t(spark, sf_dir, "conversations"))


# -- parsers, labels, stores ------------------------------------------------------------------------------


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\w+|[^\\w\\s]')) AS n_tokens FROM documents""")
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", tx.token_len(F.col("text")).alias("n_tokens"))


_ANSWERS = "'1. What is ' || source || '?' || chr(10) || '  - Who wrote ' || lang || '?' || chr(10) || '   ' || chr(10) || '* ' || CAST(doc_id AS VARCHAR) || ') why?' || chr(10) || 'more?'"


@query(f"""
    WITH r AS (SELECT doc_id, unnest(string_split({_ANSWERS}, chr(10))) AS line, generate_subscripts(string_split({_ANSWERS}, chr(10)), 1) AS nth FROM documents),
    c AS (SELECT doc_id, nth, trim(regexp_replace(trim(line), '^\\s*(?:\\d+[.)]|[-*•])\\s*', '')) AS q FROM r),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS k FROM c WHERE q <> '')
    SELECT doc_id, string_agg(q, '|' ORDER BY nth) AS questions, count(*) AS n FROM n WHERE k <= 3 GROUP BY doc_id""")
def parsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer made from columns: numbered and bulleted lines, a blank one, one too many."""
    got = tx.parse_questions(F.expr(_ANSWERS.replace("VARCHAR", "STRING")), 3)
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(got, "|").alias("questions"), F.size(got).cast("long").alias("n"))


_CONCEPTS = """CASE WHEN doc_id % 5 = 0 THEN 'no json' ELSE '{"concepts": [" ' || upper(lang) || '", "' || source || '", "' || lang || '", "", "doc ' || CAST(doc_id % 3 AS VARCHAR) || '"]}' END"""


@query("""
    WITH c AS (SELECT doc_id, unnest([lang, lower(trim(source)), 'doc ' || doc_id % 3]) AS term FROM documents WHERE doc_id % 5 <> 0),
    g AS (SELECT doc_id, list_sort(list(DISTINCT term)) AS terms FROM c GROUP BY doc_id)
    SELECT doc_id, coalesce(array_to_string(terms, '|'), '') AS concepts FROM documents LEFT JOIN g USING (doc_id)""")
def parsed_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of JSON answers, some of them unreadable."""
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.parse_concepts(F.expr(_CONCEPTS.replace("VARCHAR", "STRING"))), "|").alias("concepts"))


@query("""
    SELECT doc_id, trim(source) AS first, 'ORG' AS first_label, lower(trim(source)) AS first_normal, CAST(CASE WHEN lang = 'en' THEN 2 ELSE 3 END AS BIGINT) AS n FROM documents""")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of two extractors: the second's are taken where the first has none of that text and label."""
    source, lang = F.col("source"), F.col("lang")
    first = tx.parse_entities(F.concat(F.lit(" "), source, F.lit(" | ORG\nno separator\nEn|LANG")))
    second = tx.parse_entities(F.concat(source, F.lit("|ORG\n"), F.when(lang == "en", F.lit("En")).otherwise(lang), F.lit("|LANG")))
    every = merge_entities(first, second)
    one = every[0]
    return t(spark, sf_dir, "documents").select("doc_id", one["text"].alias("first"), one["label"].alias("first_label"), one["normalized"].alias("first_normal"), F.size(every).cast("long").alias("n"))


@query("""SELECT n_nationkey, trim(n_name) || ' | ' || n_regionkey || ' | ' || chr(10) || 'x | ' || n_nationkey AS md FROM nation""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of three rows, the second one blank."""
    cells = F.array(F.array(F.concat(F.lit(" "), F.col("n_name")), F.col("n_regionkey").cast("string"), F.lit(None).cast("string")), F.array(F.lit(" "), F.lit(None).cast("string")), F.array(F.lit("x"), F.col("n_nationkey").cast("string")))
    return t(spark, sf_dir, "nation").select("n_nationkey", tx.table_to_md(cells).alias("md"))


@query(f"""
    WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
    SELECT page_id, CASE WHEN page_id % 3 = 0 AND len(path) > 0 THEN path[-1] WHEN page_id % 3 = 1 THEN 'p' || page_id ELSE 'chunk ' || page_id END AS label FROM p""")
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heading, else the document, else a number."""
    third = F.col("page_id") % 3
    path = F.when(third == 0, url_section_path(F.col("url"))).otherwise(F.array().cast("array<string>"))
    doc = F.when(third == 1, F.concat(F.lit("p"), F.col("page_id")))
    return t(spark, sf_dir, "pages").select("page_id", tx.section_label(path, doc, F.col("page_id")).alias("label"))


@query("""SELECT page_id, lower(regexp_extract(url || '.HTML', '(\\.[^./]+)$', 1)) AS suffix FROM pages""")
def file_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", tx.suffix(F.concat("url", F.lit(".HTML"))).alias("suffix"))


@query(f"""
    WITH {_BM25}, k AS (SELECT query_id, doc_id, CAST(round(score * 1000000) AS BIGINT) AS k FROM bm)
    SELECT query_id, string_split(d.source, '/')[-1] AS source, (k // 100 + CASE WHEN k % 100 > 50 OR (k % 100 = 50 AND k // 100 % 2 = 1) THEN 1 ELSE 0 END) / 10000.0::DOUBLE AS score,
        substr(text, 1, 200) AS preview, text AS full_text, doc_id AS position FROM k JOIN documents d USING (doc_id)""")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = _hits(spark, sf_dir).join(docs, "doc_id").select("query_id", "source", F.lit(None).cast("int").alias("page"), "score", "text", F.col("doc_id").alias("position"), F.array().cast("array<string>").alias("section_path"))
    return view.source_list(rows).drop("section_path", "page")


@query(f"""
    WITH {_BM25}, b AS (SELECT bm.query_id, bm.doc_id, list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')) AS qt, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS dt
        FROM bm JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = bm.query_id)
    SELECT query_id, doc_id, round(CASE WHEN len(qt) > 0 THEN len(list_filter(qt, lambda x: list_contains(dt, x))) / len(qt) ELSE 0 END, 9) AS share FROM b""")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits with the share of the question's words that they have."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = _hits(spark, sf_dir).join(docs, "doc_id").join(asked, "query_id")
    return rows.select("query_id", "doc_id", F.round(overlap_reranker(F.col("question"), F.col("text")), 9).alias("share"))


@query("""
    WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM k WHERE length(term) >= 5 GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
    s AS (SELECT doc_id, term, round(tf * ln(CAST(n AS DOUBLE) / df), 9) AS s FROM c JOIN f USING (term), n WHERE df >= 2 AND df <= greatest(2, 0.2 * n)),
    r AS (SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, term) AS k FROM s) WHERE k <= 5)
    SELECT doc_id AS chunk_idx, array_to_string(list_sort(list(term)), ' ') AS terms FROM r GROUP BY doc_id""")
def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's five terms with the highest tf-idf."""
    got = tfidf_concepts(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_idx"), "text"))
    return got.select("chunk_idx", F.array_join("terms", " ").alias("terms"))


@query("""
    WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS sx, CAST(embedding[2] AS DOUBLE) AS sy FROM embeddings),
    s AS (SELECT min(sx) AS lx, max(sx) AS hx, min(sy) AS ly, max(sy) AS hy FROM p)
    SELECT id, round(((sx - lx) / (hx - lx) - 0.5) * 520, 6) AS x, round(((sy - ly) / (hy - ly) - 0.5) * 520, 6) AS y FROM p, s""")
def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("sx"), F.col("embedding")[1].cast("double").alias("sy"))
    return view.layout(points).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""
    WITH {_EDGE_SQL} SELECT 'node' AS part, id, CAST(-1 AS BIGINT) AS dst, CAST(0 AS DOUBLE) AS weight FROM node UNION ALL SELECT 'edge', src, dst, round(weight, 6) FROM edge
    UNION ALL SELECT 'totals', (SELECT count(*) FROM node), (SELECT count(*) FROM edge), 0""")
def graph_payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload's JSON, read again."""
    nodes, edges = _sem_graph(spark, sf_dir)
    rows = view.payload_rows(nodes, edges.withColumn("weight", F.round("weight", 6)), graph.counts(nodes, edges))
    got = F.from_json("json", "id long, src long, dst long, weight double, node_count long, edge_count long")
    return rows.select("part", got.alias("j")).select("part", F.coalesce("j.id", "j.src", "j.node_count").alias("id"), F.coalesce("j.dst", "j.edge_count", F.lit(-1)).alias("dst"), F.coalesce("j.weight", F.lit(0.0)).alias("weight"))


@query("""SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) AS total FROM embeddings""")
def checked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose length is looked at when they are read."""
    v = t(spark, sf_dir, "embeddings").select("vec_id", vx.checked(F.col("embedding"), 64).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 9).alias("total"))


@query("""
    SELECT source, doc_id, CAST(0 AS INTEGER) AS position, row_number() OVER (ORDER BY source, doc_id) - 1 AS chunk_idx FROM documents""")
def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered through in corpus order, without one global sort."""
    return chunking.numbered(t(spark, sf_dir, "documents").select("source", "doc_id", F.lit(0).alias("position")))


@query("""
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_user(t(spark, sf_dir, "events"))


@query(f"""
    WITH {_EDGE_SQL} SELECT 'chunk' AS part, doc_id AS a, CAST(-1 AS BIGINT) AS b, sha256(text) AS value FROM documents UNION ALL SELECT 'node', id, -1, '' FROM node
    UNION ALL SELECT 'edge', src, dst, CAST(CAST(round(weight * 1000000) AS BIGINT) AS VARCHAR) FROM edge""")
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and graph saved twice (another corpus first) and loaded: the last whole version counts."""
    store = IndexStore(spark, _scratch(spark, "index"))
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    nodes, edges = _sem_graph(spark, sf_dir)
    store.save(docs.limit(0), nodes.limit(0), edges.limit(0))
    store.save(docs, nodes, edges)
    none = F.lit(-1).cast("long")
    chunks = store.load().select(F.lit("chunk").alias("part"), F.col("doc_id").alias("a"), none.alias("b"), F.sha2("text", 256).alias("value"))
    ids = store.graph.nodes.select(F.lit("node"), "id", none, F.lit(""))
    return chunks.union(ids).union(store.graph.edges.select(F.lit("edge"), "src", "dst", F.round(F.col("weight") * 1000000).cast("long").cast("string")))


@query("""SELECT doc_id, substr(sha256('m|' || text), 1, 16) AS key, CAST(length(text) AS BIGINT) AS value FROM documents""")
def stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content cache: English texts first, then all; each distinct text is computed once."""
    cache = ValueCache(spark, _scratch(spark, "values"))
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", cache_key(F.col("text"), "m").alias("key"), "text")
    every = None
    for rows in (docs.where("lang = 'en'"), docs):
        every, new = cached(rows, cache.read(), lambda misses: misses.select("key", F.length("text").cast("long").alias("value")))
        cache.append(new)
    return docs.join(cache.read(), "key").select("doc_id", "key", "value")


@query("""
    SELECT CAST(conv_id AS VARCHAR) AS id, 'chat ' || conv_id AS name, CAST(count(*) + CASE WHEN conv_id = (SELECT min(conv_id) FROM conversations) THEN 2 ELSE 0 END AS BIGINT) AS n_messages
    FROM conversations GROUP BY conv_id""")
def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat sessions, one of which is continued."""
    store = SessionStore(spark, _scratch(spark, "sessions"))
    turns = t(spark, sf_dir, "conversations")
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    sessions = turns.groupBy("conv_id").agg(messages.alias("messages")).select(
        F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("chat "), "conv_id").alias("name"), F.lit(None).cast("timestamp").alias("created_at"), F.array().cast("array<string>").alias("docs"), F.lit(0).alias("chunk_count"), "messages"
    )
    store.save(sessions)
    store.append_exchange(str(turns.agg(F.min("conv_id")).first()[0]), "and then?", "that was all")
    return store.load().select("id", "name", F.size("messages").cast("long").alias("n_messages"))


@query()
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query()
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the chunker with the default settings."""
    return chunking.chunk_documents(documents_from_table(t(spark, sf_dir, "documents"))).drop("references", "section_path")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_activity(t(spark, sf_dir, "events"))


@query("""
    SELECT page_id, array_to_string(list_filter(string_split_regex(regexp_replace(url, '^[a-z]+://', ''), '[/?#]'), lambda p: p <> '')[1:3], '/') AS path, string_split(url, '/')[-1] AS basename FROM pages""")
def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", F.array_join(url_section_path(F.col("url")), "/").alias("path"), tx.basename(F.col("url")).alias("basename"))


@query("""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT vec_id, round(sqrt(list_inner_product(e, e)), 9) AS norm, round(list_sum(list_transform(e, lambda x: abs(x))) / sqrt(list_inner_product(e, e)), 9) AS l1_of_unit FROM v""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    unit = vx.l2_normalise(v)
    return t(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(vx.dot(v, v)), 9).alias("norm"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + F.abs(x)), 9).alias("l1_of_unit"))


