import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.config import Chunking, Config, Indexing
from weftline.operators import chunking
from weftline.operators.providers import cached, default_providers, hashed_words
from weftline.plans import view
from weftline.plans.pipeline import Engine
from weftline.sources import readers, stores
from weftline.streaming.ingest import ingest


def test_sections_and_stack_across_pages():
    items = [("# A\nbody one here\n## B\nmore text", 1, "prose"), ("still below b", 2, "prose")]
    got = list(chunking.chunk_document(items, Chunking(min_chunk_tokens=1, chunk_overlap=0, strategy="structural")))
    assert [(p, path, page) for p, path, page, _ in got] == [("# A\nbody one here", ["A"], 1), ("## B\nmore text", ["A", "B"], 1), ("still below b", ["A", "B"], 2)]


def test_pieces_stay_small_and_keep_all_words():
    text = " ".join(f"word{i}" for i in range(500)) + ". " + "x" * 300
    parts = chunking.split_recursively(text, 50, 0, chunking.count_tokens)
    assert max(map(chunking.count_tokens, parts)) <= 50
    assert "".join(parts).replace(" ", "") == text.replace(" ", "")


def test_overlap_tail_and_merge():
    assert chunking.sentence_tail("One here. Two there. Three now.", 4, chunking.count_tokens) == "Three now."
    assert chunking.sentence_tail("", 4, chunking.count_tokens) == ""
    assert chunking.merge_small(["a", "b c d e", "f"], 3, chunking.count_tokens) == ["a\nb c d e\nf"]


def test_tables_repeat_their_head():
    parts = chunking.split_table("h | k\n" + "\n".join(f"{i} | {i}" for i in range(30)), 20, chunking.count_tokens)
    assert len(parts) > 1 and all(p.startswith("h | k") for p in parts)
    got = list(chunking.chunk_document([("a | b", None, "table")], Chunking()))
    assert got == [("a | b", ["(table)"], None, "table")]


def test_semantic_split():
    embed = lambda s: np.array([[1.0, 0.0] if "cat" in x else [0.0, 1.0] for x in s])
    text = "The cat sat. A cat ran. One cat slept. The sun rose. The sun set."
    assert chunking.split_semantically(text, 100, 2, 90, chunking.count_tokens, embed) == ["The cat sat. A cat ran. One cat slept.", "The sun rose. The sun set."]


def test_spacing():
    assert chunking.join_spaced("H E L L O world, I am a s") == "HELLO world, I am a s"


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "b.html").write_text("<html><script>x()</script><p>Hello</p><nav>no</nav><p>there &amp; you</p></html>")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", doc)
    (tmp_path / "c.docx").write_bytes(buffer.getvalue())
    got = {r["doc_id"]: [(i["text"], i["kind"]) for i in r["items"]] for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a": [("plain � text", "prose")], "b": [("Hello\nthere & you", "prose")], "c": [("## Part\nText", "prose"), ("x | y", "table")]}


def test_chunk_ids_are_stable(spark):
    docs = readers.documents_from_table(spark.createDataFrame([(1, "s", "some text"), (2, "s", None)], "doc_id long, source string, text string"))
    got = chunking.chunk_documents(docs).collect()
    import hashlib

    assert [r["chunk_id"] for r in got] == [hashlib.sha256(b"s:1:0:some text").hexdigest()[:16]]


def test_numbered_is_dense_and_ordered(spark):
    rows = [("s", f"d{i % 7}", i // 7) for i in range(70)]
    got = chunking.numbered(spark.createDataFrame(rows, "source string, doc_id string, position int")).orderBy("chunk_idx").collect()
    assert [r["chunk_idx"] for r in got] == list(range(70))
    assert [(r["doc_id"], r["position"]) for r in got] == sorted((d, p) for _, d, p in rows)


def test_cache_computes_misses_once(spark):
    texts = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "key string, text string")
    cache = spark.createDataFrame([("b", 7)], "key string, value int")
    every, new = cached(texts, cache, lambda m: m.select("key", F.lit(1).alias("value")))
    assert sorted((r["key"], r["value"]) for r in every.collect()) == [("a", 1), ("a", 1), ("b", 7)] and new.count() == 1


def test_sessions(spark, tmp_path):
    store = stores.SessionStore(spark, str(tmp_path / "sessions"))
    assert store.load().count() == 0
    store.save(spark.createDataFrame([("1", "one", None, [], 0, None)], store.SCHEMA))
    store.append_exchange("1", "q", "a")
    assert [(m["role"], m["content"]) for m in store.load().first()["messages"]] == [("user", "q"), ("assistant", "a")]


def test_value_cache(spark, tmp_path):
    cache = stores.ValueCache(spark, str(tmp_path / "cache"))
    assert cache.read() is None
    cache.append(spark.createDataFrame([("k", 1)], "key string, value int"))
    assert cache.read().count() == 1


@pytest.mark.parametrize("mode", ["fixed", "calibrate"])
def test_index_and_query(spark, sf_dir, tmp_path, mode):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    config = Config(indexing=Indexing(edge_weight_mode=mode, semantic_threshold=0.3, spectral_components=4), embedding_dim=64)
    engine = Engine(spark, str(tmp_path / "index"), config)
    with pytest.raises(FileNotFoundError):
        engine.store.load()
    engine.index(readers.documents_from_table(docs))
    chunks = engine.store.load()
    assert chunks.where("cluster_label < 0").count() == 0 and chunks.select(F.max("chunk_idx")).first()[0] == chunks.count() - 1
    text = docs.where("doc_id = 7").first()["text"]
    asked = spark.createDataFrame([(1, text[50:250]), (2, "nothing of the kind")], "query_id long, question string")
    context = engine.retrieve(asked).collect()
    found = sorted((r for r in context if r["query_id"] == 1), key=lambda r: r["rank"])
    assert "7" in [r["doc_id"] for r in found[:3]] and sum(r["tokens"] for r in found) <= 12000
    answers = {r["query_id"]: r for r in engine.query(asked).collect()}
    assert "=== Source:" in answers[1]["context"] and answers[1]["answer"]
    nodes, edges, totals = view.graph_payload(chunks, engine.store.graph.edges)
    assert nodes.count() == min(200, chunks.count()) and totals.first()["has_data"]


def test_empty_corpus_is_an_error(spark, tmp_path):
    empty = readers.documents_from_table(spark.createDataFrame([], "doc_id long, source string, text string"))
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "none")).index(empty)


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    landing, target = str(tmp_path / "landing"), str(tmp_path / "chunks")
    schema = "doc_id long, source string, text string"
    for rows in ([(1, "s", "first text")], [(1, "s", "first text"), (2, "s", "second text")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)
        ingest(spark, landing, schema, target, str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_providers_are_deterministic(spark):
    p = default_providers(32)
    rows = spark.createDataFrame([("The quick brown fox. It met Ada Lovelace there, with Grace Hopper.",), (None,)], "t string")
    a, b = (rows.select(p.embed(F.col("t"), "document").alias("v"), p.entities(F.col("t")).alias("e")).collect() for _ in range(2))
    assert a == b and [e["text"] for e in a[0]["e"]] == ["Ada Lovelace", "Grace Hopper"]


def test_settings_from_the_environment():
    from weftline.config import from_env

    c = from_env(env={"WEFTLINE_RETRIEVAL_SEED_K": "30", "WEFTLINE_RETRIEVAL_BACKFILL": "false", "WEFTLINE_FALLBACK_LANGUAGE": "de"})
    assert (c.retrieval.seed_k, c.retrieval.backfill, c.fallback_language, c.retrieval.hops) == (30, False, "de", 2)


def test_missing_vectors_are_an_error(spark):
    from weftline.operators.providers import require_embedded

    rows = spark.createDataFrame([(1, None)], "chunk_idx long, embedding array<float>")
    with pytest.raises(Exception, match="has no embedding"):
        require_embedded(rows).collect()


def test_command_line(spark, tmp_path, capsys):
    from weftline.__main__ import main

    for i in range(6):
        (tmp_path / f"d{i}.txt").write_text(f"Topic{i} is about number {i}. " * 20)
    assert main(["index", str(tmp_path / "ix"), *(str(tmp_path / f"d{i}.txt") for i in range(6))]) == 0
    assert main(["query", str(tmp_path / "ix"), "What is topic3 about?"]) == 0
    assert "Topic3" in capsys.readouterr().out


def test_sessions_survive_a_writer_that_fails(spark, tmp_path, monkeypatch):
    store = stores.SessionStore(spark, str(tmp_path / "sessions"))
    store.save(spark.createDataFrame([("1", "one", None, [], 0, None), ("2", "two", None, [], 0, None)], store.SCHEMA))
    seen = store.load()
    monkeypatch.setattr(store.versions, "commit", lambda version: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.save(seen.limit(0))
    with pytest.raises(RuntimeError):
        store.append_exchange("1", "q", "a")
    monkeypatch.undo()
    assert store.load().count() == 2 and seen.count() == 2
    store.append_exchange("2", "q", "a")
    store.append_exchange("2", "q2", "a2")
    got = {r["id"]: len(r["messages"] or []) for r in store.load().collect()}
    assert got == {"1": 0, "2": 4}
    with pytest.raises(KeyError):
        store.append_exchange("3", "q", "a")
    store.save(store.load())  # all in one version again
    assert {r["id"]: len(r["messages"] or []) for r in store.load().collect()} == got


def test_index_versions(spark, tmp_path):
    store = stores.IndexStore(spark, str(tmp_path / "ix"))
    frame = lambda n: spark.range(n).withColumnRenamed("id", "chunk_idx")
    nodes, edges = spark.range(2), spark.createDataFrame([(0, 1, 0.5)], "src long, dst long, weight double")
    store.save(frame(3), nodes, edges)
    old = store.load()
    version = store.versions.begin()
    frame(9).write.parquet(f"{version}/chunks")  # a writer that is not done
    assert store.load().count() == 3
    store.save(frame(5), nodes, edges)
    assert store.load().count() == 5 and old.count() == 3 and store.graph.edges.count() == 1


def test_batches_retries_and_dimensions():
    from weftline.operators.providers import in_batches

    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 2:
            raise OSError("busy")
        return np.ones((len(texts) - (len(calls) == 4), 3))

    got = in_batches([str(i) for i in range(70)], flaky, 32, 3, 0)
    assert got.shape == (70, 3) and calls == [32, 32, 32, 6, 6] and np.allclose(np.linalg.norm(got, axis=1), 1)
    with pytest.raises(ValueError):
        in_batches(["a"], lambda t: np.ones((2, 3)), 32, 2, 0)
    with pytest.raises(ValueError):
        in_batches(["a", "b"], lambda t: np.ones((1, 3 + (t == ["b"]))), 1, 1, 0)


def test_engine_keeps_values_and_runs_apart(spark, tmp_path):
    """Vectors and concepts are computed once for each text; a second question leaves the first one's answer readable."""
    from dataclasses import replace

    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embed(text):
        seen.add(1)
        return [float(len(text)), 1.0]

    @F.udf("array<string>")
    def concepts(text):
        return None if "third" in text else sorted({w for w in text.lower().split() if len(w) > 5})

    p = replace(default_providers(8), embed=lambda text, kind="document": embed(text), text_concepts=concepts, model="m", more_entities=lambda x: F.array(F.struct(F.lit("Ada").alias("text"), F.lit("PER").alias("label"), F.lit("ada").alias("normalized"))))
    docs = readers.documents_from_table(spark.createDataFrame([(1, "s", "Mention of spectral graphs here."), (2, "s", "Spectral graphs again mention."), (3, "s", "A third text.")], "doc_id long, source string, text string"))
    engine = Engine(spark, str(tmp_path / "ix"), Config(indexing=Indexing(spectral_components=2), embedding_dim=2), p)
    engine.index(docs)
    first = seen.value
    kept = spark.read.parquet(f"{engine.path}/cache/concepts")
    assert kept.count() == 2 and spark.read.parquet(f"{engine.path}/cache/embeddings").count() == 3
    engine.index(docs)
    assert spark.read.parquet(f"{engine.path}/cache/embeddings").count() == 3 and seen.value - first < first
    asked = lambda q: spark.createDataFrame([(1, q)], "query_id long, question string")
    one, two = engine.query(asked("spectral graphs?")), engine.query(asked("a third?"))
    a, b = one.first(), two.first()
    assert a["question"] == "spectral graphs?" and b["question"] == "a third?"
    assert a["prompt"]["user"].endswith("\nQuestion: spectral graphs?\n\nAnswer:") and "English" in a["prompt"]["system"]
    engine.clean()
    names = spark.range(1).select(p.all_entities(F.lit("so Grace Hopper came. met Grace Hopper")).alias("e")).first()["e"]
    assert {e["text"] for e in names} == {"Grace Hopper", "Ada"}


def test_sentences_are_embedded_where_texts_have_no_headings(spark):
    docs = readers.documents_from_table(spark.createDataFrame([(1, "s", " ".join(f"Cats purr softly number{i}." for i in range(30)) + " " + " ".join(f"Stocks fell sharply number{i}." for i in range(30)))], "doc_id long, source string, text string"))
    settings = Chunking(chunk_size=400, min_chunk_tokens=20)
    plain, cut = ([r["text"] for r in chunking.chunk_documents(docs, settings, embed=e).orderBy("position").collect()] for e in (None, hashed_words(64)))
    assert len(cut) > 1 and cut != plain and all(f"{a} number{i}." in " ".join(cut) for a in ("softly", "sharply") for i in range(30))
