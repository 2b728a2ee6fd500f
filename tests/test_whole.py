"""Registered queries over whole tables: small tables against plain recomputation, without caps or subsets."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from weftline.operators import lexical, signals
from weftline.operators.providers import default_providers
from weftline.plans.registry import QUERIES


def shared_by_hand(keys):
    """keys: id -> set; scores of all pairs that share a key."""
    members = {k: sorted(i for i, ks in keys.items() if k in ks) for k in set().union(*keys.values())}
    n = Counter(p for ids in members.values() for p in combinations(ids, 2))
    return {p: c / max(n.values()) for p, c in n.items()}


def edges_of(df):
    return {(r["i"], r["j"]): r["score"] for r in df.collect()}


@pytest.mark.parametrize("block", [7, 512])
def test_citation_links_all_pages_of_a_link(spark, tmp_path, monkeypatch, block):
    """A link on 70 pages joins all of them, in blocks as in one piece."""
    monkeypatch.setattr(signals, "PAIR_BLOCK", block)
    keys = {i: {"/hot"} | ({"/warm"} if i >= 60 else set()) | {f"/own{i}"} for i in range(70)}
    rows = [(i, f"http://x.org/{i}", "".join(f'<a href="{k}">a</a>' * 2 for k in sorted(ks))) for i, ks in keys.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = edges_of(QUERIES["citation_edges"](spark, str(tmp_path)))
    assert len(got) == 70 * 69 // 2 and got == pytest.approx(shared_by_hand(keys))


def test_entity_links_terms_of_many_documents(spark, tmp_path):
    """A term in 14 documents links them all; short terms and those of one document link nothing."""
    keys = {i: {"frequency"} | ({"rareterm"} if i < 3 else set()) | {f"unshared{i}"} for i in range(14)}
    rows = [(i, " ".join(["tiny", *sorted(ks), *sorted(ks)])) for i, ks in keys.items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = edges_of(QUERIES["entity_edges"](spark, str(tmp_path)))
    assert len(got) == 14 * 13 // 2 and got == pytest.approx(shared_by_hand(keys))


def test_ppr_has_each_seed(spark, sf_dir):
    asked = {r["query_id"] for r in QUERIES["ppr"](spark, sf_dir).select("query_id").distinct().collect()}
    assert asked == {r["vec_id"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}


def test_hybrid_relevance_blends_bm25_of_all_pairs(spark, sf_dir):
    docs, asked = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    embed = default_providers(64).embed
    vectors = lambda df, i: {r[0]: np.array(r[1], np.float64) for r in df.select(i, embed(df["text"])).collect()}
    x, q = vectors(docs, "doc_id"), vectors(asked, "item_id")
    lex = {(r["query_id"], r["doc_id"]): max(r["score"], 0.0) for r in lexical.bm25_scores(docs, asked, "doc_id", "text", "item_id", "text").collect()}
    want = {}
    for k, v in q.items():
        dense, high = {i: float(v @ w) for i, w in x.items()}, max(lex.get((k, i), 0.0) for i in x)
        top = max(dense.values())
        assert high > 0 and top > 0
        want |= {(k, i): 0.7 * d / top + 0.3 * lex.get((k, i), 0.0) / high for i, d in dense.items()}
    got = {(r["query_id"], r["chunk_idx"]): r["score"] for r in QUERIES["hybrid_relevance"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8
