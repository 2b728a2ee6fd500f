import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import linear, quality, toxicity
from weftline.llm.common import crc_fold

RNG = np.random.default_rng(3)
WORDS = [a + b + c for a in ("th", "er", "on", "an", "re") for b in ("ing", "tion", "at", "ou", "es", "nd") for c in ("", "a", "le", "or", "in", "ust", "ea", "wh", "ly")]


def prose(n):
    return " ".join(RNG.choice(WORDS, n)).capitalize() + "."


def corpus():
    """Texts with labels: shouting and signs are bad, some words and beginnings are toxic."""
    rows = []
    for i in range(900):
        text = prose(40)
        bad, toxic = i % 6 == 0, i % 8 == 1
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 12 else " ".join(w + "$$$" for w in text.split())
        if toxic:
            text += " " + ("you blockhead" if i % 16 == 1 else "grumblix" + WORDS[i % 30] + " grumblix" + WORDS[i % 7])
        rows.append((i, text, int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", 0.5, 1, 2) for i, t, _, _ in rows] + [(5000, None, "en", 0.5, 1, 2), (5001, "", "en", 0.5, 1, 2), (0, rows[0][1], "en", 0.5, 1, 2)], "doc_id long, text string, lang string, score double, label int, predicted int")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(3, None, None), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_folds(spark):
    df = spark.range(50).select(F.col("id"), crc_fold("id", 7).alias("f"))
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in df.collect())


def test_ftrl_learns_and_is_sparse():
    x = [np.array([0, 2]) if i % 2 else np.array([1, 2]) for i in range(200)]
    m = linear.Ftrl(5, l1=0.5).fit([(a, np.ones(2)) for a in x], np.array([i % 2 for i in range(200)]), 3)
    w = m.weights()
    assert w[0] > 0 > w[1] and w[3] == w[4] == 0


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(tables, kind):
    docs, labels, rows = tables
    scores, truth, fold, held = (quality.quality_scores, 2, 4, 2) if kind == "quality" else (toxicity.toxicity_scores, 3, 3, 1)
    got = scores(docs, labels).collect()
    assert len(got) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == held) for r in got)
    known = {r[0]: r[truth] for r in rows}
    test = [r for r in got if r["held_out"] and r["doc_id"] in known]
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in test]) >= 0.97
    same = [r["score"] for r in got if r["doc_id"] == 0]
    assert len(same) == 2 and same[0] == same[1]
    assert len({r["score"] for r in got if r["doc_id"] >= 5000}) == 1


def test_filters_keep_whole_rows(tables):
    docs, labels, _ = tables
    for kept, scored, keep in ((quality.quality_filter(docs, labels), quality.quality_scores(docs, labels), 1), (toxicity.toxicity_filter(docs, labels), toxicity.toxicity_scores(docs, labels), 0)):
        want = sorted(r["doc_id"] for r in scored.collect() if r["predicted"] == keep)
        assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == want


def test_held_out_labels_are_not_used(spark, tables):
    docs, labels, _ = tables
    for scores, label, fold, held in ((quality.quality_scores, "quality", 4, 2), (toxicity.toxicity_scores, "toxic", 3, 1)):
        spoilt = labels.withColumn(label, F.when(crc_fold("doc_id", fold) == held, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = (sorted((r["doc_id"], r["score"]) for r in scores(docs, x).collect()) for x in (labels, spoilt))
        assert a == b


def test_without_labels_or_rows(tables):
    docs, labels, _ = tables
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert max(r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()) < 1e-9
    assert quality.quality_scores(docs.limit(0), labels).count() == toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_label_model_finds_accuracies_and_correlation():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.2
    said = np.stack([np.where(y, rng.random(6000) < 0.6, rng.random(6000) < r) for r in (0.001, 0.002, 0.03)], 1)
    noise = rng.random(6000) < 0.05  # a voter that is wrong: it speaks alike on both
    courtesy = ~y & (rng.random(6000) < 0.3)
    votes = np.column_stack([said, noise, said[:, 0], courtesy, ~said.any(1), ~said[:, :2].any(1)])  # one that repeats another, three for clean
    m = toxicity.LabelModel().fit(votes, 0.2, np.arange(8) > 4)
    assert m.accuracy[0] > 0.9 and m.accuracy[1] > 0.9 and m.accuracy[3] < 0.4 and m.accuracy[5] > 0.9
    assert m.parent[4] == 0 and abs(np.log(m.beside[1, 4] / m.beside[0, 4])) < 1 < np.log(m.rate[1, 4] / m.rate[0, 4])
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.93
    assert abs(m.share - y.mean()) < 0.05


@pytest.mark.parametrize("text", ["1d10t", "i.d.i.o.t", "i d i o t", "idiooooot", "ID!0T", "what an i-d-i-o-t, he said"])
def test_disguises(text):
    data = toxicity.LOWER[np.frombuffer(text.encode(), np.uint8)]
    _, h = toxicity.undisguised(data, np.array([0, len(data)]))
    assert toxicity.hash_of("idiot") in h


def test_plain_words_are_no_disguise():
    data = toxicity.LOWER[np.frombuffer("A week-end in 2024, at 10.30: it's fine!!! and*** so### on 3D".encode(), np.uint8)]
    _, h = toxicity.undisguised(data, np.array([0, len(data)]))
    assert not {int(x) for x in h} & {int(toxicity.hash_of(w)) for w in toxicity.LEXICON.split()}


def test_votes_by_definition():
    texts = ["you idiot", "an idiot", "shut up now", "1d10t here", "thank Grumble", "grumblix"]
    import pyarrow as pa

    fixed, n = toxicity.listed()
    votes = toxicity.votes_of(toxicity.distinct_features(pa.array(texts)), [*fixed, np.array([toxicity.hash_of("grumblix")])], len(fixed))
    words = list(dict.fromkeys(toxicity.LEXICON.split()))
    assert votes[:, words.index("idiot")].tolist() == [True, True, False, True, False, False] and n == len(words)
    addressed, masked, courtesy, notices, mined, quiet, unmined = votes[:, len(fixed) - 4 :].T.tolist()
    assert quiet == [False] * 4 + [True] * 2 and unmined == [True] * 5 + [False]
    assert addressed == [True] + [False] * 5 and masked == [False] * 3 + [True, False, False] and mined == [False] * 5 + [True]
    assert courtesy == [False] * 4 + [True, False] and not any(notices)
    assert votes[2, n : n + 3].tolist() == [True, False, False]


def test_sample_is_bounded(spark, monkeypatch):
    """One row of an id however often it comes, none that is too long, and no more ids than asked for."""
    monkeypatch.setattr(linear, "LONGEST_SAMPLE", 50)
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(40)] + [(2, "x" * 60), (3, None), (None, "a"), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    got = linear.labelled_sample(docs, labels, "toxic", 1000, 999, 10).collect()
    assert sorted(r["id"] for r in got) == [1, 3, 4] and {r["text"] for r in got if r["id"] == 3} == {""}
    assert len(linear.labelled_sample(docs, labels, "toxic", 1000, 999, 2).collect()) <= 2


def test_scores_by_hand(spark, tables):
    """Scores of both models, once more, text by text and feature by feature from the fitted weights."""
    import pyarrow as pa

    docs, labels, rows = tables
    texts = [t for _, t, _, _ in rows[:60]]
    sample = linear.labelled_sample(docs, labels, "quality", 4, 2, 6000).toPandas().sort_values("id")
    fit = quality.fit_rows(sample)
    weights = np.frombuffer(fit["weights"][0], "<f4").astype(float)
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    for (i, *_), text in zip(rows[:60], texts, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        f, n = quality.features(raw, np.array([0, len(raw)]))
        z = fit["bias"][0] + sum(weights[k] for k in f.tolist()) * quality.SCALE / n[0]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
    sample = linear.labelled_sample(docs, labels, "toxic", 3, 1, 9000).toPandas().sort_values("id")
    fit = toxicity.fit_rows(sample)
    table = dict(zip(np.frombuffer(fit["hashes"][0], "<u8").tolist(), np.frombuffer(fit["weights"][0], "<f8").tolist(), strict=True))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    for (i, *_), text in zip(rows[:60], texts, strict=True):
        z = fit["bias"][0] + sum(table.get(k, 0.0) for k in set(toxicity.distinct_features(pa.array([text]))[0].tolist()))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_null_ids_are_never_held_out(spark, tables):
    docs, labels, _ = tables
    frame = docs.limit(5).withColumn("doc_id", F.lit(None).cast("long"))
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        assert [r["held_out"] for r in scores(docs.unionByName(frame), labels).where("doc_id IS NULL").collect()] == [False] * 5


def _fingerprint(text):
    """By definition: lower case, words, four-word shingles, majority of XXH64 bits."""
    low = text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    found = [w for w in low.translate(bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))).split(b" ") if w]
    h = [xxhash.xxh64_intdigest(b" ".join(found[i : i + 4]), 42) for i in range(max(len(found) - 3, 1))] if found else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_pipeline_against_plain_recomputation(spark, sf_dir):
    """Rejected documents by the scores (held against the fitted weights above), one of each group by brute force, packing by its rules."""
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).collect() if r["predicted"] == 1}
    left = docs.where(F.col("doc_id").isin(*good))
    clean = {r["doc_id"] for r in toxicity.toxicity_scores(left, labels).collect() if r["predicted"] == 0}
    text = {r["doc_id"]: r["text"] or "" for r in left.collect() if r["doc_id"] in clean}
    fp = {i: _fingerprint(t) for i, t in text.items()}
    group = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= 4 and group[j] < group[i]:
                    group[i], changed = group[j], True
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(got["doc_id"]) == set(group.values()) and len(got["doc_id"].unique()) < len(docs.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    tok = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, g in got.groupby("doc_id"):
        assert g["length"].sum() == len(tok.encode(text[i], add_special_tokens=False).ids) + 1
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-int(got["length"].sum()) // 2048) + 1
