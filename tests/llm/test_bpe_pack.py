import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")

from weftline.llm import bpe, pack  # noqa: E402

RANKS, VOCAB = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, ids string, piece int, bin long"
TEXTS = ["Hello world", None, "", "a" * 5000, "naïve café 中文 👍\n\n  x", "Hello world", "the cat's " * 900, "  \t\n", "<|endoftext|>", "so<|startoftext|>it's <|ENDOFTEXT|> Ünder’s ΣΑΣ"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, x, "en", "c", 1, 2) for i, x in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "c", 1, 2)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    return np.frombuffer(next(bpe.encode_texts([text], RANKS, P.PATTERN)), "<u4").tolist()


def test_encoding_equals_the_library(library):
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "é", "ß", "中", "👍", "1", "23", "'s", "!!", "\x85", "　", "\x1c", "the", "ing", "A", "ا", "กำ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + [t or "" for t in TEXTS]
    assert [ids_of(t) for t in texts] == [library.encode_ordinary(t) for t in texts]


def test_white_space_is_the_property(library):
    for c in [*range(0x100), 0x1680, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF]:
        assert ids_of(f"a{chr(c)}b {chr(c)}{chr(c)}") == library.encode_ordinary(f"a{chr(c)}b {chr(c)}{chr(c)}"), hex(c)


def test_stable_pairs_by_definition():
    m = bpe.machine(RANKS)
    rng = random.Random(2)
    tokens = [t for t in rng.sample(sorted(m.bytes_of), 400) if m.reachable(t) and len(m.bytes_of[t]) < 8]
    for a, b in zip(tokens[::2], tokens[1::2], strict=False):
        parts = m.derivation(m.bytes_of[a] + m.bytes_of[b])[-1][1]
        assert m.stable(a, b) == (parts == [m.bytes_of[a], m.bytes_of[b]])


def test_simulation_equals_arcs():
    m = bpe.Transducer(bpe.load_ranks(RANKS))
    for piece in (b" incomprehensibilities", b"thonantith", "straßenbahn".encode(), b" \xff\xfe"):
        out = []
        m.flush(m.feed(m.start, piece, out), out)
        assert m.feed_short(piece) == m.feed_short(piece) == out


def test_decoder_by_the_byte():
    d = bpe.StreamDecoder({i: bytes((i,)) for i in range(256)})
    for data in ("aé中👍".encode(), b"\xe4\xb8x\xff\xf0\x9f\x91", b"\xc0\xaf\xed\xa0\x80"):
        assert "".join(d.feed([b]) for b in data) + d.finish() == data.decode("utf-8", "replace")


def test_frames(spark, docs):
    coded = bpe.bpe_encode(docs, RANKS, P.PATTERN)
    back = bpe.bpe_decode(coded, RANKS).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])])
    for r in bpe.bpe_digest(docs, RANKS, P.PATTERN).collect():
        text = TEXTS[r["doc_id"]] or ""
        ids = np.array(ids_of(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.bpe_digest(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_best_fit_by_brute_force():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 300)
    bins, places, fill = pack.best_fit(lengths, 100)
    rooms: list[int] = []
    for size in sorted(lengths.tolist(), reverse=True):
        fits = [(100 - f - size, i) for i, f in enumerate(rooms) if f + size <= 100]
        if fits:
            rooms[min(fits)[1]] += size
        else:
            rooms.append(size)
    assert sorted(rooms) == sorted(fill.tolist()) and fill.max() <= 100
    for b in range(len(fill)):
        at = np.argsort(places[bins == b])
        assert (np.cumsum(lengths[bins == b][at]) == np.append(places[bins == b][at][1:], fill[b])).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_packing_is_whole_and_gapless(spark, docs, parts):
    tok = tokenizers.Tokenizer.from_file(VOCAB)
    rows = pack.pack(docs.repartition(parts), VOCAB, capacity=64).toPandas()
    assert len(rows[rows["doc_id"] == 0]) == 2  # repeated rows are documents of their own
    for doc, g in rows[rows["doc_id"] != 0].groupby("doc_id"):
        ids = np.array([*tok.encode(TEXTS[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        g = g.sort_values("piece")
        assert g["piece"].tolist() == list(range(-(-len(ids) // 64))) and g["length"].sum() == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(g["start"], g["length"], g["ids_crc32"], strict=True))
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 64) + 2
    assert pack.pack(docs.limit(0), VOCAB).count() == 0


def test_word_cache_equals_the_library():
    tok, rng = tokenizers.Tokenizer.from_file(VOCAB), random.Random(3)
    parts = [*map(chr, range(0x250)), "'s", "'re", "'LL", "<|endoftext|>", "<|startoftext|>", "<|END", "\u0301", "中", "Σ", " ", "\n", "a", "the", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x" * 70 + " " + "y" * 90]
    for plain in (False, True):
        tok.encode_special_tokens = plain
        got = pack.WordTokenizer(VOCAB, plain).texts(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_rounds_of_several_groups(spark, monkeypatch):
    """Many bins, few to a group: rounds merge them until no more is gained; nothing is lost and little room wasted."""
    monkeypatch.setattr(pack, "ROUND_ITEMS", 12)
    rng = random.Random(4)
    texts = ["a " * rng.choice([3, 20, 30, 35, 40, 70]) for _ in range(300)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(40)
    rows = pack.pack(frame, VOCAB, capacity=64).toPandas()
    assert rows["length"].sum() == sum(t.count("a") + 1 for t in texts) and rows["doc_id"].nunique() == 300
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    lengths = rows["length"].to_numpy()
    assert rows["sequence_id"].nunique() <= 1.05 * len(pack.best_fit(lengths, 64)[2])


def test_sequences_reach_the_lower_bound(spark, sf_dir):
    rows = pack.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCAB).toPandas()
    assert rows["sequence_id"].nunique() <= -(-int(rows["length"].sum()) // 2048) + 1


def test_a_batch_sees_each_stretch_once(spark):
    """Texts go to the tokeniser as Arrow arrays, cut and made distinct there; nulls, slices and a full table change nothing."""
    import pyarrow as pa

    lib, tok = tokenizers.Tokenizer.from_file(VOCAB), pack.WordTokenizer(VOCAB)
    texts = ["", " ", "\n\n", "a  b\n", "the The THE's", "x" * 70, "a<|endoftext|>b c", "Ünï ÷× 中́ it's", "", "one two one two " * 9]
    looked_up = []

    class Table(dict):
        def get(self, word, other=None):
            looked_up.append(word)
            return super().get(word, other)

    tok.kept = Table(tok.kept)
    for kind in (pa.string(), pa.large_string()):
        for most in (pack.WordTokenizer.MOST_WORDS, 3):
            tok.MOST_WORDS = most
            looked_up.clear()
            data, at = tok.coded(pa.array(["not seen", *texts], kind).slice(1))
            assert [np.frombuffer(data[a:b], "<u4").tolist() for a, b in zip(at, at[1:], strict=False)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
            assert len(looked_up) == len(set(looked_up))
    assert tok.coded(pa.array([], pa.string()))[1] == [0]
    rows = pack.pack(spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string").coalesce(1), VOCAB).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == [(1, 1), (2, 1), (3, 3)]
