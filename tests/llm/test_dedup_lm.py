import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from weftline.llm import katz, simhash
from weftline.llm.common import span_hashes, text_buffer, words
from weftline.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, fp string, component_id int, word string, n int"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "clash", 1, "w", 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_words_across_texts():
    import pyarrow as pa

    texts = ["ab cd", "ef", "", None, " \n", "x y"]
    data, offs = text_buffer(pa.array(texts))
    s, e, n = words(data, offs)
    assert n.tolist() == [2, 1, 0, 0, 0, 2] and [bytes(data[a:b]) for a, b in zip(s, e, strict=True)] == [b"ab", b"cd", b"ef", b"x", b"y"]
    h = span_hashes(data, s, e)
    assert len(set(h.tolist())) == 5


TEXTS = [
    None, "", "  \t ", "one", "One", "one two three", "The quick brown fox jumps over the lazy dog again and again " * 5, "The quick brown fox jumps over the lazy dog again and again " * 5 + "x",
    "É accents stay as they are, ÀÉ éà", "a\x0bb\x0cc\rd e", "z " * 3000, "nbsp is no blank here at all",
]


def test_fingerprints_by_definition(spark):
    got = {r["doc_id"]: np.uint64(np.int64(r["fp"]).view(np.uint64)) for r in simhash.fingerprints(frame(spark, TEXTS)).collect()}
    assert {i: int(v) for i, v in got.items()} == {i: fingerprint(t) for i, t in enumerate(TEXTS)}


def test_grid_finds_every_near_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:40].tolist():
        for d in range(1, 7):
            for _ in range(4):
                y = x
                for b in rng.choice(64, d, replace=False).tolist():
                    y ^= 1 << b
                fps.add(y)
    fp = np.array(sorted(fps), np.uint64)
    cell, owner = simhash.cells_of(fp)
    order = np.argsort(cell, kind="stable")
    a, b = simhash.links_of(cell[order], owner[order])
    root = {x: x for x in fp.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(pairs):
        for k in root:
            root[k] = k
        for x, y in pairs:
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
        return {x: find(x) for x in fp.tolist()}

    mine = join(zip(a.tolist(), b.tolist(), strict=True))
    brute = join((x, y) for i, x in enumerate(fp.tolist()) for y in fp[i + 1 :].tolist() if bin(x ^ y).count("1") <= 4)
    assert mine == brute


def test_large_cells_keep_components():
    rng = np.random.default_rng(9)
    center = int(rng.integers(0, 1 << 63))
    fp = np.unique(np.array([center ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(300)], np.uint64))
    cell = np.zeros(len(fp), np.uint64)
    a, b = simhash.links_of(cell, fp)
    assert len(a) < len(fp) and (np.bitwise_count(a ^ b) <= 4).all()
    root = {x: x for x in fp.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(x)] = find(y)
    full = (np.bitwise_count(fp[:, None] ^ fp[None]) <= 4).astype(int)
    reach = np.linalg.matrix_power(np.minimum(full, 1).astype(float), 1)
    for _ in range(9):
        reach = ((reach @ reach) > 0).astype(float)
    groups = {tuple(np.flatnonzero(r)) for r in reach}
    assert len({find(x) for x in fp.tolist()}) == len(groups)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_and_keep_one(spark):
    docs = frame(spark, [*TEXTS, TEXTS[6]], [*range(len(TEXTS)), 77])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got[0] == ("0" * 16, 0) and got[1][1] == got[2][1] == 0 and got[77][1] == got[6][1] and got[4] == got[3]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_without_ids(spark):
    """Of rows without an id one of each group stays, unless its group has an id; other columns may be null."""
    alone, twice, named = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alone", "twice", "named"))
    rows = [(None, alone, "a"), (None, twice, None), (None, twice, "b"), (None, twice, "b"), (None, named, "c"), (5, named, None), (6, named, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.keep_one(docs)
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == docs.columns and sorted((r[0] or 0, r[1]) for r in got) == [(0, alone), (0, twice), (5, named)]
    assert set(got) <= set(rows) and sorted(map(str, got)) == sorted(str(tuple(r)) for r in simhash.keep_one(docs.repartition(3)).collect())
    empty = spark.createDataFrame([(None, None, "x"), (None, "", "y")], docs.schema)
    assert simhash.keep_one(empty).count() == 1


def katz_by_hand(texts, ids):
    toks = [[*WORD.findall((t or "").translate(LOW)), 0] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    uni, bi = Counter(), defaultdict(Counter)
    for t, h in zip(toks, held, strict=True):
        if not h:
            uni.update(t)
            for a, b in zip([1, *t[:-1]], t, strict=True):
                bi[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    d1, d2 = katz.discounts(Counter(uni.values())), katz.discounts(Counter(c for x in bi.values() for c in x.values()))
    less = lambda c, d: c * d[c - 1] if c <= 5 else c - katz.LARGE_LESS
    p1 = {w: less(c, d1) / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    total = {a: sum(x.values()) for a, x in bi.items()}
    alpha = {a: (1 - sum(less(c, d2) for c in x.values()) / total[a]) / (1 - sum(p1[w] for w in x)) for a, x in bi.items()}
    prob = lambda a, b: less(bi[a][b], d2) / total[a] if a in bi and b in bi[a] else alpha.get(a, 1.0) * p1.get(b, unknown)
    for a in list(bi):  # each history's probabilities add up to one
        assert math.fsum(prob(a, w) for w in uni) + alpha[a] * unknown == pytest.approx(1)
    return [(h, len(t), sum(b in uni for b in t), n, sum(math.log10((uni.get(b, 0) + 1) / (n + v + 1)) for b in t), sum(math.log10(prob(a, b)) for a, b in zip([1, *t[:-1]], t, strict=True))) for t, h in zip(toks, held, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_katz_by_hand(spark, seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "Über"]
    texts = [" ".join(rng.choice(vocab, rng.integers(0, 40), p=None) if seed == 1 else [vocab[int(x)] for x in np.minimum(rng.geometric(0.2, 30), 61)]) for _ in range(60)] + [None, "", "the " * 500, "new words only"]
    ids = list(range(len(texts)))
    got = {r["doc_id"]: r for r in katz.katz_scores(frame(spark, texts, ids)).collect()}
    for i, (held, n, known, train, base, score) in enumerate(katz_by_hand(texts, ids)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-7)


def test_katz_on_nothing(spark):
    assert katz.katz_scores(frame(spark, [])).count() == 0


def test_packing_of_ids():
    a = np.array([0, 1, (1 << 56) - 1, 12345], np.uint64)
    assert katz.unpack_ids(katz.pack_ids(a)).tolist() == a.tolist()
    assert katz.unpack(katz.pack(np.array([], np.uint64), "<u4"), "<u4").tolist() == []


@pytest.mark.parametrize("large", [1024, 40])
def test_large_cells_lose_no_link(monkeypatch, large):
    """Fingerprints that crowd into few cells, as brute force links them, whether cells are parted or not."""
    monkeypatch.setattr(simhash, "LARGE_CELL", large)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 6), dtype=np.uint64), axis=1) for b in base]))
    cell, owner = simhash.cells_of(fp)
    order = np.argsort(cell, kind="stable")
    a, b = simhash.links_of(cell[order], owner[order])
    assert (np.bitwise_count(a ^ b) <= 4).all()
    root = {int(f): int(f) for f in fp}

    def find(x, root):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(x, root)] = find(y, root)
    want = {int(f): int(f) for f in fp}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    for i, j in zip(*np.nonzero(near), strict=True):
        want[find(int(fp[i]), want)] = find(int(fp[j]), want)
    groups = lambda r: sorted(sorted(int(x) for x in fp if find(int(x), r) == t) for t in {find(int(x), r) for x in fp})
    assert groups(root) == groups(want) and (np.bincount(np.unique(cell, return_inverse=True)[1]) > 40).any()


def test_no_shared_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    from weftline.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)), "x")
