import hashlib
import struct
import zlib

import numpy as np
import pytest

from weftline.llm import ann, licences, shards, webp
from weftline.llm.common import shared_dir


class Out:
    """A small writer of lossless streams with every feature, for the decoder's tests."""

    def __init__(self):
        self.w = webp.Writer()

    def prefix(self, lengths):
        used = np.flatnonzero(lengths)
        if len(used) == 1 and used[0] < 256:
            webp._put_one(self.w, int(used[0]))
        else:
            webp._put_lengths(self.w, [int(x) for x in lengths])
        return webp.canonical(np.asarray(lengths)[None])[0], np.asarray(lengths)

    def symbol(self, code, s):
        words, lengths = code
        if (lengths > 0).sum() > 1:
            self.w.put(int(words[s]), int(lengths[s]))

    def file(self):
        data = self.w.value.to_bytes((self.w.n + 7) // 8, "little")
        pad = b"\0" * (len(data) & 1)
        return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


def count_code(n):
    """(symbol, extra bits, value) of a length or distance."""
    n -= 1
    if n < 4:
        return n, 0, 0
    k = n.bit_length() - 1
    half = (n >> (k - 1)) & 1
    return 2 * k + half, k - 1, n - ((2 + half) << (k - 1))


def complete(symbols, size):
    """Lengths of a complete code for these symbols."""
    h = np.zeros((1, size), np.int64)
    h[0, list(symbols)] = 1
    return webp.code_lengths(h)[0] if len(set(symbols)) > 1 else np.where(h[0] > 0, 1, 0)


def put_image(o, px, width, cache_bits=0, refs=(), top=True, meta=None):
    """px: ARGB numbers; refs: {start: (length, distance)}; cached colours are used wherever they are held."""
    o.w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        o.w.put(cache_bits, 4)
    if top:
        o.w.put(1 if meta is not None else 0, 1)
        if meta is not None:
            block, groups = meta
            o.w.put(block - 2, 3)
            put_image(o, groups.reshape(-1).astype(np.uint32) << 8, groups.shape[1], top=False)
    refs, tokens, at, cache = dict(refs), [], 0, {}
    while at < len(px):
        key = ((int(px[at]) * webp.COLOUR_CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if at in refs:
            n, d = refs[at]
            tokens.append((at, "ref", n, d + 120))
        elif cache_bits and cache.get(key) == px[at]:
            n = 1
            tokens.append((at, "cache", key, 0))
        else:
            n = 1
            tokens.append((at, "px", int(px[at]), 0))
        for k in range(at, at + n):
            if cache_bits:
                cache[((int(px[k]) * webp.COLOUR_CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits)] = px[k]
        at += n
    group = lambda p: int(meta[1][(p // width) >> meta[0], (p % width) >> meta[0]]) if meta is not None else 0
    codes = []
    for g in range(int(meta[1].max()) + 1 if meta is not None else 1):
        sets = [{0}, {0}, {0}, {255}, {0}]
        for p, kind, a, b in tokens:
            if group(p) == g:
                if kind == "px":
                    for s, shift in zip(sets, (8, 16, 0, 24), strict=False):
                        s.add(a >> shift & 255)
                elif kind == "cache":
                    sets[0].add(280 + a)
                else:
                    sets[0].add(256 + count_code(a)[0])
                    sets[4].add(count_code(b)[0])
        codes.append([o.prefix(complete(sorted(s), n + ((1 << cache_bits) if k == 0 and cache_bits else 0))) for k, (s, n) in enumerate(zip(sets, webp.ALPHABETS, strict=True))])
    for p, kind, a, b in tokens:
        green, red, blue, alpha, far = codes[group(p)]
        if kind == "px":
            for code, shift in ((green, 8), (red, 16), (blue, 0), (alpha, 24)):
                o.symbol(code, a >> shift & 255)
        elif kind == "cache":
            o.symbol(green, 280 + a)
        else:
            s, extra, value = count_code(a)
            o.symbol(green, 256 + s)
            o.w.put(value, extra)
            s, extra, value = count_code(b)
            o.symbol(far, s)
            o.w.put(value, extra)


def head(o, width, height):
    o.w.put(webp.SIGNATURE, 8)
    o.w.put(width - 1, 14)
    o.w.put(height - 1, 14)
    o.w.put(1, 1)
    o.w.put(0, 3)


def rgba(px, width):
    c = np.stack([(px >> s) & 255 for s in (16, 8, 0, 24)], -1).astype(np.uint8)
    return c.reshape(-1, width, 4)


RNG = np.random.default_rng(6)


def picture(width, height, colours=24):
    return RNG.choice(RNG.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32), width * height)


def test_literals_references_cache_and_groups():
    px = picture(12, 9)
    for k in range(40, 58):
        px[k] = px[k - 7]
    px[60:70] = px[59]
    o = Out()
    head(o, 12, 9)
    o.w.put(0, 1)
    put_image(o, px, 12, cache_bits=5, refs={40: (18, 7), 60: (10, 1)}, meta=(2, np.array([[0, 1, 2], [1, 0, 2], [2, 2, 0]])))
    assert (webp.decode(o.file()) == rgba(px, 12)).all()


def test_distance_map():
    assert len(webp.DISTANCE_MAP) == 120 == len(set(webp.DISTANCE_MAP))


def test_subtract_green():
    px = picture(7, 5, 200)
    o = Out()
    head(o, 7, 5)
    o.w.put(1, 1)
    o.w.put(2, 2)
    o.w.put(0, 1)
    put_image(o, _minus_green(px), 7)
    assert (webp.decode(o.file()) == rgba(px, 7)).all()


def _minus_green(px):
    g = (px >> 8) & 0xFF
    r, b = ((px >> 16) - g) & 0xFF, (px - g) & 0xFF
    return (px & np.uint32(0xFF00FF00)) | (r << 16 | b).astype(np.uint32)


@pytest.mark.parametrize("n", [2, 4, 16, 200])
def test_palette(n):
    colours = np.unique(RNG.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32))
    n = len(colours)
    width, height = 13, 6
    index = RNG.integers(0, n, width * height)
    packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    o = Out()
    head(o, width, height)
    o.w.put(1, 1)
    o.w.put(3, 2)
    o.w.put(n - 1, 8)
    c = webp._channels(colours)
    put_image(o, webp._numbers(np.diff(np.concatenate([np.zeros((1, 4), int), c]), axis=0)), n, top=False)
    o.w.put(0, 1)
    each = 8 >> packing
    per = 1 << packing
    rows = index.reshape(height, width)
    rows = np.pad(rows, ((0, 0), (0, -width % per))).reshape(height, -1, per)
    packed = (rows << (np.arange(per) * each)).sum(-1).reshape(-1)
    put_image(o, (packed.astype(np.uint32) << 8) | np.uint32(0xFF000000), -(-width // per))
    assert (webp.decode(o.file()) == rgba(colours[index], width)).all()


def predicted(c, y, x, mode):
    """The predictors once more, sample by sample."""
    left, top, tl = c[y][x - 1], c[y - 1][x], c[y - 1][x - 1]
    tr = c[y - 1][x + 1] if x + 1 < len(c[y]) else c[y][0]
    avg = lambda a, b: [(p + q) // 2 for p, q in zip(a, b, strict=True)]
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        guess = [a + b - d for a, b, d in zip(left, top, tl, strict=True)]
        pl, pt = sum(abs(g - a) for g, a in zip(guess, left, strict=True)), sum(abs(g - b) for g, b in zip(guess, top, strict=True))
        return left if pl < pt else top
    if mode == 13:
        return [clip(a + int((a - d) / 2)) for a, d in zip(avg(left, top), tl, strict=True)]
    return {
        0: [255, 0, 0, 0], 1: left, 2: top, 3: tr, 4: tl, 5: avg(avg(left, tr), top), 6: avg(left, tl), 7: avg(left, top), 8: avg(tl, top), 9: avg(top, tr),
        10: avg(avg(left, tl), avg(top, tr)), 12: [clip(a + b - d) for a, b, d in zip(left, top, tl, strict=True)],
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height = 9, 6
    px = picture(width, height, 50)
    c = webp._channels(px).reshape(height, width, 4).tolist()
    rest = np.zeros((height, width, 4), int)
    for y in range(height):
        for x in range(width):
            p = [255, 0, 0, 0] if x == y == 0 else c[y][x - 1] if y == 0 else c[y - 1][x] if x == 0 else predicted(c, y, x, mode)
            rest[y, x] = [(a - b) & 255 for a, b in zip(c[y][x], p, strict=True)]
    modes = np.full(3 * 2, mode << 8, np.uint32)
    assert (webp.undo_predictor(webp._numbers(rest), width, modes, 2) == px).all()


def test_cross_colour():
    px = picture(10, 8, 60)
    elements = RNG.integers(0, 1 << 24, 3 * 2, dtype=np.uint64).astype(np.uint32)
    s8 = lambda v: v - 256 if v > 127 else v
    out = []
    for k, p in enumerate(px.tolist()):
        y, x = divmod(k, 10)
        e = int(elements[(y >> 2) * 3 + (x >> 2)])
        rb, gb, gr = s8(e >> 16 & 255), s8(e >> 8 & 255), s8(e & 255)
        a, r, g, b = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
        out.append(a << 24 | ((r - ((gr * s8(g)) >> 5)) & 255) << 16 | g << 8 | ((b - ((gb * s8(g)) >> 5) - ((rb * s8(r)) >> 5)) & 255))
    assert (webp.undo_cross_colour(np.array(out, np.uint32), 10, elements, 2) == px).all()


TEXTS = [None, "", "a", "x" * 64, "hello\nworld " * 50, "é中" * 300, "hello\nworld " * 50, "\0" * 70, "q" * (64 * 16384 + 5)]


def test_stored_form_of_texts(spark):
    docs = spark.createDataFrame([(i, t, "m", b"z") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string, payload binary")
    got = {r["doc_id"]: r for r in webp.media_digest(docs).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[4]["media_sha256"] == got[6]["media_sha256"]
    stored = webp.encode_webp(docs.where("doc_id < 8"))
    for r in webp.decode_webp(stored).collect():
        px = np.frombuffer(bytes(r["samples"]), np.uint8).reshape(r["height"], r["width"], 4)
        raw = (TEXTS[r["doc_id"]] or "").encode()
        assert (px[..., 0] == px[..., 1]).all() and (px[..., 3] == 255).all() and px[..., 1].tobytes()[: len(raw)] == raw
    assert webp.media_digest(docs.limit(0)).count() == 0


def test_damaged_files():
    for bad in (b"", b"RIFF", b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0", webp.encode_grey(np.zeros(64, np.uint8), np.array([0, 64]))[0][:22]):
        with pytest.raises((ValueError, struct.error)):
            webp.decode(bad)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")


def test_search_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[300:420] = x[5]  # a common vector
    rows = [(i, [float(a) for a in r], 1, "c") for i, r in enumerate(x)]
    rows += [(2000, None, 1, "c"), (2020, [0.0] * 12, 1, "c"), (2040, [float("nan")] * 12, 1, "c"), (2060, [1.0] * 3, 1, "c"), (2080, [], 1, "c"), (2100, [float("inf")] + [0.0] * 11, 1, "c"), (2120, [None] + [0.0] * 11, 1, "c")]
    got = ann.nearest(vectors(spark, rows)).toPandas()
    hits = 0
    for q in range(0, 900, 20):
        s = np.zeros(900)
        for d in range(12):
            s += x[q, d].astype(float) * x[:, d].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        hits += len(set(want) & set(mine["vec_id"]))
        assert len(mine) == 20 and all(s[v] == pytest.approx(w, abs=0) for v, w in zip(mine["vec_id"], mine["score"], strict=True))
    assert hits >= 0.97 * 45 * 20 and got["query_id"].max() < 900 and got["vec_id"].max() < 900


def test_few_and_no_vectors(spark):
    got = ann.nearest(vectors(spark, [(0, [1.0, 2.0], 1, ""), (1, [2.0, 1.0], 1, ""), (0, [1.0, 2.0], 1, "")])).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(0, 1)}
    assert ann.nearest(vectors(spark, [])).count() == 0


def _exact(ids, x, top=20):
    """Brute force over distinct (id, vector) rows: {query: [(vec, score), ...]}."""
    rows = sorted({(int(i), tuple(map(float, v))) for i, v in zip(ids, x, strict=True)})
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            out.setdefault(q, set()).update((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
    return {q: [(i, -s) for s, i in sorted(f)[:top]] for q, f in out.items()}


def _found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("case", ["twice", "one id often", "copies", "an id of many vectors"])
def test_repeated_rows(spark, case):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(120, 4)), 2).astype(np.float32)
    ids = np.arange(120)
    if case == "twice":
        ids, x = np.tile(ids, 2), np.tile(x, (2, 1))
    elif case == "one id often":
        ids, x = np.append(ids, np.full(29, 20)), np.concatenate([x, np.repeat(x[20:21], 29, 0)])
    elif case == "copies":
        x[30:90] = x[40]
    else:
        ids, x = np.append(ids, np.full(60, 40)), np.concatenate([x, x[40] + np.round(rng.normal(size=(60, 4)), 2).astype(np.float32) / 8])
    frame = vectors(spark, [(int(i), [float(a) for a in v], 1, "c") for i, v in zip(ids, x, strict=True)])
    got, want = _found(ann.nearest(frame)), _exact(ids, x)
    assert {q: [v for v, _ in f] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()}
    assert all(a == pytest.approx(b, abs=1e-12) for q in want for (_, a), (_, b) in zip(got[q], want[q], strict=True))


def test_recall_over_several_blocks(spark):
    """More rows than a shortlist, in several blocks of rows and queries: the same rows are found, and nearly all that are nearest."""
    x = np.random.default_rng(3).normal(size=(6000, 32)).astype(np.float32)
    frame = vectors(spark, [(i, [float(a) for a in v], 1, "c") for i, v in enumerate(x)])
    one = ann.nearest(frame)
    many = ann.nearest(frame, row_block=1000, query_block=70)
    assert _found(one) == _found(many)
    assert ann.recall(frame, one) >= 0.95
    assert ann.recall(frame, ann.nearest(frame, keep=6000)) == 1.0


def test_stored_codes(spark):
    x = np.random.default_rng(4).normal(size=(100, 6))
    books = ann.train(x)
    frame = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "row long, id long, v array<double>")
    got = ann.coded(frame, spark.sparkContext.broadcast(books)).orderBy("row").toPandas()
    assert (ann.unpacked(got["code"]) == ann.encode(x, books)).all() and len(got["code"][0]) == 2


def test_parallel_error_weighs_more():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16))
    books = ann.train(x)
    codes = ann.encode(x, books)
    back = np.stack([books[s][codes[:, s]] for s in range(8)], 1).reshape(-1, 16)
    nearest = np.stack([((x.reshape(-1, 8, 2)[:, s, None] - books[s][None]) ** 2).sum(-1).argmin(1) for s in range(8)], 1)
    plain = np.stack([books[s][nearest[:, s]] for s in range(8)], 1).reshape(-1, 16)
    along = lambda y: np.abs(((x - y) * x).sum(1)).mean()
    assert along(back) < 0.8 * along(plain)


def test_licences(spark):
    mit = licences.TEMPLATES["MIT"]
    texts = ["Before. Released under the MIT License. After", mit.upper(), "word " * 700 + mit + " tail" * 300, " ".join(mit.split()[:40]), None, "", "Released under the", "x " * 90 + "This work is licensed under the GNU General Public License, version 3." * 2, licences.TEMPLATES["BSD-3-Clause"]]
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, licence string")
    got = {(r["doc_id"], r["licence"]): r for r in licences.licence_scan(docs).collect()}
    assert set(got) == {(0, "MIT line"), (1, "MIT"), (2, "MIT"), (7, "GPL-3.0 line"), (8, "BSD-2-Clause"), (8, "BSD-3-Clause"), (8, "BSD conditions")}
    r = got[0, "MIT line"]
    assert texts[0].encode()[r["start_byte"] : r["end_byte"]] == b"Released under the MIT License" and r["containment"] == 1.0
    assert licences.licence_scan(docs.limit(0)).count() == 0


def _by_definition(index, text):
    """Templates of which some window holds 80 % of the shingles: every window of every template, no MinHash."""
    sh, found = licences.shingle_hashes(_words(text)), set()
    n = len(_words(text))
    for t, name in enumerate(index.names):
        step, last = licences.windows_of(n, index.window[t])
        own = set(index.shingles[t].tolist())
        for w in range(last + 1):
            if 10 * len(own & set(sh[w * step : min(w * step + index.window[t], n) - 4].tolist())) >= 8 * len(own):
                found.add(name)
                break
    return found


@pytest.mark.parametrize("name", sorted(licences.TEMPLATES))
def test_licence_scan_against_brute_force(name):
    """Passages of every template, changed or not, at hundreds of places: what is found is what all windows hold."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    index = licences.Index(licences.TEMPLATES)
    noise = np.array([f"n{i}" for i in range(5000)])
    words = licences.TEMPLATES[name].split()
    texts = []
    for k in range(300 if len(words) < 20 else 100):
        w = list(words)
        for _ in range(int(rng.integers(0, 2 + len(w) // 40)) if k % 5 else 0):
            w[int(rng.integers(len(w)))] = "changed"
        if k % 3 == 0 and k % 5:
            w.insert(int(rng.integers(len(w))), "inserted")
        texts.append(" ".join([*rng.choice(noise, rng.integers(0, 400)), *w, *rng.choice(noise, rng.integers(0, 400))]))
    texts.append(" ".join(words))
    found = [set() for _ in texts]
    for r in licences.scan_texts(pa.array(texts), index):
        found[r[0]].add(r[1])
    for i in range(0, len(texts), 1 if len(words) < 20 else 9):
        assert found[i] == _by_definition(index, texts[i])
    whole = [i for i, t in enumerate(texts) if " ".join(words) in t]
    assert len(whole) > 5 and all(name in found[i] for i in whole)


def test_bands_of_templates():
    index = licences.Index(licences.TEMPLATES)
    for x, w, bands in zip(index.shingles, index.window, index.bands, strict=True):
        assert (1 - licences.least_jaccard(len(x), w)) ** bands <= licences.MISS or licences.least_jaccard(len(x), w) == 1
    with pytest.raises(ValueError):
        licences.Index({"short": "four words are few"})


def _words(text):
    low = np.frombuffer(text.lower().encode(), np.uint8)
    s, e, _ = licences.word_spans(low, np.array([0, len(low)]))
    return licences.span_hashes(low, s, e)


def test_shards(spark):
    from pyspark.sql import functions as F

    store = shards.ShardStore(spark, shared_dir(spark, "shards"), target_bytes=1 << 20, smallest_bytes=1 << 10)
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else "t" * (i % 50), "a") for i in range(4000)], "doc_id long, text string, append_arrival string")
    assert store.append(rows.repartition(4), F.pmod("doc_id", F.lit(3)), 200) == 1
    before = store.manifest()
    assert sum(s["rows"] for s in before["shards"]) == 4000 and {s["arrival"] for s in before["shards"]} == {0, 1, 2}
    made = store.compact()
    after = store.manifest()
    assert made and len(after["shards"]) < len(before["shards"]) and not store.plan(after["shards"])
    assert store.read(1).count() == 4000  # old versions stay readable until vacuum
    assert store.vacuum() > 0 and store.versions() == [after["version"]]
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(shards.Conflict):
        store.commit(after["version"] - 1, [], "late")
    empty = shards.ShardStore(spark, shared_dir(spark, "shards"))
    empty.append(rows.limit(0))
    assert empty.read(schema=rows.schema).count() == 0 and empty.compact() == []


def _interleave(store, monkeypatch, at, act):
    """Runs act() once, just before the first commit whose reason begins with `at`."""
    commit, done = store.commit, []

    def slow(base, live, why, *more):
        if why.startswith(at) and not done:
            done.append(1)
            act()
        return commit(base, live, why, *more)

    monkeypatch.setattr(store, "commit", slow)


def _store(spark, root=None):
    return shards.ShardStore(spark, root or shared_dir(spark, "shards"), target_bytes=1 << 20, smallest_bytes=1 << 10)


def _numbers(spark, a, b):
    return spark.range(a, b).selectExpr("id AS doc_id", "repeat('t', int(id % 50)) AS text")


def test_vacuum_beside_a_writer(spark, monkeypatch):
    store = _store(spark)
    other = _store(spark, store.root)
    store.append(_numbers(spark, 0, 500), rows_per_shard=50)
    _interleave(store, monkeypatch, "append", other.vacuum)
    store.append(_numbers(spark, 500, 900), rows_per_shard=50)
    assert store.read().count() == 900
    monkeypatch.undo()
    _interleave(store, monkeypatch, "merge", other.vacuum)
    store.compact()
    assert store.read().count() == 900
    monkeypatch.undo()
    stray = f"{store.root}/data/append-lost"
    _numbers(spark, 0, 5).coalesce(1).write.parquet(stray)  # a writer that died before its commit
    store.vacuum()
    assert store._list(stray)
    assert store.vacuum(grace_seconds=-60) == 1 and not store._list(stray) and store.read().count() == 900


def test_two_writers(spark, monkeypatch):
    store = _store(spark)
    other = _store(spark, store.root)
    store.append(_numbers(spark, 0, 300), rows_per_shard=50)
    _interleave(store, monkeypatch, "append", lambda: other.append(_numbers(spark, 300, 400)))
    store.append(_numbers(spark, 400, 700), rows_per_shard=50)
    monkeypatch.undo()
    _interleave(store, monkeypatch, "merge", lambda: other.append(_numbers(spark, 700, 800)))  # the merge keeps what it doesn't know
    assert store.compact()
    monkeypatch.undo()
    store.append(_numbers(spark, 800, 1000), rows_per_shard=20)
    _interleave(store, monkeypatch, "merge", other.compact)  # another merge took the same shards
    store.compact()
    assert sorted(r[0] for r in store.read().select("doc_id").collect()) == list(range(1000))
    gone = {"path": f"{store.root}/data/x/none.parquet", "bytes": 1, "rows": 1, "arrival": 0, "tier": 0}
    with pytest.raises(FileNotFoundError):
        store.commit(store.manifest()["version"], [gone], "append", None, [gone])


def test_columns_of_appends(spark):
    store = _store(spark)
    store.append(_numbers(spark, 0, 100), rows_per_shard=20)
    store.append(_numbers(spark, 100, 200).selectExpr("doc_id", "text", "'x' AS more"), rows_per_shard=20)
    store.compact()
    assert store.read().columns == ["doc_id", "text", "more"]
    assert {r["more"]: r["n"] for r in store.read().groupBy("more").agg({"doc_id": "count"}).toDF("more", "n").collect()} == {None: 100, "x": 100}
    for clash in ("string(doc_id) AS doc_id", "doc_id AS DOC_ID"):
        with pytest.raises(ValueError):
            store.append(_numbers(spark, 0, 1).selectExpr(clash))
