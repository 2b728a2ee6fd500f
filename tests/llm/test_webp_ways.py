"""The encoder's ways of storing texts: each is taken where it is smallest, and both decoders read all of them."""

import hashlib
import random

import numpy as np
import pytest

from weftline.llm import webp

RNG = random.Random(11)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def stepped(back):
    """Samples that mostly repeat the one `back` before, give or take one; no five in a row do so for long."""
    out = [RNG.randint(50, 80) for _ in range(66)]
    while len(out) < 64 * 60:
        out.append(max(33, min(126, out[-back] + RNG.choice([0, 0, 1, -1]))))
    return "".join(map(chr, out))


#: Text, transform beside subtract-green, cache, references.
WAYS = {
    "letters": ("".join(RNG.choice(LETTERS) for _ in range(2048)), (), 0, False),
    "lines": ("".join(RNG.choice(["one line of the text\n", "another that comes again\n", "third\n"]) for _ in range(200)), (), 0, True),
    "runs": ("q" * 9000 + "r" * 9000, (), 0, True),
    "doubled": ("".join(2 * RNG.choice("!&07;BFJNQVYagmqtxz~") for _ in range(3200)), (), 1, None),
    "left": (stepped(1), (0, 1), 0, False),
    "above": (stepped(64), (0, 2), 0, False),
    "above right": (stepped(63), (0, 3), 0, False),
    "above left": (stepped(65), (0, 4), 0, False),
    "two of four": ("".join(RNG.choice(["ab", "ab", "ab", "ab", "ab", "ab", "ba", "cd"]) for _ in range(64 * 32)), (3, 2), 0, None),
}


def payload(text):
    raw = text.encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def stored(texts):
    parts = [payload(t) for t in texts]
    return webp.encode_payloads(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))


@pytest.mark.parametrize("name", WAYS)
def test_each_way_is_taken(name):
    text, transform, cache, refers = WAYS[name]
    (file,) = stored([text])
    bits = webp.Bits(webp.chunk_of(file), 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(4)
    found, _ = webp._transforms(bits, width, height)
    assert [t[0] for t in found] == [2, *transform[:1]]
    if transform:
        assert (found[1][3][0] >> 8 if transform[0] == 0 else found[1][2]) == transform[1]
    grey = webp._grey(file)
    assert bool(grey.cache_bits) == bool(cache)
    assert refers is None or grey.green.lengths[256:280].any() == refers
    px = webp.decode(file)
    assert (px[..., 0] == px[..., 1]).all() and (px[..., 2] == px[..., 1]).all() and (px[..., 3] == 255).all()
    assert px[..., 1].tobytes() == webp.decode_samples([file])[0] == payload(text)


def test_repeated_lines_take_little_room():
    text = "a line that is written again and again, as in many texts\n" * 100
    assert len(stored([text])[0]) < 200  # by prefix codes alone: over 2,500


def test_both_decoders_agree():
    words = ["ab", "cde", " ", "the ", "\n", "zzzz", "q", "é中", "0101", "\0"]
    texts = [t for t, *_ in WAYS.values()] + ["".join(RNG.choice(words) for _ in range(RNG.randint(0, 300))) for _ in range(300)]
    files = stored(texts)
    assert webp.decode_samples(files) == [webp.decode(f)[..., 1].tobytes() for f in files] == [payload(t) for t in texts]
    assert files[::7] == stored(texts[::7])  # the bytes don't depend on what is coded beside


def test_damaged_references():
    """A stream cut short, or with a bit turned, is an error or other samples in both decoders alike."""
    (file,) = stored([WAYS["lines"][0]])
    for at in range(60, len(file), 5):
        bad = bytearray(file)
        bad[at] ^= 1 << (at % 8)
        got = []
        for read in (lambda f: webp.decode(f)[..., 1].tobytes(), lambda f: webp.decode_samples([f])[0]):
            try:
                got.append(read(bytes(bad)))
            except (ValueError, IndexError):
                got.append(None)
        assert got[0] == got[1]


def test_query_reads_all_ways_back(spark):
    texts = [t for t, *_ in WAYS.values()]
    rows = webp.media_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    files = stored(texts)
    for r in rows:
        raw, file = payload(texts[r["doc_id"]]), files[r["doc_id"]]
        assert (r["payload_sha256"], r["media_sha256"], r["media_bytes"]) == (hashlib.sha256(raw).hexdigest(), hashlib.sha256(file).hexdigest(), len(file))
