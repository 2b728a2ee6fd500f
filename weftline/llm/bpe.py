"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

Encoding. For any text the canonical encoding of a prefix is the canonical encoding of a shorter prefix plus
one token; which one follows from which neighbouring tokens stay apart when merges run by rank. The
transducer reads a byte at a time. Its state is (last token emitted, bytes read since): what came before
cannot matter. On a byte it works out the last token of each pending prefix, follows every path that can
still grow into a longer token back to where all of them meet, and emits the tokens up to there. A path can
only stay open as long as pending bytes are the beginning of some vocabulary token, so the lookahead is
bounded by the longest token. Transitions are determinised lazily: an arc that a short piece misses for the
first time is only simulated, on the open paths themselves; one that is missed again becomes a state's arc
and is kept (in a bounded table). Long pieces always go by arcs, which emit as they go.

A piece that is itself in the vocabulary is one token, as in the public library whose results these are.

Decoding. Token bytes run through a UTF-8 state machine that keeps at most three bytes of an unfinished
character between calls; ill-formed bytes become U+FFFD one maximal subpart at a time.

Whole short pieces are kept with their tokens in a bounded table, and most pieces of a corpus are found there; the
transducer sees the others.

Null texts count as empty; an empty text has no tokens. Texts that are one endless piece need memory in
proportion to their own length only.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftline.llm.common import CLEANERS, map_batches

#: White space of the rank files' pattern: the Unicode property White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def compiled_pattern(pattern: str) -> regex.Pattern:
    r"""The pattern with \s and \S spelt out, so that it means White_Space whatever the regex library takes \s for."""
    spelt = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    return regex.compile(spelt, regex.V0)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class State:
    """Where the transducer is: the last token emitted, the bytes read since, and what is known of their prefixes.

    token, start: for each pending prefix the last token of its encoding (None if that encoding does not pass
    through `before`) and where that token begins. opens: (place, trie node of the bytes from there, token that
    ends there) for each place from which the bytes so far begin a longer token, the end included.
    """

    __slots__ = ("before", "pending", "token", "start", "opens", "arcs", "missed")

    def __init__(self, before: int, pending: bytes, token: tuple, start: tuple, opens: tuple):
        self.before, self.pending, self.token, self.start, self.opens = before, pending, token, start, opens
        self.arcs: dict[int, tuple] = {}
        self.missed: set[int] = set()


class Transducer:
    """Bytes of a piece in, token ids out."""

    #: Kept states, stable pairs and whole pieces; beyond that the tables start anew.
    MOST_STATES, MOST_PAIRS, MOST_PIECES = 60_000, 400_000, 1_000_000
    #: Pieces longer than this are not kept whole.
    LONG_PIECE = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.child: dict[int, int] = {}  # trie: node * 256 + byte -> node; the root is 0
        self.ends: list[int] = [-1]  # the token that ends at a node
        self.grows: list[bool] = [False]  # whether a longer token goes on from a node
        for t, rank in ranks.items():
            node = 0
            for byte in t:
                self.grows[node] = True
                after = self.child.get(node << 8 | byte)
                if after is None:
                    after = self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.grows.append(False)
                node = after
            self.ends[node] = rank
        self._spines: dict[int, tuple[list, list]] = {}
        self._whole: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self.states: dict[tuple[int, bytes], State] = {}
        self.start = self.states[-1, b""] = State(-1, b"", (), (), ((0, 0, -1),))
        self.pieces: dict[str, bytes] = {}

    # -- what merges leave apart ---------------------------------------------------------------------

    def derivation(self, piece: bytes) -> list[tuple[int, list[bytes]]]:
        """The merge steps of a short piece: (rank, parts after it); the definition that all else must agree with."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        steps = [(-1, list(parts))]
        while len(parts) > 1:
            found = [(self.ranks.get(parts[i] + parts[i + 1]), i) for i in range(len(parts) - 1)]
            found = [x for x in found if x[0] is not None]
            if not found:
                break
            rank, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            steps.append((rank, list(parts)))
        return steps

    def spines(self, token: int) -> tuple[list, list]:
        """How the first and the last part of a token grow: lists of (rank when made, bytes)."""
        if (got := self._spines.get(token)) is None:
            left: list = []
            right: list = []
            for rank, parts in self.derivation(self.bytes_of[token]):
                if not left or left[-1][1] != parts[0]:
                    left.append((rank, parts[0]))
                if not right or right[-1][1] != parts[-1]:
                    right.append((rank, parts[-1]))
            self._whole[token] = len(self.derivation(self.bytes_of[token])[-1][1]) == 1
            got = self._spines[token] = (left, right)
        return got

    def reachable(self, token: int) -> bool:
        """Whether merges of the token's own bytes give the token."""
        if (got := self._whole.get(token)) is None:
            self.spines(token)
            got = self._whole[token]
        return got

    def stable(self, a: int, b: int) -> bool:
        """Whether a, b stay two tokens when the merges of their joined bytes run by rank."""
        if a < 0:
            return True
        key = a << 32 | b
        if (got := self._pairs.get(key)) is None:
            xs, ys = self.spines(a)[1], self.spines(b)[0]
            i = j = 0
            got = True
            get = self.ranks.get
            while True:
                ra = xs[i + 1][0] if i + 1 < len(xs) else 1 << 40
                rb = ys[j + 1][0] if j + 1 < len(ys) else 1 << 40
                across = get(xs[i][1] + ys[j][1])
                if across is not None and across < ra and across <= rb:
                    got = False
                    break
                if ra == rb == 1 << 40:
                    break
                if ra <= rb:
                    i += 1
                else:
                    j += 1
            if len(self._pairs) >= self.MOST_PAIRS:
                self._pairs.clear()
            self._pairs[key] = got
        return got

    # -- the machine ---------------------------------------------------------------------------------

    def state(self, before: int, pending: bytes, token: tuple, start: tuple, opens: tuple) -> State:
        """The one state of this name; all else follows from before and pending."""
        key = (before, pending)
        if (got := self.states.get(key)) is None:
            if len(self.states) >= self.MOST_STATES:
                self.states.clear()
                self.start.arcs.clear()
                self.states[-1, b""] = self.start
            got = self.states[key] = State(before, pending, token, start, opens)
        return got

    def arc(self, at: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Next state and what is emitted on the way."""
        child, ends, grows = self.child.get, self.ends, self.grows
        token, begin, opens = None, -1, []
        for place in at.opens:  # the longest suffix first
            i, node, back = place
            node = child(node << 8 | byte)
            if node is not None:
                if token is None and (t := ends[node]) >= 0 and self.reachable(t) and self.stable(back, t):
                    token, begin = t, i
                if grows[node]:
                    opens.append((i, node, back))
        tokens, starts = (*at.token, token), (*at.start, begin)
        n = len(tokens)
        if token is not None:
            opens.append((n, 0, token))
        meet = opens[0][0]
        if meet:
            for i, _, _ in opens:  # where the open paths part, seen from their ends
                while i != meet:
                    if i > meet:
                        i = starts[i - 1]
                    else:
                        meet = starts[meet - 1]
        if not meet:
            return self.state(at.before, at.pending + bytes((byte,)), tokens, starts, tuple(opens)), ()
        emitted: list[int] = []
        i = meet
        while i:
            emitted.append(tokens[i - 1])
            i = starts[i - 1]
        emitted.reverse()
        rest = (at.pending + bytes((byte,)))[meet:]
        return self.state(emitted[-1], rest, tokens[meet:], tuple(i - meet for i in starts[meet:]), tuple((i - meet, k, t) for i, k, t in opens)), tuple(emitted)

    def feed(self, at: State, data: bytes, out: list[int]) -> State:
        """Reads bytes, appends the tokens that are certain by now and returns the state."""
        for byte in data:
            step = at.arcs.get(byte)
            if step is None:
                step = at.arcs[byte] = self.arc(at, byte)
            at, emitted = step
            if emitted:
                out.extend(emitted)
        return at

    def feed_short(self, data: bytes) -> list[int]:
        """All tokens of a short piece: by arcs where there are any, simulated from the first new one on."""
        at, out = self.start, []
        for n, byte in enumerate(data):
            step = at.arcs.get(byte)
            if step is None:
                if byte not in at.missed:
                    at.missed.add(byte)
                    self._simulate(at, data[n:], out)
                    return out
                step = at.arcs[byte] = self.arc(at, byte)
            at, emitted = step
            if emitted:
                out.extend(emitted)
        self.flush(at, out)
        return out

    def _simulate(self, at: State, rest: bytes, out: list[int]) -> None:
        """What arcs would do for the rest of a piece, without making states."""
        child, ends, grows, known = self.child.get, self.ends, self.grows, self._pairs.get
        token, start, opens = list(at.token), list(at.start), at.opens
        n = len(token)
        for byte in rest:
            got, begin, after = None, -1, []
            for i, node, back in opens:
                node = child(node << 8 | byte)
                if node is not None:
                    if got is None and (t := ends[node]) >= 0 and self.reachable(t):
                        apart = True if back < 0 else known(back << 32 | t)
                        if apart is None:
                            apart = self.stable(back, t)
                        if apart:
                            got, begin = t, i
                    if grows[node]:
                        after.append((i, node, back))
            n += 1
            token.append(got)
            start.append(begin)
            if got is not None:
                after.append((n, 0, got))
            opens = after
        tail = []
        while n:
            tail.append(token[n - 1])
            n = start[n - 1]
        out.extend(reversed(tail))

    def flush(self, at: State, out: list[int]) -> None:
        """The piece ends: the tokens of what is pending."""
        tail = []
        i = len(at.pending)
        while i:
            tail.append(at.token[i - 1])
            i = at.start[i - 1]
        out.extend(reversed(tail))

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) <= self.LONG_PIECE:
            return self.feed_short(piece)
        out: list[int] = []
        self.flush(self.feed(self.start, piece, out), out)
        return out

    def packed(self, piece: str) -> bytes:
        """encode_piece as little-endian unsigned 32-bit ids; short pieces are kept."""
        got = self.pieces.get(piece)
        if got is None:
            got = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
            if len(piece) <= self.LONG_PIECE:
                if len(self.pieces) >= self.MOST_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got


#: Next state of the UTF-8 machine: (first byte from, to, state after it), and for each state the bytes that may follow.
_LEADS = ((0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7))
_FOLLOW = {1: (0x80, 0xBF, 0), 2: (0xA0, 0xBF, 1), 3: (0x80, 0xBF, 1), 4: (0x80, 0x9F, 1), 5: (0x90, 0xBF, 3), 6: (0x80, 0xBF, 3), 7: (0x80, 0x8F, 3)}


class StreamDecoder:
    """Token ids in, text out as soon as its characters are complete."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that later bytes may finish."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                state = next((s for lo, hi, s in _LEADS if lo <= b <= hi), -1)
                for c in data[len(data) - back + 1 :]:
                    if state <= 0:
                        return 0
                    lo, hi, after = _FOLLOW[state]
                    state = after if lo <= c <= hi else -1
                return back if state > 0 else 0
        return 0

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        keep = self.unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


@lru_cache(maxsize=2)
def machine(rank_path: str) -> Transducer:
    out = Transducer(load_ranks(rank_path))
    gc.freeze()  # the tables hold no cycles; looking through them again and again takes a third of the time
    gc.set_threshold(200_000, 50, 100)
    return out


CLEANERS["bpe"] = machine.cache_clear


def encode_texts(texts: Iterable[str | None], rank_path: str, pattern: str) -> Iterator[bytes]:
    """For each text its ids as little-endian unsigned 32-bit integers."""
    m, split = machine(rank_path), compiled_pattern(pattern)
    kept, packed = m.pieces, m.packed
    for text in texts:
        if not text:
            yield b""
            continue
        pieces = split.findall(text)
        try:
            yield b"".join([kept[p] for p in pieces])
        except KeyError:
            yield b"".join([kept.get(p) or packed(p) for p in pieces])


#: Ids that a decoder takes in one step.
DECODE_STEP = 1 << 16


def decode_ids(ids: np.ndarray, rank_path: str) -> Iterator[str]:
    """The text of the ids, in parts, by the streaming decoder."""
    d = StreamDecoder(machine(rank_path).bytes_of)
    for i in range(0, len(ids), DECODE_STEP):
        yield d.feed(ids[i : i + DECODE_STEP].tolist())
    if rest := d.finish():
        yield rest


def bpe_encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>), one for each row of docs; null or empty text: an empty array."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        coded = [np.frombuffer(x, "<i4") for x in encode_texts(b.column(1).to_pylist(), rank_path, pattern)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
        flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, ids array<int>", "bpe")


def bpe_decode(coded: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) of rows with arrays of ids; a null array: an empty text."""
    kind = coded.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["".join(decode_ids(np.array(x if x is not None else [], np.int64), rank_path)) for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return map_batches(coded.select(id_col, ids_col), run, f"{id_col} {kind}, text string", "bpe")


def bpe_digest(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes the ids again and returns digests of both: one row for each row of docs, in one pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, ids_sha, text_sha = [], [], []
        texts = (x.as_py() for x in b.column(1))
        for coded in encode_texts(texts, rank_path, pattern):
            ids = np.frombuffer(coded, "<u4")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(coded).hexdigest())
            h = hashlib.sha256()
            for part in decode_ids(ids, rank_path):
                h.update(part.encode())
            text_sha.append(h.hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe")
