"""Byte-level BPE (method: lazily determinised transducer, incremental UTF-8 decode).

Encoding.  A byte string has exactly one valid BPE segmentation, and a token
sequence is that one if every adjacent pair is *compatible* (encoding the two
tokens' bytes gives back the pair).  So each prefix has one last token, and the
prefixes form a tree of back pointers.  A prefix is *live* while the bytes
after it can still be the start of a token.  Tokens that the paths of all live
prefixes share can't change any more: the transducer emits them and keeps only
the bytes after them.  A state is therefore (last emitted token, pending
bytes); transitions are worked out when first taken and then reused, so
encoding is one table step a byte with a lookahead of at most the longest
token.  The table of states is emptied when it reaches a fixed size, and that
of encoded words loses the words not met for a while; results don't depend on
that.

Decoding.  Token bytes are gathered as arrays, chunk by chunk, and pass through
a UTF-8 state machine over bytes (with states of their own for the second bytes
after E0, ED, F0 and F4) that hands on whole characters and holds back an
unfinished one, so a stream can be cut anywhere.  Bytes that can't be part of a
character are handed on as they are.

Defined cases: a null or empty text has no tokens; repeated rows get a row
each; an empty table gives no rows; columns other than id and text are
ignored.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MAX_STATES = 400_000
MAX_WORDS = 200_000       # of each of two generations
DECODE_IDS = 1 << 16
NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class State:
    """``prev``: last emitted token.  ``live``: for each live prefix the trie node of the bytes after it and
    its tokens that aren't emitted yet, shortest prefix first.  ``whole``: the tokens of all bytes so far."""

    __slots__ = ("prev", "live", "whole", "next")

    def __init__(self, prev: int | None, live: tuple, whole: tuple | None):
        self.prev, self.live, self.whole = prev, live, whole
        self.next: dict[int, tuple[State, bytes]] = {}


def packed(tokens: tuple) -> bytes:
    return b"".join([t.to_bytes(4, "little") for t in tokens])


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        # the vocabulary as a trie: child of (node, byte), the token that ends in a node, whether it goes on
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]
        for piece, token in ranks.items():
            node = 0
            for byte in piece:
                key = node << 8 | byte
                self.inner[node] = True
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
            self.token_at[node] = token
        self._edges: dict[int, tuple | None] = {}
        self._compatible: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, State] = {}
        self._reset()

    def _reset(self) -> None:
        for state in self.states.values():
            state.next.clear()
        self.states.clear()
        self.root = State(None, ((0, ()),), ())

    def edges(self, token: int) -> tuple[list, list] | None:
        """How a token's first and last part grow while it is merged: lists of (part, rank of the merge
        that ends the part); None if the merge rules never make this token."""
        if token in self._edges:
            return self._edges[token]
        piece, ranks = self.bytes_of[token], self.ranks
        parts = [piece[i:i + 1] for i in range(len(piece))]
        left, right = [], []
        while len(parts) > 1:
            rank, at = min([(ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)])
            if rank == NEVER:
                break
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        made = None if len(parts) > 1 else (left + [(piece, NEVER)], right + [(piece, NEVER)])
        self._edges[token] = made
        return made

    def compatible(self, a: int | None, b: int) -> bool:
        """Whether token b may follow token a (a None: stand first): no merge ever crosses their border."""
        if a is None:
            return self.edges(b) is not None
        ok = self._compatible.get((a, b))
        if ok is None:
            if len(self._compatible) > 4 * self.max_states:
                self._compatible.clear()
            ok = self._compatible[a, b] = self._apart(self.edges(a), self.edges(b))
        return ok

    def _apart(self, ea: tuple, eb: tuple | None) -> bool:
        if eb is None:
            return False
        get = self.ranks.get
        for x, x_ends in ea[1]:
            for y, y_ends in eb[0]:
                rank = get(x + y)
                if rank is not None and rank < x_ends and rank <= y_ends:
                    return False
        return True

    def _step(self, s: State, byte: int) -> tuple[State, bytes]:
        """The transition for one byte."""
        child, token_at, inner = self.child.get, self.token_at, self.inner
        live, whole, prev = [], None, s.prev
        for node, tokens in s.live:
            node = child(node << 8 | byte)
            if node is None:
                continue
            if whole is None:
                token = token_at[node]
                if token >= 0:
                    before = tokens[-1] if tokens else prev
                    fits = self._compatible.get((before, token))
                    if self.compatible(before, token) if fits is None else fits:
                        whole = tokens + (token,)
            if inner[node]:
                live.append((node, tokens))
        if whole is not None:
            live.append((0, whole))
        first, out = live[0][1], b""
        if first:
            shared = len(first)
            for _, tokens in live[1:]:
                shared = min(shared, len(tokens))
                while first[:shared] != tokens[:shared]:
                    shared -= 1
            if shared:
                prev, out = first[shared - 1], packed(first[:shared])
                live = [(node, tokens[shared:]) for node, tokens in live]
                whole = whole and whole[shared:]
        live = tuple(live)
        key = (None if live[0][1] else prev, live)  # the last emitted token matters only to a path that follows it
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State(key[0], live, whole)
        return state, out

    def encode(self, piece: bytes) -> bytes:
        """Ids of one piece of text, as little-endian unsigned 32-bit integers."""
        token = self.ranks.get(piece)
        if token is not None:
            return token.to_bytes(4, "little")
        if len(self.states) > self.max_states:
            self._reset()
        s, out = self.root, b""
        for byte in piece:
            step = s.next.get(byte)
            if step is None:
                step = s.next[byte] = self._step(s, byte)
            s, emitted = step
            if emitted:
                out += emitted
        return out + packed(s.whole)


class TextEncoder:
    """Splits text by the tokenizer's pattern and encodes each match; repeated matches come from a bounded table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_words: int = MAX_WORDS):
        self.machine, self.split, self.max_words = MergeTransducer(ranks), regex.compile(pattern), max_words
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _new(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.machine.encode(piece.encode("utf-8"))
        if len(piece) <= 64:
            if len(self.words) >= self.max_words:
                self.older, kept = self.words, self.older
                kept.clear()
                self.words = kept
            self.words[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        out, new = [], self._new
        pieces = self.split.findall(text)
        for lo in range(0, len(pieces), 4096):       # a full table becomes the older one between two blocks at the latest
            get = self.words.get
            out += [get(p) or new(p) for p in pieces[lo:lo + 4096]]
        return b"".join(out)


def utf8_table() -> np.ndarray:
    """next[state, byte]: 0 between characters, 1 to 3 that many continuation bytes to come, 4 to 7 after a lead byte
    that narrows its second byte, 8 ill-formed."""
    table = np.full((9, 256), 8, np.uint8)
    table[0, :0x80] = 0
    for lo, hi, state in ((0xC2, 0xDF, 1), (0xE1, 0xEC, 2), (0xEE, 0xEF, 2), (0xF1, 0xF3, 3), (0xE0, 0xE0, 4), (0xED, 0xED, 5),
                          (0xF0, 0xF0, 6), (0xF4, 0xF4, 7)):
        table[0, lo:hi + 1] = state
    for state, lo, hi, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1),
                              (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state, lo:hi + 1] = to
    return table


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the whole characters and holds back an unfinished one."""

    step = utf8_table().tolist()

    def __init__(self) -> None:
        self.held = b""

    @classmethod
    def unfinished(cls, data: bytes) -> int:
        """Bytes at the end that begin a character and don't end it: the machine's run from the last lead byte, which
        is at most three bytes back."""
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                state = 0
                for byte in data[-back:]:
                    state = cls.step[state][byte]
                return back if 0 < state < 8 else 0
        return 0

    def feed(self, chunk: bytes) -> bytes:
        data = self.held + chunk
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut]

    def close(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


class TokenBytes:
    """The bytes of all tokens in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = token
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - ends + size, size)
        at += np.arange(len(at))
        return self.flat[at].tobytes()


def decode_stream(ids: np.ndarray, table: TokenBytes, size: int = DECODE_IDS) -> Iterator[bytes]:
    """Whole UTF-8 characters of the ids, chunk by chunk; bytes that never complete come last, as they are."""
    stream = Utf8Stream()
    for lo in range(0, len(ids), size):
        yield stream.feed(table.join(ids[lo:lo + size]))
    yield stream.close()


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple[TextEncoder, TokenBytes]:
    ranks = load_ranks(path)
    return TextEncoder(ranks, pattern), TokenBytes(ranks)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32; null unless ``keep_ids``), ids_sha256, decoded_sha256.

    The rank file is read on the driver and sent along (under 1 MB, a fixed public file).
    """
    spark = docs.sparkSession
    small_batches(spark)
    spark.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = _encoder(SparkFiles.get(name), pattern)
        for batch in batches:
            n, ids_of, sha, decoded = [], [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_of.append(ids if keep_ids else None)
                sha.append(hashlib.sha256(ids).hexdigest())
                back = hashlib.sha256()
                for part in decode_stream(np.frombuffer(ids, "<u4"), table):
                    back.update(part)
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_of, pa.binary()), pa.array(sha), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
