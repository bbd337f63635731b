"""The transducer against the library, and its round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from sourcelens.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(ranks):
    r = random.Random(1)
    tokens = [t.decode("utf-8", "ignore") for t in ranks]
    yield from ["", " ", "\n\n  x", "a" * 3000, "-" * 777, "é" * 500, "日本語" * 90, "<|endoftext|>", "I'll we've 12345"]
    for _ in range(400):
        yield "".join(r.choice("ab éß日本\n\t1'sç🙂👍🏽०ไ") for _ in range(r.randint(0, 80)))
        yield "".join(r.choice(tokens) for _ in range(r.randint(1, 6)))


@pytest.mark.parametrize("max_states", [bpe.MAX_STATES, 10])
def test_ids_are_the_librarys(ranks, library, max_states):
    encoder = bpe.TextEncoder(ranks, P.PATTERN, max_words=50)
    encoder.machine.max_states = max_states
    for text in texts(ranks):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_lookahead_is_bounded_by_the_longest_token(ranks):
    machine = bpe.MergeTransducer(ranks)
    state, emitted = machine.root, 0
    piece = b"international" * 200
    for n, byte in enumerate(piece, 1):
        state, out = state.next.get(byte) or machine._step(state, byte)
        emitted += sum(len(machine.bytes_of[i]) for i in np.frombuffer(out, "<u4").tolist())
        assert n - emitted <= 2 * max(map(len, ranks))


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_streaming_decode_gives_whole_characters(ranks, size):
    encoder, table = bpe.TextEncoder(ranks, P.PATTERN), bpe.TokenBytes(ranks)
    for text in ["é🙂日本 plain " * 9, "🙂" * 50, ""]:
        ids = np.frombuffer(encoder.encode(text), "<u4")
        parts = list(bpe.decode_stream(ids, table, size))
        assert b"".join(parts) == text.encode("utf-8")
        for part in parts:
            part.decode("utf-8")
    broken = bpe.Utf8Stream()
    assert broken.feed(b"a\xf0\x9f") == b"a" and broken.close() == b"\xf0\x9f"


def test_the_state_machine_holds_back_beginnings_of_characters_only():
    """Ill-formed input too: overlong forms, surrogates, beyond the last code point, lone continuation bytes."""
    r = random.Random(8)
    odd = [b"\xe0\x80", b"\xe0\xa0", b"\xed\xa0", b"\xed\x9f", b"\xf0\x8f", b"\xf0\x90\x80", b"\xf4\x90", b"\xf4\x8f\xbf", b"\xc1", b"\xf5",
           b"\x80\x80", b"\xc3", b"a", "é日🙂".encode()]
    begun = {c[:k] for c in (chr(p).encode() for p in range(0x80, 0x110000) if not 0xD800 <= p < 0xE000) for k in range(1, len(c))}
    for _ in range(3000):
        stream = bpe.Utf8Stream()
        fed = out = b""
        for _ in range(r.randint(1, 6)):
            part = r.choice(odd) if r.random() < 0.7 else bytes(r.randrange(256) for _ in range(r.randint(0, 3)))
            fed += part
            out += stream.feed(part)
            assert stream.held == next((fed[-k:] for k in (3, 2, 1) if fed[-k:] in begun), b""), fed
        assert out + stream.close() == fed


def test_every_row_of_an_odd_table(odd_docs, no_docs, library):
    want = {}
    for r in odd_docs.collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
        want[r.doc_id] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = bpe.encode(odd_docs, PATH, P.PATTERN).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id]
        assert hashlib.sha256(bytes(r.ids)).hexdigest() == r.ids_sha256
    assert bpe.encode(no_docs, PATH, P.PATTERN).count() == 0
