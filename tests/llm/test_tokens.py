"""Token files (op 1), byte-level BPE (op 4)."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from wardlight.llm import bpe_fst, token_files
from wardlight.llm.common import Memo

from .util import SCHEMA, corpus, frame

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
ALPHABET = list("abcdehinorST  \n\t'ABC019.,!\xa0\x85\x1c\x1f　é\u0301\u0300µªÀÞß²½\u200b好😀ѣ")


def test_codes_give_random_access():
    rng = np.random.default_rng(0)
    for top in (10, 300, 70_000, 1 << 30):
        ids = rng.integers(0, top, 5000).astype(np.uint32)
        codes = token_files.Codes(token_files.pack_codes(ids))
        at = rng.integers(0, 5000, 700)
        assert (codes.get(at) == ids[at]).all() and (codes.all() == ids).all()
    assert len(token_files.Codes(token_files.pack_codes(np.zeros(0, np.uint32))).all()) == 0


def test_text_encoder_equals_tokenizer():
    encoder, rnd = token_files.TextEncoder(WORDS), random.Random(3)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|> a", "don't 'S"]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_file_round_trip(spark):
    rows = corpus()
    rows += [rows[3], (None, "null id", *rows[0][2:])]
    got = token_files.token_file_digest(frame(spark, rows), WORDS).collect()
    tokenizer, start = Tokenizer.from_file(WORDS), 0
    for r, row in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), sorted(got, key=lambda g: g["start"])):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        assert tuple(row) == (r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_file_digest(spark.createDataFrame([], SCHEMA), WORDS).count() == 0


def test_damaged_segment_is_refused():
    blob = bytearray(token_files.pack_segment([1], [2], np.array([5, 1], np.uint32)))
    blob[-1] ^= 1
    try:
        token_files.open_segment(bytes(blob))
        raise AssertionError("accepted")
    except ValueError:
        pass


def test_transducer_equals_tiktoken():
    ranks = bpe_fst.read_ranks(RANKS)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces, rnd = bpe_fst.Pieces(ranks, P.PATTERN), random.Random(4)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(plain.decode([rnd.randrange(50256)]) for _ in range(6)) for _ in range(1000)]
    texts += [r[1] or "" for r in corpus()]
    for t in texts:
        assert np.frombuffer(pieces.encode(t), "<u4").tolist() == plain.encode_ordinary(t)


def test_bounded_states_and_memo_change_nothing(monkeypatch):
    ranks = bpe_fst.read_ranks(RANKS)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe_fst, "MAX_STATES", 20)
    monkeypatch.setattr(bpe_fst, "MAX_PIECES", 5)
    pieces = bpe_fst.Pieces(ranks, P.PATTERN)
    for _, t, *_ in corpus()[:60]:
        assert np.frombuffer(pieces.encode(t), "<u4").tolist() == plain.encode_ordinary(t or "")
    assert len(pieces) <= 5 and len(pieces.old) <= 5 and len(pieces.transducer.states) <= 20
    assert isinstance(pieces, Memo)


def test_stream_cut_anywhere_equals_whole():
    rnd = random.Random(5)
    for _ in range(500):
        raw = "".join(rnd.choices("aé好😀", k=8)).encode() if rnd.random() < .5 else rnd.randbytes(12)
        stream, at, out = bpe_fst.Utf8Stream(), 0, ""
        while at < len(raw):
            step = rnd.randint(1, 4)
            out += stream.feed(raw[at:at + step])
            at += step
        assert out + stream.close() == raw.decode("utf-8", "replace")


def test_encode_decode_documents(spark):
    rows = corpus()
    rows += [rows[0], (None, "null id", *rows[0][2:])]
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_fst.read_ranks(RANKS), special_tokens={})
    got = bpe_fst.encode_decode(frame(spark, rows), RANKS, P.PATTERN).collect()
    want = sorted((str(r[0]), np.array(plain.encode_ordinary(r[1] or ""), "<u4").tobytes(), r[1] or "") for r in rows)
    assert sorted((str(g["doc_id"]), bytes(g["ids"]), g["decoded"]) for g in got) == want
    assert bpe_fst.encode_decode(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0


def test_a_worker_keeps_one_costly_object():
    from wardlight.llm.common import held, release
    made = []

    def make():
        made.append([])
        return made[-1]
    assert held(("a",), make) is held(("a",), make) and len(made) == 1
    assert held(("b",), make) is made[1] and held(("a",), make) is made[2]
    release()
    assert held(("a",), make) is made[3]
    release()
