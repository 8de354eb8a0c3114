"""Token files, token counts and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_cases import no_docs, odd_docs, rows
from tokenizers import Tokenizer

from vectorloom.llm import codes, packing, transducer
from vectorloom.llm.tokens import Encoder

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [
    "a", "b", " ", "  ", "\n", "\t", "'s", "'", "'re", "'ll", "'v", "1", "!", "\xa0", "é", "\u0301", "<|endoftext|>",
    "Σ", "İ", "\x1c", "\x85", "\u3000", "ǅ", "½", "the", "ing", "s", "  \n ", "\r", "日本", "😀", "\u200b", "Hello,", "x.\nY",
]


def strings(n, seed):
    pick = random.Random(seed)
    return ["".join(pick.choices(ALPHABET, k=pick.randint(0, 12))) for _ in range(n)]


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path):
    own, library = Encoder(path), Tokenizer.from_file(path)
    for text in strings(4000, 1):
        expected = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.encode(text) == expected, text


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_plain_words_need_no_translation(path):
    class Blank(dict):
        def __missing__(self, byte):
            raise AssertionError(f"byte {byte} is translated")

    own, library = Encoder(path), Tokenizer.from_file(path)
    own.letters = Blank({32: own.letters[32]})
    for text in ("Some plain words", "words, with marks.\nAnd lines; too!"):
        expected = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.encode(text) == expected


def test_transducer_equals_library():
    counter, library = transducer.Counter(BYTE), Tokenizer.from_file(BYTE)
    texts = strings(4000, 2) + ["a" * 3000, "ab" * 2000, "x y " * 400_000]
    got = counter.count(texts)
    for text, n in zip(texts[:-1], got):
        assert n == len(library.encode(text, add_special_tokens=False).ids), text[:50]
    assert got[-1] == 800_001  # "x", " y", " x", … and the last blank
    # Chunk boundaries and a machine that starts anew change nothing.
    counter.merges.reset()
    assert (counter.count(texts[:500]) == got[:500]).all()


def test_prefix_scan_composes_maps():
    pick = np.random.default_rng(3)
    maps = pick.integers(0, 5, (37, 5))
    emitted = pick.integers(0, 9, (37, 5))
    scanned, totals = transducer.compose(maps, emitted)
    state, total = np.arange(5), np.zeros(5, int)
    for k in range(37):
        total, state = total + emitted[k][state], maps[k][state]
        assert (scanned[k] == state).all() and (totals[k] == total).all()


@pytest.mark.parametrize("top", [200, 60_000, 1 << 32])
def test_segment_random_access(top):
    ids = np.random.default_rng(top).integers(0, top, 5000).astype("<u4")
    data = codes.encode_segment(ids)
    segment = codes.Segment(lambda offset, size: data[offset : offset + size], 0)
    assert [segment.token(i) for i in range(0, 5000, 7)] == ids[::7].tolist()
    for start, stop in ((0, 5000), (17, 18), (511, 1025), (4999, 5000)):
        assert (segment.tokens(start, stop) == ids[start:stop]).all()


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(codes, "SEGMENT", 1000)
    manifest = codes.write_tokens(odd_docs(spark), BYTE, files=3)
    got = sorted(codes.read_documents(spark, manifest).drop("file").collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(BYTE)
    docs = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for row, doc in zip(got, docs, strict=True):
        ids = ids_of(library, doc[1], 0)
        assert tuple(row) == (doc[0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    whole = [row for row in manifest.orderBy("part").collect()]
    file = codes.TokenFile(whole[-1].file)
    k = len(file) - 1
    assert [file.token(i) for i in range(file.starts[k], file.starts[k + 1])] == file.document(k).tolist()
    assert codes.read_documents(spark, codes.write_tokens(no_docs(spark), BYTE)).count() == 0


def test_counts_of_odd_rows(spark):
    library = Tokenizer.from_file(BYTE)
    got = transducer.count_tokens(odd_docs(spark), BYTE).collect()
    expected = []
    for doc in rows():
        n = len(library.encode(doc[1] or "", add_special_tokens=False).ids)
        expected.append((doc[0], len((doc[1] or "").encode()), n, n > 512))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert transducer.count_tokens(no_docs(spark), BYTE).count() == 0


@pytest.mark.parametrize("tokens", [1, 2, 67, 1023, 1024, 1025, 1500, 2047, 2048, 2049, 9000])
def test_piece_lengths(tokens):
    lengths = packing.piece_lengths(tokens, 2048, 1 / 64)
    assert sum(lengths) == tokens and all(
        2048 // n * n >= 2048 * (1 - 1 / 64) for n in lengths
    )


def test_packing_of_odd_rows(spark):
    library = Tokenizer.from_file(WORD)
    got = packing.pack(odd_docs(spark), WORD).collect()
    expected = sorted(len(ids_of(library, d[1], 1)) for d in rows())
    ids = defaultdict(list)
    for doc in rows():
        ids[doc[0]].append(ids_of(library, doc[1], 1))
    assert sum(r.length for r in got) == sum(expected)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        assert any(
            zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens
            for x in ids[r.doc_id]
        )
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for doc_id in {k for k, v in ids.items() if len(v) == 1}:
        at = 0
        for r in sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start):
            assert r.start == at
            at += r.length
    short = sum(2048 - sum(r.length for r in p) for p in sequences.values())
    assert short < 2048
    assert packing.pack(no_docs(spark), WORD).count() == 0
