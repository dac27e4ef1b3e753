"""Encoders, shards, byte-level BPE and packing against their libraries and brute force."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corrobora.llm import byte_bpe, packing, token_shards
from corrobora.llm.encoding import vocabulary_path, word_encoder
from corrobora.session import scratch_path

TEXTS = ["", None, "plain words here", "a  b", " lead", "trail ", "x\n\ny", "it's we'll, 'twas.", "<|endoftext|> <|endoftext|>", "a <|endoftext|> b\nc<|endoftext|>d", "é. ü, 1. 2,",
         "日本語 テキスト🙂", "tab\there", "a b c", "word " * 3000, "\n", "Long.\nLines. Of text, and more.\n" * 300, "x" * 2000]
DOCS = [(k * 3, t) for k, t in enumerate(TEXTS)]


def library_ids(text):
    return untouched().encode(text or "", add_special_tokens=False).ids


@lru_cache
def untouched():
    """The library as it loads the file, apart from the encoder's."""
    return Tokenizer.from_file(vocabulary_path())


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab.,'s \n\té1🙂_ "), max_size=40))
def test_words_encode_as_the_whole_text(text):
    assert np.frombuffer(word_encoder(vocabulary_path()).encode(text), "<u4").tolist() == library_ids(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500), st.integers(0, 300))
def test_wavelet_matrix(ids, value):
    matrix = token_shards.WaveletMatrix.build(np.array(ids, np.uint32), 9)
    assert matrix.ids().tolist() == ids
    assert [matrix.access(k) for k in range(0, len(ids), 97)] == ids[::97]
    assert matrix.occurrences(value) == [k for k, x in enumerate(ids) if x == value]
    assert matrix.count(value, len(ids) // 3, len(ids) // 2) == ids[len(ids) // 3 : len(ids) // 2].count(value)
    with pytest.raises(IndexError):
        matrix.access(len(ids))
    with pytest.raises(IndexError):
        matrix.select(value, ids.count(value))


def test_shards_round_trip(spark):
    rows = [(d, t, d) for d, t in DOCS] + [(None, "no id", 1), (3, "same id", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, part long").repartition(5)
    path = scratch_path(spark, "shards")
    token_shards.write_shards(frame, path, vocabulary_path(), shard_ids=500)
    got = sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in token_shards.read_documents(spark, path).collect())
    assert [g[1] is None for g in got] == [True] + [False] * (len(rows) - 1)
    assert [g[1] for g in got[1:]] == sorted([d for d, _ in DOCS] + [3])
    place = 0
    want = {d: library_ids(t) + [0] for d, t, _ in rows if d != 3}
    for start, doc_id, ids in got:
        assert start == place and (doc_id == 3 or ids == want[doc_id])
        place += len(ids)
    value = library_ids(" words")[0]
    found = sorted(map(tuple, token_shards.find_id(spark, path, value).collect()), key=str)
    truth = [(d, k) for d, t, _ in rows for k, x in enumerate(library_ids(t)) if x == value]
    assert found == sorted(truth, key=str)
    assert sum(r.n for r in token_shards.count_id(spark, path, value).collect()) == len(truth)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    path = scratch_path(spark, "shards")
    token_shards.write_shards(frame, path, vocabulary_path())
    assert token_shards.read_documents(spark, path).collect() == []
    assert packing.pack(frame, vocabulary_path()).collect() == []
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe.digest_documents(frame, ranks, public_tokenizers.PATTERN).collect() == []


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.byte_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_bpe_as_the_library(bpe, reference):
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abcdeinrst ") for _ in range(800)) for _ in range(10)] + ["ü" * 900]
    ids = [np.frombuffer(x, "<u4") for x in bpe.encode(texts)]
    assert [x.tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]
    assert bpe.decode(ids) == [t.encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=1, max_size=40).filter(lambda t: not any("\ud800" <= c <= "\udfff" for c in t)))
def test_long_matches_contract_alike(text):
    bpe = byte_bpe.byte_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for match in bpe.pattern.findall(text):
        bpe._contract([match])
        assert bpe.memory[match] == bpe._contract_long(match)


def _runs(n, length, alphabet, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=length)) for _ in range(n)]


CJK = [chr(c) for c in range(0x4E00, 0x5000)]
LONG_RUNS = {
    "runs of 20": "，".join(_runs(25_000, 20, CJK)),
    "runs of 60": "，".join(_runs(1_000, 60, CJK)),
    "words of 100": " ".join(_runs(5_000, 100, "abcdefghijklmnopqrstuvwxyz")),
    "runs of 600": " ".join(_runs(40, 600, CJK)),
    "beyond the heap's length": "x".join(_runs(3, 3_000, "abcdefgh")) + " " + "ab" * 20_000,
}


@pytest.mark.parametrize("name", LONG_RUNS)
def test_long_runs_stay_within_the_memory_of_the_database(bpe, reference, name):
    text = LONG_RUNS[name]
    ids = [np.frombuffer(x, "<u4") for x in bpe.encode([text])]
    assert ids[0].tolist() == reference.encode_ordinary(text)
    assert bpe.decode(ids) == [text.encode()]
    assert bpe.encode_shown(["", text])[1] == ["", ",".join(map(str, ids[0].tolist()))]


def test_decoding_of_millions_of_ids(bpe):
    one = np.frombuffer(bpe.encode(["hello wörld"])[0], "<u4")
    ids = np.tile(one, 4_000_000 // len(one) + 1)
    assert bpe.decode([ids[:0], ids, one]) == [b"", "hello wörld".encode() * (len(ids) // len(one)), "hello wörld".encode()]


def test_digests(spark, reference):
    frame = spark.createDataFrame([*DOCS, (None, "x y"), (0, "again")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = byte_bpe.digest_documents(frame, path, public_tokenizers.PATTERN).collect()
    want = []
    for d, t in [*DOCS, (None, "x y"), (0, "again")]:
        ids = reference.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = byte_bpe.encode_documents(frame, path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in [*DOCS, (None, "x y"), (0, "again")])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0.0, 1.0, 5.0])), min_size=1, max_size=12))
def test_cuts_are_optimal(steps):
    """Against all choices of cuts, for a window of 11."""
    places = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    penalties = np.array([0.0] + [p for _, p in steps])
    window = 11

    def cost(length):
        return 0 if length & (length - 1) == 0 else window - length

    best = [0.0] + [np.inf] * len(steps)
    for j in range(1, len(places)):
        for i in range(j):
            if places[j] - places[i] <= window:
                best[j] = min(best[j], best[i] + cost(int(places[j] - places[i])) + penalties[j])
    cuts = packing.choose_cuts(places, penalties, window)
    total, last = 0.0, 0
    for c in cuts:
        total += cost(int(places[c] - places[last])) + penalties[c]
        last = c
    assert last == len(steps) and total == pytest.approx(best[-1])


def test_pieces_hold_every_id_once(spark):
    frame = spark.createDataFrame([*DOCS, (None, "x y"), (0, "again")], "doc_id long, text string").repartition(3)
    pieces = packing.pack(frame, vocabulary_path(), problem=3000, with_ids=True).collect()
    whole = {}
    for p in sorted(pieces, key=lambda p: (str(p.doc_id), p.start)):
        assert p.length * 4 == len(p.ids) and p.ids_crc32 == zlib.crc32(bytes(p.ids))
        whole.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    texts = {(d, len(library_ids(t)) + 1): t for d, t in [*DOCS, (None, "x y"), (0, "again")]}
    assert whole.keys() == texts.keys()
    for key, parts in whole.items():
        assert np.frombuffer(b"".join(bytes(p.ids) for p in parts), "<u4").tolist() == library_ids(texts[key]) + [0]
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0] + [p.length for p in parts])[:-1].tolist()
        assert sum(p.length for p in parts) <= packing.WINDOW
    padded = sum(1024 - n for n in (sum(p.length for p in s) for s in sequences.values()) if n & (n - 1))
    assert padded < 0.35 * sum(p.length for p in pieces)
