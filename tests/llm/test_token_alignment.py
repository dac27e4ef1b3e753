"""Cross-tokenizer alignment against the two libraries on whole texts and a plain double loop."""

import hashlib
from collections import Counter
from functools import lru_cache

import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corrobora.llm import token_alignment as ta
from corrobora.llm.encoding import vocabulary_path

A, B = vocabulary_path(), vocabulary_path(ta.PIECES)
TEXTS = [None, "", "plain words here", "plain words there, too", " lead", "trail ", "a  b\t c", "x\ny\n\nz", "it's 2,000.5 km", "<|endoftext|> </s> <s>",
         "a▁b", "日本語 テキスト🙂", "é. ü é", "word " * 3000, "x" * 5000, "\n", " ", "ｆｕｌｌ \x00 ​   z", "plain words here", "1\n2 \n3\n 4"]


@pytest.fixture(scope="module")
def libraries():
    return untouched()


@lru_cache
def untouched():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def whole(text, libraries):
    """Groups of a whole text as id lists, or None where it has no tokens."""
    a, b = libraries
    shown = ta.aligner(A, B)
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a, parts_b = [shown.bytes_a[k] for k in ids_a], [shown.bytes_b[k] for k in ids_b]
    if b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
        return None
    at_a, at_b, place = {}, {}, 0
    for k, p in enumerate(parts_a):
        at_a[place := place + len(p)] = k
    place = 0
    for k, p in enumerate(parts_b):
        at_b[place := place + len(p)] = k
    groups, i, j = [], 0, 0
    for end in sorted(at_a.keys() & at_b.keys()):
        groups.append((ids_a[i : at_a[end] + 1], ids_b[j : at_b[end] + 1]))
        i, j = at_a[end] + 1, at_b[end] + 1
    return groups


def expected(texts, libraries):
    found = [whole(t, libraries) for t in texts]
    counts = Counter((a[-1], b[-1]) for g in found if g for a, b in g)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for g in found:
        links = [(a[-1], b[-1]) for a, b in g or []]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        digest = hashlib.sha256(shown.encode()).hexdigest() if g else ""
        rows.append((sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(links), len(links),
                     sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), unique=True), st.lists(st.integers(0, 60), unique=True))
def test_galloping_finds_the_common_values(a, b):
    a, b = sorted(a), sorted(b)
    assert ta.common_ends(a, b) == [(a.index(v), b.index(v)) for v in sorted({*a} & {*b})]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab.,'s \n\té1🙂_ ▁ 　<>"), min_size=1, max_size=40))
def test_units_align_as_the_whole_text(text):
    groups = whole(text, untouched())
    found = ta.aligner(A, B).documents([text])[0]
    assert ";".join(f[3] for f in found) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_documents(spark, libraries):
    clash = "doc_id long, text string, tag string, link string, links string, times string, n_a string, b string, total string"
    rows = [(None if k == 2 else k, t, *"tnlxabc") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, clash).repartition(5)
    got = {(r.doc_id if r.doc_id is not None else 2): tuple(r[c] for c in COLUMNS) for r in ta.alignment(docs, A, B).collect()}
    assert [got[k] for k in range(len(TEXTS))] == expected(TEXTS, libraries)
    assert got[0] == got[1] == got[10] == (0, 0, 0, 0, 0, 0, "")


def test_groups_and_empty_table(spark, libraries):
    docs = spark.createDataFrame([(1, "plain words"), (1, "plain words")], "doc_id long, text string")
    shown = {r.groups for r in ta.align_documents(docs, A, B, with_groups=True).collect()}
    assert shown == {";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in whole("plain words", libraries))}
    assert [r.count_sum for r in ta.alignment(docs, A, B).collect()] == [r[5] for r in expected(["plain words"] * 2, libraries)]
    assert ta.alignment(docs.limit(0), A, B).collect() == []


def test_large_count_tables_take_the_salted_join(spark, libraries, monkeypatch):
    monkeypatch.setattr(ta, "lookup_join", lambda *a, **k: __import__("corrobora.operators.joins").operators.joins.lookup_join(*a, **k, max_bytes=0))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in ta.alignment(docs, A, B).collect()}
    assert [got[k] for k in range(len(TEXTS))] == expected(TEXTS, libraries)


class Counted:
    """A library that counts the texts given to it."""

    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode(texts, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **options)


def shown(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])


def test_words_go_to_the_libraries_together_and_odd_ones_by_themselves(libraries):
    tool = ta.Aligner(A, B)
    tool.a, tool.b = Counted(tool.a), Counted(tool.b)
    words = ["".join(chr(97 + k // 26**i % 26) for i in range(3)) for k in range(640)]
    assert [shown(whole(w, libraries)) for w in words] == [f[0][3] for f in tool.documents(words)]
    assert tool.a.texts == tool.b.texts == 640 // ta.TOGETHER
    odd = ["freshﬁ", "newword", "日本", "ｆｕ", "½", "cafés,", "ẞß", "soft­hyphen"]  # some change their bytes in B
    found = tool.documents(odd + [" ".join(odd[1:3])])
    assert [";".join(f[3] for f in x) for x in found] == [shown(whole(t, libraries)) for t in odd + [" ".join(odd[1:3])]]


def test_units_met_again_outlast_a_full_memory(libraries, monkeypatch):
    monkeypatch.setattr(ta, "MEMORY", 3)
    tool = ta.Aligner(A, B)
    tool.a, tool.b = Counted(tool.a), Counted(tool.b)
    tool.documents(["these words come again and again"])
    texts = tool.a.texts
    for _ in range(3):
        assert ";".join(f[3] for f in tool.documents(["these words come again"])[0]) == shown(whole("these words come again", libraries))
    assert tool.a.texts == tool.b.texts == texts
    for k in range(5):
        tool.documents([f"{'abcde'[k]}{n} other words" for n in range(4)])
    assert len(tool) + len(tool.before) < 20
