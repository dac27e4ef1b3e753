"""The classifier and the rules: held-out accuracy, hand-made counts, brute force, odd tables."""

import re
import zlib

import numpy as np
import pytest

from corrobora.llm import quality_classifier as qc, quality_rules as qr
from corrobora.llm.common import load

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = qc.quality_query(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in load(spark, SF, "labels").collect()}
    assert len(rows) == load(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    aside = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(aside) > 80 and sum(p == y for p, y in aside) > 0.95 * len(aside)


def test_discriminant_against_plain_formula():
    rng = np.random.default_rng(0)
    d = len(qc.STATISTICS)
    x = {k: rng.normal(k, 1 + k, (200, d)) @ rng.normal(size=(d, d)) for k in (0, 1)}
    model = qc.fit_moments({k: (200.0, v.sum(0), v.T @ v) for k, v in x.items()}, 0.3, 0.05)
    points = np.vstack([x[0][:5], x[1][:5]])
    z = (points - model.centre) / model.scale
    want = []
    for mean, factor, weight in zip(model.means, model.factors, model.weights):
        cov = factor @ factor.T
        gap = z - mean
        want.append(weight - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    assert model.log_densities(points) == pytest.approx(np.array(want).T, rel=1e-6)


def test_classifier_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "x " * 50000, "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert qc.accept(docs, none).columns == docs.columns and qc.accept(docs, none).count() == 3
    assert qc.accept(docs.limit(0), load(spark, SF, "labels")).collect() == []
    twice = load(spark, SF, "labels").limit(50)
    assert qc.fit(load(spark, SF, "documents"), twice.union(twice)).means is not None


def _moments(texts, labels):
    x, y = qc.statistics_matrix(texts), np.array(labels)
    sums = {k: (float((y == k).sum()), x[y == k].sum(0), x[y == k].T @ x[y == k]) for k in (0, 1)}
    return {k: (n, np.round(a, 9), np.round(b, 9)) for k, (n, a, b) in sums.items()}


TEMPLATES = [f"Order number {k:05d} was shipped today." for k in range(4000)]
DEGENERATE = {
    "8 equal": (["the same text"] * 8, [0, 1] * 4),
    "1000 equal": (["the same text, again and again"] * 1000, [0] * 400 + [1] * 600),
    "two": (["good words in a row", "$$$ ### !!!"], [1, 0]),
    "two alike": (["alike", "alike"], [1, 0]),
    "templates": (TEMPLATES, [k % 2 for k in range(4000)]),
    "empty": (["", None, "", None], [0, 1, 1, 0]),
    "one class flat": (["flat"] * 50 + [f"w{k} " * (k + 1) for k in range(50)], [0] * 50 + [1] * 50),
}


@pytest.mark.parametrize("name", DEGENERATE)
def test_a_fit_never_fails(name):
    texts, labels = DEGENERATE[name]
    model = qc.fit_moments(_moments(texts, labels), 0.5, 0.02)
    scores = model.score(qc.statistics_matrix([*texts, "", "other " * 5000, "x"]))
    assert np.isfinite(scores).all() and (scores >= 0).all() and (scores <= 1).all()
    if name == "two":
        assert scores[0] > 0.5 > scores[1]
    if "equal" in name or "alike" in name:
        assert scores[0] == pytest.approx(sum(labels) / len(labels), abs=1e-3)  # nothing but the prior


def test_few_labels_on_near_equal_texts(spark):
    docs = spark.createDataFrame([(k, f"Order number {k:05d} was shipped.") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    assert qc.accept(docs, labels, least=0.0).count() == 40


TEXTS = [None, "", " \t\n", "one", "a b c d e f g h a b c d e f g h", "x y " * 30, "# | <b> $5 & 50% *", "l1 x\nl1 x\n\n\nl1 x\n \n ",
         "é ü z\x0bq\x0cr", " ".join(f"w{k}" for k in range(30)), "w " * 20000, "same eight words in this very window now " * 2 + "tail"]


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = {}
    for w in windows:
        often[w] = often.get(w, 0) + 1
    hit = {j for k, w in enumerate(windows) if often[w] > 1 for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(hit)


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    assert qr.base_counts(text) == plain_counts(text)


def test_rules_against_brute_force(spark):
    rows = {r.doc_id: r for r in qr.rules_query(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in load(spark, SF, "documents").collect()}
    trusted = {r.doc_id for r in load(spark, SF, "labels").collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    size = 1 << qr.HASH_BITS

    def grams(text):
        data = (text or "").encode()
        out = []
        for k in range(len(data) - 2):
            h = data[k]
            for b in data[k + 1 : k + 3]:
                h = (h * 0x01000193 + b) % 2**32
            out.append(h * 0x9E3779B1 % 2**32 >> 16)
        return out

    raw, target = np.zeros(size), np.zeros(size)
    for d, text in docs.items():
        counts = np.bincount(grams(text), minlength=size)
        raw += counts
        target += counts * (d in trusted)
    ratios = qr.log_ratios(raw, target)
    assert rows.keys() == docs.keys()
    for d, text in docs.items():
        n, chars, symbols, lines, repeats = plain_counts(text)
        g = grams(text)
        score = ratios[g].sum() / (len(g) + qr.CALM) if g else 0.0
        failed = n < 20 or 100 * repeats > 30 * n
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeats, failed)
        assert r.score == pytest.approx(score, abs=1e-6)
        assert r.kept == (not failed and r.score >= qr.LEAST)


def test_rules_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "word " * 25, 2), (2, " ".join(f"w{k}" for k in range(40)), 3)], "doc_id long, text string, bucket int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.bucket for r in qr.accept(docs, labels).collect()] == [3]
    assert qr.accept(docs.limit(0), labels).collect() == []


def test_trusted_counts_cover_every_label(spark):
    """More trusted documents than a bounded sample holds: each counts once, the held-out third never."""
    n = 40_000
    texts = [f"{k * 7919 % 99991:05d}" for k in range(n)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 > 0 as int) as quality")
    raw, target = np.zeros(1 << qr.HASH_BITS), np.zeros(1 << qr.HASH_BITS)
    for k, text in enumerate(texts):
        found = qr.gram_buckets(text.encode())
        np.add.at(raw, found, 1)
        if k % 4 and zlib.crc32(str(k).encode()) % 3 != 1:
            np.add.at(target, found, 1)
    assert qr.fit(docs, labels.union(labels.limit(100))) == pytest.approx(qr.log_ratios(raw, target))
