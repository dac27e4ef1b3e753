import hashlib
import random

import pytest

from corrobora.llm import fingerprints as fp


def test_documents_and_their_edits(spark):
    rows = [(3, "Ünï cödé text 🙂 and more words", "a"), (1, "one two three four five six seven eight", "b"), (7, None, "c"), (9, "", "c"),
            (12, "x", "d"), (20, "word " * 9000 + "end", "e"), (21, "word " * 9000 + "end", "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in fp.fingerprint_documents(frame).collect()}
    texts = [(d, t or "") for d, t, _ in sorted(rows)]
    for (d, t), (e, n) in zip(texts, texts[1:] + texts[:1]):
        k = len(t) // 2
        edited = t[: len(t) - k] + n[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        apart = (int(r.fingerprint, 16) ^ int(got[e].fingerprint, 16)).bit_count()
        assert r.near_next == 1 - apart / 128 and 0 <= r.near_edited <= 1
        assert (edited != t) or r.near_edited == 1
    assert got[7].fingerprint == got[9].fingerprint == "0" * 32
    assert got[20].fingerprint == got[21].fingerprint and got[20].near_next == 1
    own = {hashlib.sha256(t.encode()).hexdigest(): got[d].fingerprint for d, t in texts}
    assert all(r.edited_fingerprint == own[r.edited_sha256] for r in got.values() if r.edited_sha256 in own)


def test_votes_by_hand(spark):
    """One term: the fingerprint is the bits of its hash; chunks add up as one text does."""
    frame = spark.createDataFrame([(1, "alpha"), (2, "alpha " * 5000), (3, "alpha")], "k long, text string")
    got = {r.k: (r.f0, r.f1) for r in fp.simhashes(frame, ["k"]).collect()}
    assert got[1] == got[3] and got[1] != (0, 0)
    votes = fp.term_votes(frame, ["k"]).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in votes} == {1: 1, 2: 3, 3: 1}


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_search_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    prints = []
    for _ in range(40):
        x = rng.getrandbits(128)
        for _ in range(5):
            prints.append(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(128)
    prints = [0, (1 << 128) - 1, *prints, *prints[:10]]
    low = (1 << 64) - 1
    rows = [(k, fp._signed(x & low), fp._signed(x >> 64)) for k, x in enumerate(prints)]
    frame = spark.createDataFrame(rows, "doc_id long, f0 long, f1 long")
    found = {tuple(r) for r in fp.within(frame, frame, radius).collect()}
    halves = {(a, b) for _, a, b in rows}
    apart = lambda p, q: sum(((x ^ y) & low).bit_count() for x, y in zip(p, q))
    assert found == {(*p, *q) for p in halves for q in halves if apart(p, q) <= radius}
    counts = {r.doc_id: r.near for r in fp.search(frame, 20, radius).collect()}
    assert counts == {k: sum(apart((a, b), (c, d)) <= radius for _, c, d in rows) - 1 for k, a, b in rows if k % 20 == 0}


def test_repeats_nulls_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "a b c"), (5, "d e f"), (5, "d e f"), (5, "g h")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in fp.fingerprint_documents(frame).collect()) == ["5", "5", "5", "None"]
    assert fp.fingerprint_documents(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fp.within(frame, frame, 6)


@pytest.mark.parametrize("radius", [4, 9, 21, 31])
def test_wide_search_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    prints = [0, (1 << 128) - 1]
    for _ in range(30):
        x = rng.getrandbits(128)
        for _ in range(6):
            prints.append(x ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(radius + 3))))
    low = (1 << 64) - 1
    rows = [(k, fp._signed(x & low), fp._signed(x >> 64)) for k, x in enumerate([*prints, *prints[:25]])]
    frame = spark.createDataFrame(rows, "doc_id long, f0 long, f1 long")
    pairs = [tuple(r) for r in fp.around(frame, frame, radius).collect()]
    halves = {(a, b) for _, a, b in rows}
    apart = lambda p, q: sum(((x ^ y) & low).bit_count() for x, y in zip(p, q))
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(*p, *q) for p in halves for q in halves if apart(p, q) <= radius}
    digits = lambda a, b: f"{a & low:016x}{b & low:016x}"
    got = {r.doc_id: (r.near, r.found) for r in fp.search(frame, 20, radius).collect()}
    others = {k: [(c, d) for j, c, d in rows if j != k and apart((a, b), (c, d)) <= radius] for k, a, b in rows if k % 20 == 0}
    assert got == {k: (len(o), sorted({digits(*p) for p in o})) for k, o in others.items()}


def test_near_copies_are_found(spark, tmp_path):
    """Texts that share 0.8 of their 5-word shingles or more; the registered query names the copy by its fingerprint."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 10))) for _ in range(2000)]
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    docs = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(150, 400))]
        copy = list(text)
        for _ in range(len(text) // 60):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        a, b = shingles(text), shingles(copy)
        assert len(a & b) >= 0.8 * len(a | b) and text != copy
        docs += [(20 * k, " ".join(text)), (20 * k + 1, " ".join(copy))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fp.fingerprints_query(spark, str(tmp_path)).collect()}
    assert all(got[20 * k + 1].found is None and got[20 * k + 1].near is None for k in range(60))
    copies = sum(got[20 * k + 1].fingerprint in got[20 * k].found for k in range(60))
    assert copies >= 57


def test_probes_are_made_in_many_tasks_and_shuffled(spark):
    prints = spark.range(500).selectExpr("id as doc_id", "hash(id) as f0", "xxhash64(id) as f1")
    plan = fp.around(prints, prints)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    lines = plan.splitlines()
    exploded = [k for k, line in enumerate(lines) if "Generate explode" in line]
    assert len(exploded) == 2 and all(any("REPARTITION_BY_NUM" in line for line in lines[k : k + 5]) for k in exploded)


def test_terms_are_made_without_interpreted_lambdas(spark):
    texts = spark.createDataFrame([(1, "One two  three"), (2, ""), (3, None), (4, "\t")], "k long, text string")
    votes = fp.term_votes(texts, ["k"])
    assert "lambda" not in votes._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: (r.chunk, r.weight) for r in votes.collect()} == {1: (0, 3 + 4 + 5), 2: (None, None), 3: (None, None), 4: (None, None)}
