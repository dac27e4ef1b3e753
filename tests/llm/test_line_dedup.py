import random

import pytest
from pyspark.sql import functions as F

from corrobora.llm import line_dedup as ld


def plain(docs):
    """doc -> numbers of the lines with an earlier match, over all pairs."""
    lines = []
    for doc_id, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            tokens = frozenset(line.split())
            if tokens:
                lines.append((doc_id, k, tokens))
    gone = {d: [] for d, _ in docs}
    for j, (d, k, y) in enumerate(lines):
        if any(len(x & y) * 5 >= len(x | y) * 4 for _, _, x in lines[:j]):
            gone[d].append(k)
    return gone


def corpus(seed, variants):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    base = [[rng.choice(words) for _ in range(rng.choice((1, 2, 3, 4, 5, 8, 20, 60)))] for _ in range(60)]
    docs = []
    for d in range(variants):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                line[rng.randrange(len(line))] = rng.choice(words)
            if rng.random() < 0.2:
                line = line[1:]
            lines.append(" ".join(line))
        docs.append((d, "\n".join(lines)))
    docs += [(variants, None), (variants + 1, ""), (variants + 2, "\n\n \t \n"), (variants + 3, "a b\tc\x0bd e " * 2000)]
    return docs


@pytest.mark.parametrize("crowd", [2, 64])
def test_decisions_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(ld.later_matches, "__defaults__", (crowd,))
    docs = corpus(crowd, 160)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in ld.line_decisions(frame).collect()}
    want = plain(docs)
    assert {d: r.removed for d, r in got.items()} == want
    assert all(m <= d for d, r in got.items() for m in r.matched)
    assert got[160].n_lines == 0 and got[163].n_lines == 1


def test_lines_under_a_crowded_token_meet_their_lead_without_another_join(spark):
    frame = spark.createDataFrame(corpus(3, 80), "doc_id long, text string")
    classes = ld._line_classes(ld.line_table(frame, ld.rarity(frame)))
    met = classes.filter("n > 3").select("cid", "n", "parity", F.posexplode("rare").alias("place", "key"))
    crowded = met.groupBy("key").count().filter("count > 2").select("key")
    made = ld._lead_pairs(classes, met.join(crowded, "key", "left_semi"), crowded)
    joins = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("key#" in line and "cid#" not in line.split("((")[0] for line in joins)
    sizes = {r.cid: (r.n, r.parity) for r in classes.collect()}
    pairs = {(r.a, r.b) for r in made.collect()}
    assert pairs
    for a, b in pairs:
        (n, x), (m, y) = sizes[a], sizes[b]
        assert a != b and bin((x ^ y) & (2**64 - 1)).count("1") + 2 * -(-8 * (n + m) // 18) <= n + m


def test_rows_per_token_are_joined_once_whatever_the_crowds(spark, monkeypatch):
    made, real = [], ld._verified
    monkeypatch.setattr(ld, "_verified", lambda docs, classes, pairs: made.append(pairs) or real(docs, classes, pairs))
    frame = spark.createDataFrame(corpus(2, 160), "doc_id long, text string")
    classes = ld._line_classes(ld.line_table(frame, ld.rarity(frame)))
    ld.later_matches(frame, classes, 2)
    assert len(made) == 2
    joins = [line for line in made[-1]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert not any("LeftAnti" in line for line in joins) and sum("key#" in line for line in joins) == 1


def test_lines_of_other_lengths_are_no_crowd(spark, monkeypatch):
    made, real = [], ld._verified
    monkeypatch.setattr(ld, "_verified", lambda docs, classes, pairs: made.append(pairs) or real(docs, classes, pairs))
    docs = [(k, "rare " + " ".join(f"w{k}x{i}" for i in range(4 + 3 * k) for _ in range(64))) for k in range(30)]
    docs.append((30, docs[20][1] + " more"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    classes = ld._line_classes(ld.line_table(frame, ld.rarity(frame)))
    assert [r.match.doc_id for r in ld.later_matches(frame, classes, 8).collect()] == [20]
    assert len(made) == 1


def test_text_without_its_lines(spark):
    rows = [
        (5, "the same long line of words here\nown words only", "x", 9),
        (2, "the same long line of words here\n\nother", "y", 9),
        (5, "the same long line of words here\nown words only", "x", 9),
        (None, None, "z", 9),
        (None, "other", "z", 9),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tag string, n_chars long")
    got = sorted(map(tuple, ld.drop_lines(frame).collect()), key=str)
    want = [
        (5, "own words only", "x", 14),
        (2, "the same long line of words here\n", "y", 33),
        (5, "own words only", "x", 14),
        (None, None, "z", 9),
        (None, "other", "z", 9),
    ]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert ld.line_decisions(frame).collect() == [] and ld.drop_lines(frame).collect() == []


def test_rarity_counts_every_word_within_one_fast_map(spark, monkeypatch):
    seen, real = [], type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda frame: seen.append(spark.conf.get(ld._FAST_MAP, None)) or real(frame))
    texts = [None, "", "a b\ta\x0bb  a", "\n\na\fb\r\n c\n", " \t "]
    ranks = ld.rarity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert seen == [str(ld.RARITY_BITS)] and spark.conf.get(ld._FAST_MAP, None) is None
    assert sorted(b for b in ranks if b) == [3, 4]  # b three times, a four times; c once


def test_codes_hold_no_nulls_and_are_sorted_as_longs(spark):
    coded = spark.createDataFrame([("b a\tb  a c",)], "line string").select(ld._codes(F.col("line"), bytes(1 << ld.RARITY_BITS)).alias("codes"))
    assert coded.schema["codes"].dataType.containsNull is False
    codes = coded.head().codes
    assert len(codes) == 3 and codes == sorted(codes)


def test_rows_per_token_are_not_broadcast(spark):
    """The planner counts a line once, however many tokens index it."""
    rows = spark.range(40).select(F.col("id").alias("cid"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("key"))
    among = ld._sharing(rows, F.col("cid") < 2)
    plan = among._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert among.count() == 2 * 40 * 10
