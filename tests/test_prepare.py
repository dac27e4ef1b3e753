"""Cleaning, numbering, clustering and reading."""

import gzip
import json
import random
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corrobora.functions.ids import hash_time, portable_hash, source_bucket
from corrobora.functions.text import norm_number, norm_text
from corrobora.operators.components import connected_components
from corrobora.operators.order import time_windows, with_row_index
from corrobora.operators.prepare import dict_encode, multi_source, relation_profile, replicate_claims, unpivot_claims
from corrobora.session import scratch_path
from corrobora.sources import files


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_norm_text_cases(spark):
    cases = {
        None: None, "": None, "  ": None, "NaN": None, " none ": None, "NULL": None, "...": None,
        "Hello,  World!": "hello world", "ＡＢＣ１２": "abc12", "ﬁne": "fine", "a\u0301": "\u00e1", "q\u0323": "q",
        "foo_bar-baz": "foo_bar baz", "nano": "nano", "Ⅻ": "xii", "½": "1 2", " a b ": "a b",
        "naïve\ncafé": "naïve café", "日本、語": "日本 語",
    }
    assert apply(spark, norm_text, list(cases)) == list(cases.values())


def plain_text(v):
    """Word runs of the composed text, the obvious way."""
    if v.strip().lower() in ("", "nan", "none", "null"):
        return None
    composed = unicodedata.normalize("NFKC", v.strip()).lower()
    words = "".join(c if c.isalnum() or c == "_" else " " for c in composed).split()
    return " ".join(words) or None


ALPHABET = "aZ9_ .-,'\t\n  éÉßﬁＡ１½Ⅻ²ñ́日本語кЖαΩ٣€😀\x1c"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=12), min_size=40, max_size=60))
def test_norm_text_random(values):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    assert apply(spark, norm_text, values) == [plain_text(v) for v in values]


def test_norm_number_cases(spark):
    cases = {
        None: None, "": None, "abc": None, "1,234.5": "1.23", "-3": "-3.00", "0.125": "0.12", "0.375": "0.38",
        "2.675": "2.67", "no. 7a": "7.00", "-0.001": "-0.00", "0.995": "0.99", "1.005": "1.00", "99.999": "100.00",
        "1999": "1999.00", "3,5 min": "3.50", "12345678901234567.5": "12345678901234568.00",
    }
    assert apply(spark, norm_number, list(cases)) == list(cases.values())


def test_norm_number_rounds_like_printf(spark):
    rng = random.Random(4)
    values = [f"{rng.randrange(10**6)}.{rng.randrange(1000):03d}" for _ in range(2000)]
    values += [repr(rng.random() * 10 ** rng.randrange(8)) for _ in range(2000)]
    values = [v for v in values if "e" not in v]
    assert apply(spark, norm_number, values) == ["%.2f" % float(v) for v in values]


def test_id_expressions(spark):
    ids = [0, 1, 2**20 - 1, 2**20, 123456789012, 2**62 + 12345]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    got = df.select(source_bucket(F.col("i")), hash_time(F.col("i"))).collect()
    assert [r[0] for r in got] == [f"src_{i // 2**20}" for i in ids]
    assert [r[1] for r in got] == [(i * 2654435761 % 2**32) / 2**32 for i in ids]
    spread = spark.range(4000).select(portable_hash(F.lit(3), F.col("id")).alias("h"))
    assert 1800 < spread.filter(F.col("h") < 2**31).count() < 2200


def test_windows_are_positional(spark):
    df = spark.range(10).select((-F.col("id")).cast("double").alias("ts"), F.col("id").alias("offer_id"))
    sizes = time_windows(df.repartition(4), 4, ["ts"]).groupBy("window").count().orderBy("window").collect()
    assert [r["count"] for r in sizes] == [3, 2, 3, 2]


def test_row_index_is_global(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x")).repartition(7)
    rows = with_row_index(df, ["x"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(5000))
    assert [r["x"] for r in rows] == sorted(r["x"] for r in rows)
    assert rows[0]["row_index_total"] == 5000


def test_unpivot_drops_empty_and_unclustered(spark, rows_of):
    wide = spark.createDataFrame([(1, "s", "A b", None), (-1, "s", "x", "y"), (2, "t", "..", "3,14")], "cluster_id int, source_id string, Title string, price string")
    claims = unpivot_claims(wide, ["cluster_id", "source_id"], ["Title", "price"], {"Title": norm_text, "price": norm_number})
    assert rows_of(claims) == [(1, "s", "title", "a b"), (2, "t", "price", "3.14")]


def test_small_reshapes(make_claims, rows_of):
    rows = [(1, "f", "b", "s1", 0.0, 0), (1, "f", "a", "s2", 0.0, 1), (2, "g", "a", "s1", 0.0, 2), (2, "g", "c", "s1", 0.0, 3)]
    claims = make_claims(rows)
    assert {r["cluster_id"] for r in multi_source(claims).collect()} == {1}
    assert sorted(r["value_code"] for r in dict_encode(claims).collect()) == [0, 0, 1, 2]
    tiled = replicate_claims(claims, 10, ["offer_id"])
    assert rows_of(tiled.select("cluster_id", "offer_id"))[-2:] == [(7, 8), (7, 9)]
    assert tiled.count() == 10
    profile = {r["measure"]: r["amount"] for r in relation_profile(claims).collect()}
    assert profile["median_offers_per_cluster"] == 2.0 and profile["rows of g"] == 2.0 and profile["sources"] == 2.0


def plain_components(pairs):
    neighbours = {}
    for a, b in pairs:
        neighbours.setdefault(a, set()).add(b)
        neighbours.setdefault(b, set()).add(a)
    seen, groups = set(), []
    for start in neighbours:
        stack, group = [start], set()
        while stack:
            node = stack.pop()
            if node not in group:
                group.add(node)
                stack.extend(neighbours[node])
        if start not in seen:
            groups.append(group)
            seen |= group
    ordered = sorted(groups, key=min)
    return sorted((n, i) for i, g in enumerate(ordered) for n in g)


def graphs():
    rng = random.Random(1)
    yield "sparse", [(f"A{rng.randrange(80)}", f"B{rng.randrange(80)}") for _ in range(70)]
    yield "chain", [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    yield "hub", [("hub", f"x{i}") for i in range(200)] + [("y1", "y2"), ("y2", "y3"), ("z", "z")]


@pytest.mark.parametrize("name,pairs", list(graphs()))
def test_components(spark, rows_of, name, pairs):
    df = spark.createDataFrame(pairs, "left string, right string")
    assert rows_of(connected_components(df)) == plain_components(pairs)


def test_components_without_broadcast(spark, rows_of):
    pairs = [("hub", f"x{i}") for i in range(300)] + [("y1", "y2"), ("y2", "x7"), ("z1", "z2")]
    df = spark.createDataFrame(pairs, "left string, right string")
    assert rows_of(connected_components(df, max_bytes=0)) == plain_components(pairs)


def test_offer_pairs_keep_the_first_appearance(spark, tmp_path, rows_of):
    def pair(left, right):
        line = {}
        for side, (oid, cluster, title) in (("left", left), ("right", right)):
            line |= {f"id_{side}": oid, f"title_{side}": title}
            if cluster is not None:
                line[f"cluster_id_{side}"] = cluster
        return json.dumps(line)

    first = [pair((1, 10, "one"), (2, 10, "two")), "{broken", pair((1, 10, "later"), (None, 5, "no id"))]
    second = [pair((2, 11, "two again"), (3, None, "three"))]
    for name, lines in (("shoes__train", second), ("cameras__train", first), ("other__train", first)):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            f.write("\n".join(lines))
    offers = files.read_offer_pairs(spark, str(tmp_path), ["cameras", "shoes"], ["train", "test"])
    assert rows_of(offers.select("offer_id", "cluster_id", "category", "title")) == [
        (1, 10, "cameras", "one"), (2, 10, "cameras", "two"), (3, -1, "shoes", "three"),
    ]


def test_music_file(spark, tmp_path, rows_of):
    path = tmp_path / "m.csv"
    path.write_bytes(
        b"TID, CID ,SourceID,id,title,artist,year,language\n"
        b'1,7,1,a,"Song, One",The\xff Band,1999,\n2,7,2,b,song one,,99.5,\n3,8,1,c,Solo,x,,\n'
    )
    claims = files.read_music_claims(spark, str(path))
    assert rows_of(claims.select("field", "value", "source_id", "offer_id")) == [
        ("artist", "the band", "s1", 3), ("title", "song one", "s1", 0), ("title", "song one", "s2", 1),
        ("year", "1999.00", "s1", 5), ("year", "99.50", "s2", 6),
    ]
    assert claims.agg(F.max("ts")).first()[0] == 6 / 7


def test_match_files(spark, tmp_path, rows_of):
    (tmp_path / "train.csv").write_text("ltable_id,rtable_id,label\n1,1,1\n1,2,0\n2,,1\n1,1,1.0\n")
    (tmp_path / "test.csv").write_text("ltable_id,rtable_id,label\n3,4,true\n5,6,false\n")
    assert rows_of(files.read_match_pairs(spark, str(tmp_path))) == [("1", "1"), ("3", "4")]
    with pytest.raises(ValueError):
        files.read_match_pairs(spark, str(tmp_path / "none"))


def test_sinks(spark, rows_of):
    df = spark.createDataFrame([("a", 1)], "k string, n long")
    csv, jsonl = scratch_path(spark), scratch_path(spark)
    for _ in range(2):
        files.save_csv(df, csv)
        files.append_jsonl(df, jsonl)
    assert rows_of(files.read_csv_strings(spark, csv)) == [("a", "1")]
    assert spark.read.json(jsonl).count() == 2
