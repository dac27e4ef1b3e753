"""Line dedup: an exact set-similarity join over all lines, native to Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora.llm.common import load, whole_text
from corrobora.operators.joins import BROADCAST_BYTES, table_bytes
from corrobora.session import pin, release

#: Two lines match if their token sets have this Jaccard similarity or more: 4 / 5.
OVER, UNDER = 4, 5
#: Token counts are kept in so many hashed buckets; only the order of tokens depends on them.
RARITY_BITS = 18
#: Lines of a similar length with one indexed token, beyond which they are first held against the earliest of them.
CROWD = 32

_BLANKS = "[ \\t\\x0B\\f\\r]+"


def _ceil(over: int, under: int, n: Column) -> Column:
    return F.floor((n * over + (under - 1)) / F.lit(under)).cast("int")


def _words(line: Column) -> Column:
    """The words of a line, and perhaps empty strings; a single blank needs no regular expression."""
    others = reduce(lambda x, y: x | y, (F.contains(line, F.lit(c)) for c in "\t\x0b\f\r"))
    return F.when(others, F.split(line, _BLANKS)).otherwise(F.split(line, " "))


def _rows(docs: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(doc_id, tag, line_no, line): ``tag`` tells apart rows that share an id, unless their texts are equal too.

    With a small table of ``tags``, only the lines of their rows.
    """
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("tag", F.xxhash64("doc_id", "text"))
    if tags is not None:
        rows = rows.join(F.broadcast(tags), "tag", "left_semi")
    return rows.select("doc_id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _small(table: DataFrame) -> bool:
    """Whether a written table may be sent to all tasks."""
    return table_bytes(table) <= BROADCAST_BYTES


def _sent(table: DataFrame) -> DataFrame:
    """A written table, sent to all tasks where it is small."""
    return F.broadcast(table) if _small(table) else table


_FAST_MAP = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"


@contextmanager
def _counted_in_place(spark: SparkSession) -> Iterator[None]:
    """All buckets of :func:`rarity` fit the fast map of an aggregation; by default a quarter of them do."""
    before = spark.conf.get(_FAST_MAP, None)
    spark.conf.set(_FAST_MAP, str(RARITY_BITS))
    try:
        yield
    finally:
        spark.conf.set(_FAST_MAP, before) if before is not None else spark.conf.unset(_FAST_MAP)


def rarity(docs: DataFrame) -> bytes:
    """One byte per hashed token bucket: twice the binary logarithm of the tokens in it, over the whole table."""
    lines = docs.select(F.explode(F.split(whole_text(), "\n", -1)).alias("line"))
    words = lines.select(F.explode(_words(F.col("line"))).alias("word")).filter("word <> ''")
    token = F.shiftrightunsigned(F.xxhash64("word"), 8)
    tokens = words.select(token.bitwiseAND(F.lit((1 << RARITY_BITS) - 1)).cast("int").alias("b"))
    table = bytearray(1 << RARITY_BITS)
    with _counted_in_place(docs.sparkSession):
        counts = tokens.groupBy("b").agg(F.count("*").alias("n")).collect()
    for b, n in counts:
        table[b] = min(63, int(2 * math.log2(n)))
    return bytes(table)


def _tokens(line: Column) -> Column:
    """The distinct tokens of a line as 56-bit hashes, in no order."""
    hashes = F.transform(F.array_remove(_words(line), ""), lambda w: F.shiftrightunsigned(F.xxhash64(w), 8))
    return F.array_distinct(hashes)


def _codes(line: Column, ranks: bytes) -> Column:
    """The distinct tokens of a line as ascending integers: rarity above the 56 bits of the token."""
    table = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")  # folded to a constant

    def code(token: Column) -> Column:
        rank = F.get(table, token.bitwiseAND(F.lit((1 << RARITY_BITS) - 1)).cast("int"))
        # never null, and known to be: such arrays are sorted as plain longs
        return F.shiftleft(F.coalesce(rank, F.lit(0).cast("long")), 56).bitwiseOR(token)

    return F.sort_array(F.transform(_tokens(line), code))


def _parity(codes: Column, shift: int = 0) -> Column:
    """64 bits, each the parity of the tokens that fall on it: two of them differ in no more bits than their sets."""

    def flip(acc: Column, c: Column) -> Column:
        bit = (F.shiftright(c, shift) if shift else c).bitwiseAND(F.lit(63)).cast("int")
        return acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))

    return F.aggregate(codes, F.lit(0).cast("long"), flip)


#: Parts of the finer parity: 256 bits, enough for lines of some three hundred tokens.
_PARTS = 4
#: Hashes are written as they are: a dictionary of them saves no room and is given up after being built.
_PLAIN = {"parquet.enable.dictionary": "false"}


def _fine_parity(codes: Column) -> list[Column]:
    """The parity over 64 bits for each of :data:`_PARTS` parts of the tokens."""

    def part(k: int) -> Column:
        return F.filter(codes, lambda c: F.shiftright(c, 12).bitwiseAND(F.lit(_PARTS - 1)) == k)

    return [_parity(part(k), 6).alias(f"q{k}") for k in range(_PARTS)]


def line_table(docs: DataFrame, ranks: bytes) -> DataFrame:
    """Every line with the size, identity (128 bits), parity and rarest tokens of its token set; no text. Written once."""
    n = F.size("codes")
    coded = _rows(docs).select("doc_id", "tag", "line_no", _codes(F.col("line"), ranks).alias("codes"))
    return pin(
        coded.select(
            "doc_id", "tag", "line_no", n.alias("n"),
            F.xxhash64("codes").alias("k1"), F.xxhash64(F.lit(1), "codes").alias("k2"), _parity(F.col("codes")).alias("parity"),
            F.transform(F.slice("codes", 1, n - _ceil(OVER, UNDER, n) + 1), lambda c: F.hash(c)).alias("rare"),
        ),
        "lines",
        **_PLAIN,
    )


def _line_classes(lines: DataFrame) -> DataFrame:
    """One row per distinct token set: the first line that has it, and a short id. Written once."""
    first = F.min(F.struct("doc_id", "tag", "line_no", "n", "parity", "rare")).alias("first")
    classes = lines.filter("n > 0").groupBy("k1", "k2").agg(first)
    return pin(classes.select("k1", "k2", "first.*", F.monotonically_increasing_id().alias("cid")), "classes", **_PLAIN)


def _possible(index: str, probe: str) -> Column:
    """What two lines that share a token must satisfy to match: length, position and parity."""
    def of(side: str, c: str) -> Column:
        return F.col(f"{side}.{c}")

    need = _ceil(OVER, OVER + UNDER, of(index, "n") + of(probe, "n"))
    left = F.least(of(index, "n") - of(index, "place"), of(probe, "n") - of(probe, "place"))
    apart = F.bit_count(of(index, "parity").bitwiseXOR(of(probe, "parity")))
    return (
        (of(index, "n") <= of(probe, "n"))
        & (of(probe, "n") * OVER <= of(index, "n") * UNDER)
        & ((of(index, "n") < of(probe, "n")) | (of(index, "cid") < of(probe, "cid")))
        & (left >= need)
        & (apart + 2 * need <= of(index, "n") + of(probe, "n"))
    )


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cid, match): for each class in ``pairs`` (a, b) with an earlier one similar enough, the first line of the earliest.

    Only the lines in question are read again, once: a finer parity settles most pairs of
    long lines, the token sets the rest. Repeated rows repeat pairs, which changes no minimum.
    """
    pairs = pin(pairs.distinct(), "pairs")
    cids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    needed = pin(classes.select("cid", "tag", "line_no").join(cids, "cid"), "needed")
    lines = _rows(docs, needed.select("tag").distinct()) if _small(needed) else _rows(docs)
    codes = lines.join(_sent(needed), ["tag", "line_no"]).select("cid", "doc_id", "tag", "line_no", _tokens(F.col("line")).alias("codes"))
    place = F.struct("doc_id", "tag", "line_no").alias("place")
    sets = pin(codes.select("cid", place, F.size("codes").alias("n"), *_fine_parity(F.col("codes")), "codes"), "sets")
    fine = sets.drop("place", "codes")
    x, y = fine.alias("x"), fine.alias("y")
    apart = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"x.q{k}").bitwiseXOR(F.col(f"y.q{k}"))) for k in range(_PARTS)))
    sizes = F.col("x.n") + F.col("y.n")
    near = apart + 2 * _ceil(OVER, OVER + UNDER, sizes) <= sizes
    both = pairs.join(x, F.col("a") == F.col("x.cid")).join(y, F.col("b") == F.col("y.cid"))
    close = pin(both.filter(near).select("a", "b").distinct(), "close")
    release(pairs, needed)
    a, b = (sets.select("cid", "place", "n", "codes").alias(side) for side in "xy")
    both = close.join(a, F.col("a") == F.col("x.cid")).join(b, F.col("b") == F.col("y.cid"))
    shared = F.size(F.array_intersect("x.codes", "y.codes"))
    enough = shared * (OVER + UNDER) >= (F.col("x.n") + F.col("y.n")) * OVER
    forward = F.col("x.place") < F.col("y.place")
    later = F.when(forward, F.col("b")).otherwise(F.col("a"))
    earlier = F.when(forward, F.col("x.place")).otherwise(F.col("y.place"))
    matches = pin(both.filter(enough).groupBy(later.alias("cid")).agg(F.min(earlier).alias("match")), "matches")
    release(close, sets)
    return matches


def _length(n: Column) -> Column:
    return F.floor(F.log(UNDER / OVER, n)).cast("int")


def _lead_pairs(classes: DataFrame, met: DataFrame, crowded: DataFrame) -> DataFrame:
    """(a, b): the classes ``met`` in a crowd, each with the earliest of similar length under its token, where their parities allow a match.

    Leads bring their size and parity along, so pairs are filtered as they are made and never joined again.
    """
    at = F.struct("doc_id", "tag", "line_no").alias("at")
    length = _length(F.col("n")).alias("length")
    placed = classes.filter("n > 3").select("cid", "n", "parity", at, length, F.explode("rare").alias("key"))
    first = F.min(F.struct("at", "cid", "n", "parity")).alias("first")
    leads = placed.join(_sent(crowded), crowded.columns, "left_semi").groupBy("key", "length").agg(first)
    leads = leads.select("key", "length", F.col("first.cid").alias("b"), F.col("first.n").alias("m"), F.col("first.parity").alias("q"))
    led = met.withColumn("length", length).join(leads, ["key", "length"])
    sizes = F.col("n") + F.col("m")
    near = F.bit_count(F.col("parity").bitwiseXOR(F.col("q"))) + 2 * _ceil(OVER, OVER + UNDER, sizes) <= sizes
    return led.filter((F.col("cid") != F.col("b")) & near).select(F.col("cid").alias("a"), "b")


def _sharing(rows: DataFrame, in_index: Column) -> DataFrame:
    """Rows per token as ``i`` (those of the index) and ``p`` that share one; both are shuffled, as the planner counts exploded rows once a line."""
    return rows.filter(in_index).alias("i").join(rows.alias("p").hint("merge"), F.col("i.key") == F.col("p.key"))


def later_matches(docs: DataFrame, classes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(cid, match): the classes with an earlier match, and the place (doc_id, tag, line_no) of one.

    Of two matching lines the shorter has one of its rarest n - ceil(8n/9) + 1
    tokens in common with the rarest n - ceil(4n/5) + 1 of the longer. These are
    joined, filtered by length, position and parity, and verified. Where more
    than ``crowd`` lines of a similar length index one token, they are first held
    against the earliest of them; what has found a match by then only
    serves as the earlier side afterwards, so variants of one line make no pairs with
    each other. That mark lies on classes, so rows per token move once, whatever the crowds.
    """

    def rare(some: DataFrame, *more: str) -> DataFrame:
        return some.filter("n > 3").select("cid", "n", "parity", *more, F.posexplode("rare").alias("place", "key"))

    in_index = F.col("place") < F.col("n") - _ceil(2 * OVER, OVER + UNDER, F.col("n")) + 1
    each = rare(classes).withColumn("length", _length(F.col("n")))
    crowded = each.filter(in_index).groupBy("key", "length").agg(F.count("*").alias("lines")).filter(F.col("lines") > crowd)
    crowded = pin(crowded.select("key", "length"), "crowded")
    decided, open_ = None, classes.withColumn("open", F.lit(True))
    if crowded.take(1):
        met = each.join(_sent(crowded), ["key", "length"], "left_semi")
        decided = _verified(docs, classes, _lead_pairs(classes, met, crowded))
        led = decided.select("cid", F.lit(False).alias("found"))
        open_ = classes.join(_sent(led), "cid", "left").withColumn("open", F.coalesce("found", F.lit(True)))
    pairs = _sharing(rare(open_, "open"), in_index).filter(_possible("i", "p") & (F.col("i.open") | F.col("p.open")))
    found = _verified(docs, classes, pairs.select(F.col("i.cid").alias("a"), F.col("p.cid").alias("b")))
    release(crowded)
    return found if decided is None else decided.unionByName(found).groupBy("cid").agg(F.min("match").alias("match"))


def line_decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, n_lines, removed, matched): per row of ``docs`` the numbers of the lines that go.

    A line goes if an earlier one (by doc_id, then text hash, then line number)
    has a token set with a Jaccard similarity of 0.8 or more; tokens are
    separated by blanks, and case counts. ``matched`` lists a document with an earlier match for each. Lines without a token
    never go. Null texts count as empty, a null id sorts first; rows that
    repeat both id and text are one document; an empty table has no rows.
    """
    ranks = rarity(docs)
    lines = line_table(docs, ranks)
    classes = _line_classes(lines)
    matches = later_matches(docs, classes)
    first = F.struct("doc_id", "tag", "line_no")
    fates = pin(classes.join(matches, "cid", "left").select("k1", "k2", first.alias("first"), "match"), "fates")
    release(classes, matches)
    own = F.struct("doc_id", "tag", "line_no")
    judged = lines.select("doc_id", "tag", "line_no", "n", "k1", "k2").join(fates, ["k1", "k2"], "left")
    goes = (F.col("n") > 0) & (F.col("match").isNotNull() | ~F.col("first").eqNullSafe(own))
    by = F.when(F.col("match").isNotNull(), F.col("match.doc_id")).otherwise(F.col("first.doc_id"))
    fate = judged.withColumn("goes", goes).withColumn("by", by)
    decided = fate.groupBy("doc_id", "tag").agg(
        F.count_if(F.col("n") > 0).alias("n_lines"),
        F.sort_array(F.collect_set(F.when(F.col("goes"), F.col("line_no")))).alias("removed"),
        F.sort_array(F.collect_set(F.when(F.col("goes"), F.col("by")))).alias("matched"),
    )
    decided = pin(decided, "decisions")
    release(lines, fates)
    return decided


def drop_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with the lines that :func:`line_decisions` removes taken out of ``text``.

    A text that loses nothing, and a null one, stays as it is; one that loses all its lines
    becomes empty. ``n_chars``, where the table has it, follows a text that changed.
    """
    decided = line_decisions(docs).filter(F.size("removed") > 0).select(
        F.col("doc_id").alias("id"), F.col("tag").alias("tag"), "removed"
    )
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", whole_text()).alias("tag"))
    same = (F.col("r.tag") == F.col("d.tag")) & F.col("r.row.doc_id").eqNullSafe(F.col("d.id"))
    joined = rows.alias("r").join(decided.alias("d"), same, "left")
    lines = F.split(F.col("r.row.text"), "\n", -1)
    kept = F.filter(lines, lambda line, k: ~F.array_contains(F.col("d.removed"), k))
    text = F.when(F.col("d.removed").isNull(), F.col("r.row.text")).otherwise(F.array_join(kept, "\n"))
    row = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        n = F.length("new").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("changed"), n).otherwise(F.col("row.n_chars")))
    out = joined.select("r.row", text.alias("new"), F.col("d.removed").isNotNull().alias("changed"))
    return out.select(row.alias("row")).select("row.*")


def lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_decisions(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed", "matched")
