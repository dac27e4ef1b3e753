"""Document fingerprints: 128-bit SimHash of weighted terms, and a search by block tables. Native to Spark."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora.llm.common import load, whole_text
from corrobora.operators.order import with_row_index
from corrobora.session import pin

#: Halves of 64 bits, each with a hash of its own.
HALVES = 2
#: Bits in which two fingerprints of a search may differ: the farthest of the 305 pairs of different texts with a 5-word-shingle
#: Jaccard of 0.8 or more in the given documents (12 at sf0.01, 293 at sf0.1; median 11 to 13). Unrelated ones start at about 36.
RADIUS = 21
#: Blocks of a fingerprint in the permuted tables.
BLOCKS = 6
#: Bits of a block that a search probes with flipped bits.
PROBED = 16

#: Four 16-bit counters in one long: 2,048 terms of weight 15 at most stay below 2^15 in each.
_LANES = 0x0001000100010001
_TERMS = 2048
_HEAVIEST = 15
_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def _once(df: DataFrame, column: Column, name: str, *keep: str) -> DataFrame:
    """``column`` computed in one place: a generator is not merged into the expressions that read it."""
    return df.select(*keep, F.explode(F.array(column)).alias(name))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def term_votes(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The weighted bit counts of each row of (keys, text), in chunks of :data:`_TERMS` terms.

    A term is a word and the next one (the last word alone); words are lower-cased
    and blank-separated. Its weight is the mean length of its words, 1 to 15: long words are rare.
    Terms vote where they are made, so a chunk moves as one row of packed counters.
    """
    # pairs are made by functions that are compiled: lambdas are interpreted, several hundred nanoseconds a term
    words = _once(texts, F.array_remove(F.split(F.lower("text"), _BLANKS), ""), "w", *keys)
    following = F.slice("w", 2, F.greatest(F.size("w"), F.lit(1)))
    pairs = words.select(*keys, F.posexplode_outer(F.arrays_zip("w", following)).alias("at", "pair"))

    def tagged(w: Column) -> Column:
        hashed = F.xxhash64(w).bitwiseAND(F.lit(-16)).bitwiseOR(F.least(F.length(w), F.lit(_HEAVIEST)).cast("long"))
        return F.when(w.isNotNull(), hashed)

    def term(a: Column, b: Column) -> Column:
        long = F.coalesce((a.bitwiseAND(F.lit(15)) + b.bitwiseAND(F.lit(15))) / 2, a.bitwiseAND(F.lit(15)))
        hashed = F.xxhash64(a, b).bitwiseAND(F.lit(-16)).bitwiseOR(F.greatest(long.cast("long"), F.lit(1).cast("long")))
        return F.when(a.isNotNull(), hashed)

    both = pairs.select(*keys, "at", tagged(F.col("pair")["w"]).alias("a"), tagged(F.col("pair")["1"]).alias("b"))
    terms = both.select(*keys, "at", term(F.col("a"), F.col("b")).alias("term"))
    weight = F.col("term").bitwiseAND(F.lit(15))
    rows = terms.select(
        *keys,
        F.floor(F.col("at") / _TERMS).alias("chunk"),
        weight.alias("weight"),
        *(F.xxhash64(F.lit(half), "term").alias(f"h{half}") for half in range(HALVES)),
    )
    counters = [
        F.sum(F.shiftrightunsigned(f"h{half}", k).bitwiseAND(F.lit(_LANES)) * F.col("weight")).alias(f"c{half}_{k}")
        for half in range(HALVES)
        for k in range(16)
    ]
    return rows.groupBy(*keys, "chunk").agg(F.sum("weight").alias("weight"), *counters)


def simhashes(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, f0, f1): the 128 bits of each row of (keys, text) as two longs; both 0 for a text without words.

    ``keys`` must tell the rows apart. A bit is 1 if the terms with that hash bit outweigh the others.
    """
    votes = term_votes(texts, keys)
    low = 0x0000FFFF0000FFFF
    names = [(half, k, part) for half in range(HALVES) for k in range(16) for part in (0, 1)]
    halves = [F.sum(F.shiftrightunsigned(f"c{half}_{k}", 16 * part).bitwiseAND(F.lit(low))).alias(f"s{half}_{k}_{part}") for half, k, part in names]
    total = votes.groupBy(*keys).agg(F.sum("weight").alias("weight"), *halves)

    def bits(half: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(16):
            for part in (0, 1):
                for upper in (0, 1):
                    count = F.shiftrightunsigned(f"s{half}_{k}_{part}", 32 * upper).bitwiseAND(F.lit(0xFFFFFFFF))
                    bit = _signed(1 << (k + 16 * part + 32 * upper))
                    out = out.bitwiseOR(F.when(count * 2 > F.col("weight"), F.lit(bit)).otherwise(F.lit(0).cast("long")))
        return out

    return total.select(*keys, *(bits(half).alias(f"f{half}") for half in range(HALVES)))


def hex_digits(f0: str | Column = "f0", f1: str | Column = "f1") -> Column:
    """The fingerprint as 32 lowercase hexadecimal digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(f)), 16, "0") for f in (f0, f1)))


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(p.bitwiseXOR(q)) for p, q in zip(a, b)))


def likeness(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Share of equal bits: 1 for equal fingerprints, about 0.5 for unrelated texts."""
    return 1 - distance(a, b) / F.lit(64.0 * HALVES)


def _block_masks(blocks: int, radius: int) -> list[tuple[int, int]]:
    """Per table the bits it looks up: any ``blocks - radius`` blocks; ``radius`` differences leave one choice untouched."""
    width = 64 * HALVES
    edges = [width * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen)
        masks.append((_signed(mask & (1 << 64) - 1), _signed(mask >> 64)))
    return masks


def within(queries: DataFrame, index: DataFrame, radius: int = BLOCKS // 2, blocks: int = BLOCKS) -> DataFrame:
    """(q0, q1, f0, f1): each distinct fingerprint of ``queries`` with every one of ``index`` within ``radius`` bits.

    Each table of the index holds all fingerprints under the bits of some
    blocks (the permutation that leads with them); a query looks itself up in every
    table, and the whole distance is checked. Exact for every radius below ``blocks``.
    """
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be below the number of blocks")
    masks = _block_masks(blocks, radius)

    def tables(df: DataFrame, x: str, y: str) -> DataFrame:
        keys = [F.struct(F.lit(t).alias("t"), F.col("f0").bitwiseAND(F.lit(a)).alias("a"), F.col("f1").bitwiseAND(F.lit(b)).alias("b")) for t, (a, b) in enumerate(masks)]
        spread = df.select("f0", "f1").distinct().select(F.col("f0").alias(x), F.col("f1").alias(y), F.explode(F.array(*keys)).alias("k"))
        return spread.select(x, y, F.col("k.t").alias("t"), F.col("k.a").alias("a"), F.col("k.b").alias("b"))

    met = tables(queries, "q0", "q1").join(tables(index, "f0", "f1"), ["t", "a", "b"])
    near = distance((F.col("q0"), F.col("q1")), (F.col("f0"), F.col("f1"))) <= radius
    return met.filter(near).select("q0", "q1", "f0", "f1").distinct()


def _allowed(radius: int) -> list[int]:
    """Differences to look for in each probed block, -1 for none: with more of them in every block, two prints are over ``radius`` apart."""
    n = 64 * HALVES // PROBED
    base, extra = divmod(radius + 1, n)
    return [base - 1 + (k < extra) for k in range(n)]


def around(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q0, q1, f0, f1): what :func:`within` returns, for radii that permuted tables are too many for.

    The index holds each fingerprint once per block of 16 bits, under the block's value. A query looks up
    its blocks with every choice of as many flipped bits as :func:`_allowed` says. The whole distance is checked,
    and a pair counts in the first block that leads to it. Exact for every radius below 32.
    """
    if not 0 <= radius < 4 * 64 * HALVES // PROBED:
        raise ValueError("the radius must be below four bits a block")
    allowed, each = _allowed(radius), 64 // PROBED
    low = (1 << PROBED) - 1

    def block(halves: Sequence[Column], t: int) -> Column:
        return F.shiftrightunsigned(halves[t // each], PROBED * (t % each)).bitwiseAND(F.lit(low)).cast("int")

    def keys(halves: Sequence[Column], flipped: bool) -> Column:
        found = []
        for t, most in enumerate(allowed):
            flips = [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(PROBED), k if flipped else 0)]
            masks = [(t << PROBED) | m for m in (flips if flipped else flips[:1])]
            if masks:
                table = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<int>")  # folded to a constant
                own = block(halves, t)
                found.append(F.transform(table, own.bitwiseXOR))
        return F.concat(*found)

    parts = max(queries.sparkSession.sparkContext.defaultParallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def tables(df: DataFrame, x: str, y: str, flipped: bool) -> DataFrame:
        # dealt by number: adaptive execution counts the bytes of a row, not its 856 keys, and would explode all of them in one task
        rows = df.select(F.col("f0").alias(x), F.col("f1").alias(y)).distinct().repartition(parts)
        return rows.select(x, y, F.explode(keys((F.col(x), F.col(y)), flipped)).alias("k"))

    asked, held = (F.col("q0"), F.col("q1")), (F.col("f0"), F.col("f1"))
    met = tables(queries, "q0", "q1", True).join(tables(index, "f0", "f1", False).hint("merge"), "k")
    apart = [a.bitwiseXOR(b) for a, b in zip(asked, held)]
    first = F.coalesce(*(F.when(F.bit_count(block(apart, t)) <= most, F.lit(t)) for t, most in enumerate(allowed)))
    return met.filter((distance(asked, held) <= radius) & (first == F.shiftright("k", PROBED))).select("q0", "q1", "f0", "f1")


def _named(docs: DataFrame) -> DataFrame:
    """(t0, t1, doc_id, text): 128 bits name a document; rows that repeat both id and text share them."""
    text = whole_text()
    return docs.select(F.xxhash64("doc_id", text).alias("t0"), F.xxhash64(text, "doc_id", F.lit(1)).alias("t1"), "doc_id", text.alias("text"))


def neighbours(docs: DataFrame) -> DataFrame:
    """(t0, t1, doc_id, n_chars, copies, n0, n1, p0, p1, take): each document, the next by ascending doc_id, the one before.

    ``take`` is how many code points the one before takes from its front. Only ids and lengths move.
    """
    rows = _named(docs).groupBy("t0", "t1", "doc_id", F.length("text").alias("n_chars")).agg(F.count("*").alias("copies"))
    placed = pin(with_row_index(rows, ["doc_id", "t0", "t1"], "place"), "placed")
    at = placed.select("t0", "t1", "n_chars", "place", "place_total")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    after = at.select(F.pmod(F.col("place") - 1, F.col("place_total")).alias("place"), F.col("t0").alias("n0"), F.col("t1").alias("n1"))
    before = at.select(F.pmod(F.col("place") + 1, F.col("place_total")).alias("place"), F.col("t0").alias("p0"), F.col("t1").alias("p1"), half.alias("take"))
    return pin(placed.join(after, "place").join(before, "place").drop("place", "place_total"), "neighbours")


def edited_texts(docs: DataFrame, order: DataFrame) -> DataFrame:
    """(t0, t1, text): each document with its last half replaced by as much of the next one's front.

    Whole texts move once, to their place in the order; after that only fronts of half a text.
    """
    placed = _named(docs).drop("doc_id").join(order, ["t0", "t1"])
    n = F.col("n_chars")
    own = placed.select("t0", "t1", F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")).alias("front"))
    given = placed.select(F.col("p0").alias("t0"), F.col("p1").alias("t1"), F.substring("text", F.lit(1), F.col("take")).alias("back"))
    if order.filter("copies > 1").take(1):
        own, given = own.dropDuplicates(["t0", "t1"]), given.dropDuplicates(["t0", "t1"])
    return own.join(given, ["t0", "t1"]).select("t0", "t1", F.concat("front", "back").alias("text"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, their likeness, and the likeness to the next document.

    Null and empty texts have fingerprint 0. A null id sorts first; rows that repeat both id
    and text are one document in the order and come back as often as they are there;
    rows that share an id alone are ordered by a hash of their text. An empty table has no rows. Other
    columns are not read.
    """
    key = ["t0", "t1"]
    order = neighbours(docs)
    texts = _named(docs).select(*key, "text")
    if order.filter("copies > 1").take(1):
        texts = texts.dropDuplicates(key)
    own = pin(simhashes(texts, key), "prints")
    edited = edited_texts(docs, order).select(*key, F.sha2("text", 256).alias("edited_sha256"), "text")
    changed = simhashes(edited, [*key, "edited_sha256"]).withColumnsRenamed({"f0": "e0", "f1": "e1"})
    following = own.select(F.col("t0").alias("n0"), F.col("t1").alias("n1"), F.col("f0").alias("g0"), F.col("f1").alias("g1"))
    joined = order.join(own, key).join(changed, key).join(following, ["n0", "n1"])
    print_, edit, after = ([F.col(f"{c}{half}") for half in range(HALVES)] for c in "feg")
    out = joined.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        hex_digits("f0", "f1").alias("fingerprint"), hex_digits("e0", "e1").alias("edited_fingerprint"),
        likeness(print_, edit).alias("near_edited"), likeness(print_, after).alias("near_next"),
        "f0", "f1",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return out.drop("copy")


def search(prints: DataFrame, every: int = 20, radius: int = RADIUS) -> DataFrame:
    """(doc_id, f0, f1, near, found): what lies within ``radius`` bits of every ``every``-th doc_id of (doc_id, f0, f1).

    ``near`` counts the other rows, ``found`` lists their distinct fingerprints in hexadecimal, ascending: the
    rows found are those that have one of them. A row's own fingerprint is listed if another row has it too.
    """
    asked = prints.filter(F.col("doc_id") % every == 0)
    sizes = prints.groupBy("f0", "f1").agg(F.count("*").alias("rows"))
    pairs = within(asked, sizes, radius) if radius < BLOCKS else around(asked, sizes, radius)
    own = (F.col("q0") == F.col("f0")) & (F.col("q1") == F.col("f1"))
    other = F.when(~own | (F.col("rows") > 1), F.struct("f0", "f1"))
    found = pairs.join(sizes, ["f0", "f1"]).groupBy("q0", "q1").agg((F.sum("rows") - 1).alias("near"), F.collect_list(other).alias("prints"))
    listed = F.sort_array(F.transform("prints", lambda p: hex_digits(p["f0"], p["f1"])))
    same = found.select(F.col("q0").alias("f0"), F.col("q1").alias("f1"), "near", listed.alias("found"))
    return asked.join(same, ["f0", "f1"]).select("doc_id", "f0", "f1", "near", "found")


def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of all documents, and what the block tables find for ids divisible by 20: ``near`` and ``found`` of :func:`search`, null for others.

    The rows of a fingerprint in ``found`` are those with it in ``fingerprint``.
    """
    prints = pin(fingerprint_documents(load(spark, sf_dir, "documents")), "fingerprints")
    key = ["doc_id", "f0", "f1"]
    near = search(prints.select(*key)).dropDuplicates(key)
    return prints.join(near, key, "left").drop("f0", "f1")
