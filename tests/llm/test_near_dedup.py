import random

import pytest
import xxhash

from corrobora.llm import near_dedup as nd
from corrobora.operators.components import component_roots


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc_id -> smallest reachable doc_id, over all pairs."""
    least = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= 2 and least[a] < least[b]:
                    least[b], changed = least[a], True
    return least


def signed(x):
    return x - (1 << 64) if x >> 63 else x


TEXTS = ["", None, "one", "One two", "a b c", "A B C", "a b c d", "É É é", "x y z w", "w " * 3000, "the cat\tsat\non the mat " * 40]


def test_fingerprints_by_hand():
    for text in TEXTS:
        assert nd.simhash(nd.shingle_hashes(text)) & (1 << 64) - 1 == plain_print(text)


def test_groups_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    docs = [(k, t) for k, t in enumerate(TEXTS)]
    for k in range(60):
        body = [rng.choice(words) for _ in range(200)]
        for _ in range(3):
            docs.append((len(docs), " ".join(body)))
            body[rng.randrange(200)] = rng.choice(words)
    rng.shuffle(docs)
    prints = [(d, plain_print(t)) for d, t in docs]
    want = plain_components(prints)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in nd.near_groups(frame).collect()}
    assert got == {d: (f"{f:016x}", want[d]) for d, f in prints}
    kept = nd.keep_first(frame)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_links_reach_the_same_with_crowds(spark, crowd):
    rng = random.Random(9)
    prints = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(12):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints |= {0, 1 << 63, (1 << 64) - 1}
    prints = sorted(prints)
    want = plain_components([(k, x) for k, x in enumerate(prints)])
    place = {signed(x): k for k, x in enumerate(prints)}
    classes = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    links = nd.near_pairs(classes, crowd)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links.collect())
    if crowd == 64:
        found = {(r.left, r.right) for r in links.collect()}
        assert found == {(a, b) for a in place for b in place if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    roots = {r.node: r.root for r in component_roots(links).collect()}
    groups = {}
    for x, k in place.items():
        groups.setdefault(roots.get(x, x), set()).add(k)
    truth = {}
    for k, m in want.items():
        truth.setdefault(m, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_null_ids_repeats_and_empty_table(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "e f g h"), (7, "e f g h"), (None, "e f g h"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(nd.near_groups(frame).collect()) == 6
    kept = sorted((str(r.doc_id), str(r.text)) for r in nd.keep_first(frame).collect())
    assert kept == [("3", "None"), ("7", "e f g h"), ("None", "a b c d")]
    assert nd.near_groups(frame.limit(0)).collect() == []
    assert nd.keep_first(frame.limit(0)).collect() == []


@pytest.mark.parametrize("crowd", [4000, 1])
def test_probes_are_not_broadcast(spark, crowd):
    """The planner counts 65 probes of a fingerprint as one, so a small table of fingerprints may have a large one of probes."""
    classes = spark.range(3000).selectExpr("id * 3 as fp", "id as least")
    links = nd.near_pairs(classes, crowd)
    joins = [j for j in links._jdf.queryExecution().executedPlan().toString().split("\n") if "HashJoin" in j or "MergeJoin" in j]
    assert not [j for j in joins if "HashJoin" in j and "Inner" in j], joins
    assert sum("SortMergeJoin" in j for j in joins) == (2 if crowd == 1 else 1)
    found = {r.node for r in component_roots(links).collect()}
    near = {b for b in range(0, 9000, 3) for a in range(0, 9000, 3) if a < b and (a ^ b).bit_count() <= 2}
    assert found == near
