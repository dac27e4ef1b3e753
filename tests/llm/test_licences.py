import pytest

from corrobora.llm import licences as lic


@pytest.fixture(scope="module")
def model():
    return lic.train(["The cat sat on the mat.", "Licensed drivers only beyond this point."], steps=150)


def plain(model, line):
    """(family, probability, likeness) of one paragraph, or None, from the model alone."""
    low = line.lower()
    if not any(c in low for c in lic.CUES):
        return None
    p = model.probabilities(line)
    family, best = model.classes[int(p.argmax())], float(p.max())
    own = {g for g in lic.grams(lic.words_of(line)) if " " in g}
    if family == lic.UNKNOWN or best < lic.LEAST:
        return None
    like = 0
    for f, t in lic.templates():
        pairs = {g for g in lic.grams(lic.words_of(t)) if " " in g}
        common = len(own & pairs)
        if f == family and pairs and common >= min(2, len(pairs)) and common / min(len(own), len(pairs)) >= lic.ALIKE:
            like = max(like, common / min(len(own), len(pairs)))
    return (family, round(best, 5), round(like, 5)) if like else None


LINES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: BSD-3-Clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "A license plate.",
    "Copyright 2021 Example. All rights reserved.", "No cue here at all", "", "licensed " * 5000,
    "You may obtain a copy of the MIT License from the public library of this town, version 2.0.",
]


def test_paragraphs_against_the_model(spark, model):
    docs = [(k, line) for k, line in enumerate(LINES)] + [(100, "\n".join(LINES)), (101, None), (None, LINES[0])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.family, round(r.probability, 5), round(r.likeness, 5)) for r in lic.scan(frame, model).collect()}
    want = {}
    for doc_id, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if found := plain(model, line):
                want[doc_id, k] = found
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:], abs=2e-5) for k in got)
    assert {got[k, 0][0] for k in range(5)} == {"MIT", "Apache", "CC-BY-NC", "GPL", "BSD"}


def test_cuts_of_notices_are_recognised(model):
    hits = [model.classes[int(model.probabilities(t).argmax())] == f for f, t in lic.examples() if f != lic.UNKNOWN]
    assert sum(hits) > 0.9 * len(hits)


def test_documents(spark):
    rows = [(1, "x\nReleased under the MIT License.\nReleased under the MIT License."), (1, "y"), (2, None), (3, "plain"), (3, "plain")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = sorted((r.doc_id, r.families, r.lines) for r in lic.scan_documents(frame).collect())
    assert got == [(1, [], []), (1, ["MIT"], [1, 2]), (2, [], []), (3, [], []), (3, [], [])]
    assert lic.scan_documents(frame.limit(0)).collect() == []


def test_every_template_is_found_by_the_scan(spark):
    """Also the bare names, lines of a broken notice, and cuts without a word like licence."""
    assert all(len({g for g in lic.grams(lic.words_of(t)) if " " in g}) >= 2 for _, t in lic.templates())
    model = lic.train(["The cat sat on the mat.", "Licensed drivers only beyond this point."])
    known = sorted(set(lic.templates()))
    broken = "Released\tunder  MIT\nPERMISSION is hereby granted, free of charge, to any\nperson obtaining a copy of this software\nand associated documentation files"
    cuts = [t for _, t in lic.examples()]
    rows = [*((k, t) for k, (_, t) in enumerate(known)), (1000, broken), (1001, "\n".join(cuts))]
    got = {(r.doc_id, r.line_no): r.family for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [(f, t) for k, (f, t) in enumerate(known) if got.get((k, 0)) != f] == []
    assert (got[1000, 0], got[1000, 2]) == ("MIT", "MIT")
    alone = {k: found[0] for k, t in enumerate(cuts) if (found := plain(model, t))}
    assert {k: f for (d, k), f in got.items() if d == 1001} == alone
