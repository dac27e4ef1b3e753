"""The pipeline, stage by stage against brute force, and the registration of this subpackage."""

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corrobora.llm import packing, quality_classifier, quality_rules
from corrobora.llm.common import load
from corrobora.llm.encoding import vocabulary_path, word_encoder
from corrobora.session import pin
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_dedup import plain_components, plain_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows after each stage, each stage fed with what the one before wrote."""
    docs, out = load(spark, SF, "documents"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        out.append(pin(stage(spark, out[-1], SF)))
    return out


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_order_and_columns(steps):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "line dedup", "SimHash near-dedup", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_filters(spark, steps):
    labels = load(spark, SF, "labels")
    model = quality_classifier.fit(steps[0], labels)
    kept = {d for d, r in by_id(steps[0]).items() if model.score(np.array([quality_classifier.document_statistics(r.text)]))[0] >= 0.5}
    assert by_id(steps[1]).keys() == kept
    ratios = quality_rules.fit(steps[1], labels)

    def passes(text):
        n, _, _, _, repeats = quality_rules.base_counts(text)
        found = quality_rules.gram_buckets((text or "").encode())
        return n >= 20 and 100 * repeats <= 30 * n and ratios[found].sum() / (len(found) + quality_rules.CALM) >= quality_rules.LEAST

    assert by_id(steps[2]).keys() == {d for d, r in by_id(steps[1]).items() if passes(r.text)}
    assert len(by_id(steps[2])) > 100


def test_lines_and_near_copies(steps):
    before, after = by_id(steps[2]), by_id(steps[3])
    gone = plain_lines(sorted((d, r.text) for d, r in before.items()))
    assert any(gone.values()) and before.keys() == after.keys()
    for d, r in before.items():
        text = "\n".join(line for k, line in enumerate(r.text.split("\n")) if k not in gone[d])
        assert after[d].text == text and after[d].n_chars == len(text)
    least = plain_components([(d, plain_print(r.text)) for d, r in after.items()])
    assert by_id(steps[4]).keys() == set(least.values())


def test_packing_and_run(spark, steps):
    docs = by_id(steps[4])
    pieces = {}
    for p in steps[5].collect():
        pieces.setdefault(p.doc_id, []).append((p.start, p.length))
    assert pieces.keys() == docs.keys()
    encoder = word_encoder(vocabulary_path())
    for d, parts in pieces.items():
        parts.sort()
        assert [s for s, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) == len(encoder.encode(docs[d].text)) // 4 + 1
    whole = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, steps[5].collect()))
    assert packing.WINDOW == 1024


def test_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()
