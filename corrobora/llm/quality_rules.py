"""Quality rules: plain counts per text, and a hashed n-gram likelihood ratio of trusted against raw text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corrobora.llm.common import load, ship, training_labels
from corrobora.operators.joins import lookup_join

#: Bits of the n-gram hash: 65,536 buckets, whatever the corpus.
HASH_BITS = 16
#: Bytes of an n-gram.
GRAM = 3
#: Occurrences of no evidence that every text is mixed with, so that a short one is not judged on a few n-grams.
CALM = 50
#: Least mean log-likelihood ratio of a text that is kept.
LEAST = -0.5

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANKS = re.compile(r"[\x20\x09-\x0D]")
_MIX = np.uint32(0x9E3779B1)
_STEP = np.uint32(0x01000193)


def gram_buckets(data: bytes, gram: int = GRAM, bits: int = HASH_BITS) -> np.ndarray:
    """The bucket of every byte n-gram, in order; shorter data has none."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(b) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = b[:n].copy()
    for i in range(1, gram):
        h *= _STEP
        h += b[i : i + n]
    h *= _MIX
    return h >> np.uint32(32 - bits)


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text.

    Windows are named by exact doubling: equal names mean equal words.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    if len(set(words)) == len(words):
        return 0
    first: dict[bytes, int] = {}
    names = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        pairs = names[:-size] * (int(names.max()) + 1) + names[size:]
        names = np.unique(pairs, return_inverse=True)[1]
        size *= 2
    hits = np.bincount(names)[names] > 1
    if not hits.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(hits)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, repeated words) of a whole text; a null text has none."""
    text = text or ""
    words = text.encode().split()  # splits at the six ASCII blanks and nowhere else
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line and not line.isspace():
            seen.add(line)
        elif line and _BLANKS.sub("", line):  # blanks beyond ASCII make a word
            seen.add(line)
    return len(words), len(text) - len(_BLANKS.findall(text)), len(_SYMBOLS.findall(text)), again, repeated_words(words)


def _count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw, target = np.zeros(1 << HASH_BITS, np.int64), np.zeros(1 << HASH_BITS, np.int64)
    for frame in frames:
        for text, label in zip(frame["text"], frame["label"]):
            found = np.bincount(gram_buckets((text or "").encode()), minlength=1 << HASH_BITS) if text else 0
            raw += found
            if label == 1:
                target += found
    at = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of target to raw probability per bucket.

    Raw counts are smoothed by one each, target probabilities by the raw ones
    at the weight of one occurrence per bucket; without any target text all ratios are 0.
    """
    if target.sum() == 0:
        return np.zeros(len(raw))
    size = len(raw)
    base = (raw + 1) / (raw.sum() + size)
    return np.log((target + size * base) / (target.sum() + size) / base)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of each bucket: n-grams of all documents against those of trusted (quality 1) ones.

    The raw side counts every document, the trusted side every trusted one outside the held-out third.
    The trusted ids travel while they are few, and each partition is reduced to one row per bucket before anything moves.
    """
    ship(docs.sparkSession)
    trusted = training_labels(labels).filter("label = 1")
    rows = lookup_join(docs.select("doc_id", "text"), trusted, ["doc_id"]).select("text", "label")
    counted = rows.mapInPandas(_count_grams, "bucket int, raw long, target long")
    total = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    for bucket, r, t in total:
        raw[bucket], target[bucket] = r, t
    return log_ratios(raw, target)


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def rules(ratios: np.ndarray, text: Column) -> Column:
    """A struct of the counts of :func:`base_counts` and the length-normalised log-likelihood ratio."""

    def measure(value: str | None) -> tuple:
        found = gram_buckets((value or "").encode())
        score = float(ratios[found].sum()) / (len(found) + CALM)
        return *base_counts(value), round(score, 9)

    @F.pandas_udf(RULES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RULES.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=names)

    return measured(text)


def base_failed(rule: Column) -> Column:
    return (rule["n_words"] < 20) | (100 * rule["n_repeat_words"] > 30 * rule["n_words"])


def verdict(rule: Column, least: float = LEAST) -> Column:
    """Kept: the base rules hold and the text is not much likelier as raw text than as trusted text."""
    return ~base_failed(rule) & (rule["score"] >= least)


def accept(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that :func:`verdict` keeps, with all their columns.

    Null and empty texts have no words and go; repeated rows are judged alike;
    an empty table stays empty. The base rules alone hold where nothing is trusted.
    """
    return docs.filter(verdict(rules(fit(docs, labels), docs["text"]), least))


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    judged = docs.select("doc_id", rules(fit(docs, labels), F.col("text")).alias("rule"))
    rule = F.col("rule")
    counts = [rule[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, base_failed(rule).alias("base_failed"), verdict(rule).alias("kept"), rule["score"].alias("score"))
