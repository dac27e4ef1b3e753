"""Byte-level BPE: merges and decoding as DuckDB queries over token-position rows, per partition."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import itemgetter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from corrobora.llm.common import load, ship

#: Characters of text that are encoded and decoded together (a longer document is taken alone).
TOGETHER = 4_000_000
#: What one recursive query contracts: so many matches, whose squared byte lengths add up to so much (it keeps half as many rows).
WORDS, SQUARES = 25_000, 12_000_000
#: Ids that one query decodes.
DECODED = 500_000
#: Matches remembered per worker; beyond, the memory starts anew.
MEMORY = 800_000
#: Matches of more bytes are contracted by a heap: the query's rows grow with the square of the length.
LONG = 256

#: Each step finds every word's least (rank, position) among its neighbouring pairs and contracts that pair.
#: A word without a pair is whole: its rows leave the recursion, and are its ids.
CONTRACT = """
WITH RECURSIVE step(word, pos, id, whole) AS (
    SELECT word, pos, id, false FROM given
  UNION ALL
    SELECT word, pos, CASE WHEN pos = first THEN merged ELSE id END, first IS NULL
    FROM (
        SELECT word, pos, id, merged,
               lag(pos) OVER (PARTITION BY word ORDER BY pos) AS before,
               min((merged::BIGINT << 32) | pos) OVER (PARTITION BY word) & 4294967295 AS first
        FROM (SELECT *, lead(id) OVER (PARTITION BY word ORDER BY pos) AS following FROM step WHERE NOT whole) pairs
        LEFT JOIN merges ON merges.pair = (id::BIGINT << 32) | following
    ) ranked
    WHERE first IS NULL OR before IS DISTINCT FROM first
)
SELECT word, id FROM step WHERE whole ORDER BY word, pos
"""

#: Token bytes are kept as characters U+0000 to U+00FF, so that strings of any bytes can be joined.
DECODE = """
SELECT doc, string_agg(bytes, '' ORDER BY pos) AS decoded
FROM ids JOIN vocabulary USING (id) GROUP BY doc
"""


class ByteBPE:
    """One vocabulary in an in-memory database: its merge table, its token bytes, and the words seen last."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.memory: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        merges = [
            (self.ranks[token[:k]] << 32 | self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        self._table("merges", {"pair": pa.array([p for p, _ in merges], pa.int64()), "merged": pa.array([r for _, r in merges], pa.int32())})
        self._table("vocabulary", {
            "id": pa.array(self.ranks.values(), pa.int32()),
            "bytes": pa.array([token.decode("latin-1") for token in self.ranks], pa.string()),
        })

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _contract(self, words: list[str]) -> None:
        """Remember the ids of words that are not remembered yet, within :data:`WORDS` and :data:`SQUARES`."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw])
        joined = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.concatenate([[0], lengths.cumsum()[:-1]])
        self._table("given", {
            "word": pa.array(np.repeat(np.arange(len(raw), dtype=np.int32), lengths)),
            "pos": pa.array((np.arange(len(joined)) - np.repeat(starts, lengths)).astype(np.int32)),
            "id": pa.array(self.single[joined]),
        })
        found = self.con.sql(CONTRACT).fetchnumpy()
        ids = np.asarray(found["id"], "<u4")
        data, listed = ids.tobytes(), [*map(str, ids.tolist())]
        ends = np.searchsorted(np.asarray(found["word"]), np.arange(len(raw)), side="right") * 4
        at = 0
        for word, end in zip(words, ends.tolist()):
            self.memory[word], self.shown[word] = data[at:end], ",".join(listed[at // 4 : end // 4])
            at = end

    def _contract_long(self, word: str) -> bytes:
        """The same contraction for one long match: a heap of (rank, position) over a linked list."""
        raw = word.encode()
        parts: list[bytes | None] = [raw[k : k + 1] for k in range(len(raw))]
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))

        def ranked(k: int):
            joint = after[k] < len(raw) and self.ranks.get(parts[k] + parts[after[k]])
            return (joint, k, parts[k], parts[after[k]]) if joint is not None and joint is not False else None

        heap = [r for r in map(ranked, range(len(raw))) if r]
        heapify(heap)
        while heap:
            _, k, left, right = heappop(heap)
            j = after[k]
            if parts[k] != left or j >= len(raw) or parts[j] != right:
                continue  # one of the two has been merged since
            parts[k], parts[j] = left + right, None
            after[k] = after[j]
            if after[j] < len(raw):
                before[after[j]] = k
            for start in (before[k], k):
                if start >= 0 and (again := ranked(start)):
                    heappush(heap, again)
        return np.array([self.ranks[p] for p in parts if p is not None], "<u4").tobytes()

    def matches(self, texts: list[str]) -> list[list[str]]:
        """The matches of each text, all of them remembered."""
        matches = [self.pattern.findall(text) for text in texts]
        if len(self.memory) > MEMORY:
            self.memory.clear()
            self.shown.clear()
        new = [w for w in dict.fromkeys(w for found in matches for w in found) if w not in self.memory]
        for part in _batches([(len(w.encode()), w) for w in new]):
            if part[0][0] > LONG:
                for _, w in part:
                    self.memory[w] = self._contract_long(w)
                    self.shown[w] = ",".join(map(str, np.frombuffer(self.memory[w], "<u4").tolist()))
            else:
                self._contract([w for _, w in part])
        return matches

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(map(self.memory.__getitem__, found)) for found in self.matches(texts)]

    def encode_shown(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """:meth:`encode`, and the ids of each text as decimals joined by commas."""
        matches = self.matches(texts)
        return (
            [b"".join(map(self.memory.__getitem__, found)) for found in matches],
            [",".join(map(self.shown.__getitem__, found)) for found in matches],
        )

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id list: joined with the vocabulary and aggregated in order of position, a range of positions at a time."""
        lengths = [len(x) for x in ids]
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        joined = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
        parts: list[list[str]] = [[] for _ in ids]
        for at in range(0, len(joined), DECODED):
            part = joined[at : at + DECODED]
            columns = {"doc": pa.array(owner[at : at + DECODED]), "pos": pa.array(np.arange(len(part), dtype=np.int32)), "id": pa.array(part)}
            self._table("ids", columns)
            for doc, decoded in self.con.sql(DECODE).fetchall():
                parts[doc].append(decoded)
        return ["".join(p).encode("latin-1") for p in parts]


def _batches(words: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Matches (bytes, match) by rising length, in batches that one query can hold; those beyond :data:`LONG` come last, together."""
    words.sort(key=itemgetter(0))
    part, held = [], 0
    for size, word in words:
        if part and (len(part) == WORDS or held + size * size > SQUARES or size > LONG >= part[-1][0]) and part[-1][0] <= LONG:
            yield part
            part, held = [], 0
        part.append((size, word))
        held += size * size
    if part:
        yield part


@lru_cache(maxsize=1)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """The vocabulary of this worker."""
    return ByteBPE(path, pattern)


def _together(texts: list[str], size: int = TOGETHER) -> Iterator[slice]:
    start, held = 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > size:
            yield slice(start, k)
            start, held = k, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row, ids as little-endian unsigned 32-bit integers, without a shuffle.

    Every match of ``pattern`` is contracted by itself, as the rank file
    orders. Very long texts and matches go through the queries in parts of bounded size. Null and empty texts have no ids; repeated rows and null ids give
    a row each; an empty table none. Other columns are not read.
    """

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path, pattern)
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            for part in _together(texts):
                ids = bpe.encode(texts[part])
                decoded = bpe.decode([np.frombuffer(x, "<u4") for x in ids])
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[part].astype("Int64"), "ids": ids, "decoded": decoded})

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(coded, "doc_id long, ids binary, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): :func:`encode_documents`, digested where it is made."""

    def digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path, pattern)
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            for part in _together(texts):
                coded, listed = bpe.encode_shown(texts[part])
                ids = [np.frombuffer(x, "<u4") for x in coded]
                yield pd.DataFrame({
                    "doc_id": frame["doc_id"].iloc[part].astype("Int64"),
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in listed],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in bpe.decode(ids)],
                })

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digest_documents(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
