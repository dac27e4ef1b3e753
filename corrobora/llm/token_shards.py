"""Token-id shards: a wavelet matrix per shard, kept as one compressed file with rank and select directories."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corrobora.llm.common import in_document_order, load, ship
from corrobora.llm.encoding import vocabulary_path, word_encoder
from corrobora.session import scratch_path, write_once

#: Ids after which a shard is closed, at the end of a document.
SHARD_IDS = 1 << 20
#: The id after each document.
END = 0
#: Bits from one entry of the rank directory to the next.
BLOCK = 512


@dataclass(frozen=True)
class WaveletMatrix:
    """A sequence of ids as bit-planes, the highest bit first.

    Each plane holds one bit of every id; the next plane's order puts the ids
    with a 0 before those with a 1. ``ranks`` counts the ones before each block
    of each plane, so access, rank and select cost one look per plane.
    """

    size: int
    planes: np.ndarray  # (bits, bytes) packed
    ranks: np.ndarray  # (bits, blocks + 1)
    zeros: np.ndarray  # zeros per plane

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> WaveletMatrix:
        now = np.asarray(ids, np.uint32)
        now = now.astype(np.uint16) if bits <= 16 else now
        width = -(-max(len(now), 1) // BLOCK) * BLOCK // 8
        planes, zeros = np.zeros((bits, width), np.uint8), np.zeros(bits, np.int64)
        for k in range(bits):
            ones = (now >> (bits - 1 - k)) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            planes[k, : len(packed)] = packed
            low = now[~ones]
            zeros[k] = len(low)
            now = np.concatenate([low, now[ones]])
        return WaveletMatrix(len(now), planes, WaveletMatrix.directory(planes), zeros)

    @staticmethod
    def directory(planes: np.ndarray) -> np.ndarray:
        per_block = np.bitwise_count(planes.reshape(len(planes), -1, BLOCK // 8)).sum(axis=2, dtype=np.int64)
        return np.concatenate([np.zeros((len(planes), 1), np.int64), per_block.cumsum(axis=1)], axis=1)

    def _bit(self, k: int, at: int) -> int:
        return int(self.planes[k, at >> 3] >> (at & 7)) & 1

    def _ones(self, k: int, at: int) -> int:
        """Ones of plane ``k`` before ``at``."""
        block, rest = divmod(at, BLOCK)
        found = int(self.ranks[k, block])
        if rest:
            from_byte = block * (BLOCK // 8)
            part = self.planes[k, from_byte : from_byte + (rest + 7) // 8].copy()
            if rest & 7:
                part[-1] &= (1 << (rest & 7)) - 1
            found += int(np.bitwise_count(part).sum())
        return found

    def _find(self, k: int, bit: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) ``bit`` of plane ``k``: search the directory, then the block."""
        before = self.ranks[k] if bit else np.arange(len(self.ranks[k])) * BLOCK - self.ranks[k]
        block = int(np.searchsorted(before, nth, side="right")) - 1
        part = self.planes[k, block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)]
        places = np.flatnonzero(np.unpackbits(part, bitorder="little") == bit)
        return block * BLOCK + int(places[nth - int(before[block])])

    def access(self, at: int) -> int:
        """The id at place ``at``."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        found = 0
        for k in range(len(self.planes)):
            bit = self._bit(k, at)
            ones = self._ones(k, at)
            at = int(self.zeros[k]) + ones if bit else at - ones
            found = found << 1 | bit
        return found

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        """Where the ids equal to ``value`` among places start..end lie after the last plane."""
        if value < 0 or value >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._ones(k, start), self._ones(k, end)
            if value >> (len(self.planes) - 1 - k) & 1:
                start, end = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often ``value`` occurs among the places ``start`` to ``end``."""
        a, b = self._range(value, start, self.size if end is None else end)
        return b - a

    def select(self, value: int, nth: int) -> int:
        """The place of the ``nth`` (from 0) occurrence of ``value``."""
        a, b = self._range(value, 0, self.size)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        at = a + nth
        for k in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - k) & 1
            at = self._find(k, bit, at - int(self.zeros[k]) if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        """All places of ``value``, ascending."""
        return [self.select(value, k) for k in range(self.count(value))]

    def ids(self) -> np.ndarray:
        """The whole sequence: the planes' orders undone from the last to the first."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        now = np.zeros(self.size, kind)
        for k in range(bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.size, bitorder="little").view(bool)
            before = np.empty(self.size, kind)
            split = int(self.zeros[k])
            before[~ones] = now[:split]
            before[ones] = now[split:] | kind(1 << (bits - 1 - k))
            now = before
        return now.astype("<u4")


SHARD = (
    "part int, shard int, n_ids long, bits int, planes binary, ranks binary, zeros array<long>, "
    "doc_ids array<long>, lengths array<long>"
)


def _shard_row(part: int, shard: int, bits: int, docs: list, pieces: list[bytes]) -> dict:
    ids = np.frombuffer(b"".join(pieces), "<u4")
    matrix = WaveletMatrix.build(ids, bits)
    return {
        "part": part, "shard": shard, "n_ids": len(ids), "bits": bits, "planes": matrix.planes.tobytes(),
        "ranks": matrix.ranks.astype("<u4").tobytes(), "zeros": matrix.zeros.tolist(),
        "doc_ids": docs, "lengths": [len(p) // 4 for p in pieces],
    }


def matrix_of(row) -> WaveletMatrix:
    """The wavelet matrix of a stored shard row."""
    planes = np.frombuffer(row.planes, np.uint8).reshape(row.bits, -1)
    ranks = np.frombuffer(row.ranks, "<u4").reshape(row.bits, -1).astype(np.int64)
    return WaveletMatrix(int(row.n_ids), planes, ranks, np.asarray(row.zeros, np.int64))


def write_shards(docs: DataFrame, path: str, vocabulary: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode whole texts in ascending doc_id order, end each with :data:`END`, and write wavelet shards to ``path``.

    A shard is one row with its planes, rank directory and document lengths,
    and is closed after ``shard_ids`` ids, so a task holds one shard at a time.
    Null and empty texts are documents of the end id alone; a null doc_id sorts
    first; rows that share an id keep their own entries, ordered by text hash.
    An empty table gives an empty dataset. Spark's committer writes the files, so lost
    tasks leave nothing behind. Other columns are not read.
    """
    end = np.array([END], "<u4").tobytes()

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(vocabulary)
        bits = max(1, int(encoder.n_ids - 1).bit_length())
        part, shard, held, ids, pieces = TaskContext.get().partitionId(), 0, 0, [], []
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
                ids.append(None if doc_id is pd.NA else int(doc_id))
                pieces.append(encoder.encode(text) + end)
                held += len(pieces[-1]) // 4
                if held >= shard_ids:
                    yield pd.DataFrame([_shard_row(part, shard, bits, ids, pieces)])
                    shard, held, ids, pieces = shard + 1, 0, [], []
        if pieces:
            yield pd.DataFrame([_shard_row(part, shard, bits, ids, pieces)])

    ship(docs.sparkSession)
    write_once(in_document_order(docs).mapInPandas(build, SHARD), path, compression="zstd")


def read_documents(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, ids) of every document in the shards: ``ids`` as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it. Only one number per
    sort partition is added up in one place. With ``digest`` there are ``n_tokens`` and
    ``ids_crc32`` in place of the ids, taken before the starts are joined.
    """
    ship(spark)
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("part_start")
    )
    starts = sizes.join(parts, "part").select(
        "part", "shard", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("shard")), F.lit(0))).alias("base")
    )

    def unfold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                raw = matrix_of(row).ids().tobytes()
                ends = np.cumsum(np.asarray(row.lengths, np.int64))
                at = ends - np.asarray(row.lengths, np.int64)
                ids = pd.array([None if d is None or d != d else int(d) for d in row.doc_ids], dtype="Int64")
                for lo in range(0, len(ends), 2048):
                    cut = slice(lo, lo + 2048)
                    pieces = [raw[4 * a : 4 * b] for a, b in zip(at[cut], ends[cut])]
                    yield pd.DataFrame({"part": row.part, "shard": row.shard, "doc_id": ids[cut], "offset": at[cut], "ids": pieces})

    found = shards.mapInPandas(unfold, "part int, shard int, doc_id long, offset long, ids binary")
    ids = [F.col("ids")]
    if digest:
        ids = [(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")]
    taken = found.select("part", "shard", "doc_id", "offset", *ids)
    return taken.join(starts, ["part", "shard"]).withColumn("start", F.col("base") + F.col("offset")).select(
        "doc_id", "start", *[c for c in taken.columns if c not in ("part", "shard", "doc_id", "offset")]
    )


def count_id(spark: SparkSession, path: str, value: int) -> DataFrame:
    """(part, shard, n): how often ``value`` occurs in each shard, from the rank directories."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame({"part": [row.part], "shard": [row.shard], "n": [matrix_of(row).count(value)]})

    ship(spark)
    return spark.read.schema(SHARD).parquet(path).mapInPandas(counted, "part int, shard int, n long")


def find_id(spark: SparkSession, path: str, value: int) -> DataFrame:
    """(doc_id, place): every occurrence of ``value``, its place counted within the document."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                places = np.array(matrix_of(row).occurrences(value), np.int64)
                ends = np.cumsum(np.asarray(row.lengths, np.int64))
                doc = np.searchsorted(ends, places, side="right")
                starts = ends - np.asarray(row.lengths, np.int64)
                ids = pd.array([None if d is None or d != d else int(d) for d in row.doc_ids], dtype="Int64")
                yield pd.DataFrame({"doc_id": ids[doc], "place": places - starts[doc]})

    ship(spark)
    return spark.read.schema(SHARD).parquet(path).mapInPandas(found, "doc_id long, place long")


def shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    write_shards(load(spark, sf_dir, "documents"), path, vocabulary_path())
    return read_documents(spark, path, digest=True)
