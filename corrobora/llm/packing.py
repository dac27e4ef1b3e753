"""Packing: documents into fixed windows, cut by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from corrobora.llm.common import in_document_order, load, ship
from corrobora.llm.encoding import WordEncoder, vocabulary_path, word_encoder

#: Ids of a window.
WINDOW = 1024
#: The id after each document.
END = 0
#: What a cut costs, in padded ids: after a document, after a sentence, elsewhere.
DOCUMENT, SENTENCE, ANYWHERE = 0.0, 2.0, 64.0
#: Longest run of ids without a place to cut; longer sentences may be cut at every such step.
STRIDE = 128
#: Ids that are cut as one problem, at least (to the end of a document).
PROBLEM = 1 << 18


def sentence_ends(encoder: WordEncoder) -> np.ndarray:
    """For each id whether it ends a sentence or a line."""
    ends = np.zeros(encoder.n_ids, bool)
    for token, k in encoder.library.get_vocab().items():
        ends[k] = token[-1:] in (".", "!", "?", "Ċ")  # the last is the line break
    return ends


def cut_places(ids: np.ndarray, document_ends: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places where the stream may be cut, and the penalty of each; 0 and the stream's end are among them."""
    cost = np.full(len(ids) + 1, np.inf)
    cost[1:][ends[ids]] = SENTENCE
    cost[document_ends] = DOCUMENT
    cost[0] = DOCUMENT
    places = np.flatnonzero(cost < np.inf)
    wide = np.flatnonzero(np.diff(places) > stride)
    for k in wide:
        extra = np.arange(places[k] + stride, places[k + 1], stride)
        cost[extra] = ANYWHERE
    places = np.flatnonzero(cost < np.inf) if len(wide) else places
    return places, cost[places]


def choose_cuts(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cuts (indexes into ``places``) with the least padding plus penalties; windows lie between neighbours.

    A window of length L is padded to ``window``, except where L is a power of
    two. With f(i) = best(i) + place(i), the best padded window that ends at j
    starts at the least f among the places at most ``window`` back: a queue of
    rising f. Unpadded windows start at one of a few known distances.
    """
    n = len(places)
    index = np.full(int(places[-1]) + 1, -1, np.int64)
    index[places] = np.arange(n)
    exact: dict[int, list[int]] = {}
    size = window
    while size:
        if size & (size - 1) == 0:
            back = places - size
            j = np.flatnonzero(back >= 0)
            i = index[back[j]]
            for a, b in zip(j[i >= 0].tolist(), i[i >= 0].tolist()):
                exact.setdefault(a, []).append(b)
        size = (1 << (size.bit_length() - 1)) if size & (size - 1) else size >> 1
    at, cost = places.tolist(), penalties.tolist()
    best, came = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for j in range(1, n):
        here = at[j]
        while queue[0][1] < here - window:
            queue.popleft()
        low, _, source = queue[0]
        least = low + window - here
        for i in exact.get(j, ()):
            if best[i] <= least:
                least, source = best[i], i
        least += cost[j]
        best[j], came[j] = least, source
        rise = least + here
        while queue and queue[-1][0] >= rise:
            queue.pop()
        queue.append((rise, here, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = came[j]
    return cuts[::-1]


def _pieces(docs: list, raw: list[bytes], ends: np.ndarray, window: int, first: int, with_ids: bool) -> tuple[pd.DataFrame, int]:
    """The pieces of one problem, and how many windows it took."""
    data = b"".join(raw)
    ids = np.frombuffer(data, "<u4")
    lengths = np.array([len(r) // 4 for r in raw], np.int64)
    closed = np.cumsum(lengths)
    places, penalties = cut_places(ids, closed, ends, min(STRIDE, window))
    cuts = places[choose_cuts(places, penalties, window)]
    bounds = np.union1d(cuts, closed)
    starts = np.concatenate([[0], bounds[:-1]])
    doc = np.searchsorted(closed, starts, side="right")
    sequence = np.searchsorted(cuts, starts, side="right")
    opened = np.concatenate([[0], cuts])[sequence]
    out = {
        "doc_id": pd.array([docs[k] for k in doc], dtype="Int64"),
        "start": starts - (closed - lengths)[doc],
        "length": bounds - starts,
        "ids_crc32": [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, bounds)],
        "doc_tokens": lengths[doc],
        "sequence_id": first + sequence,
        "offset": starts - opened,
    }
    if with_ids:
        out["ids"] = [data[4 * a : 4 * b] for a, b in zip(starts, bounds)]
    return pd.DataFrame(out), len(cuts)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, problem: int = PROBLEM, with_ids: bool = False) -> DataFrame:
    """Pack whole texts, in ascending doc_id order, into windows of at most ``window`` ids; one row per piece.

    A task cuts its range of documents in problems of ``problem`` ids or one
    longer document, so memory is bounded by the longest text. Sequence ids
    hold the task's number above its own count. ``with_ids`` adds the ids as bytes.
    Null and empty texts are one end id; a null doc_id sorts first and
    stays null; rows that share an id are documents of their own; an empty
    table has no pieces. Other columns are not read.
    """
    end = np.array([END], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(vocabulary)
        ends = sentence_ends(encoder)
        sequence, held, ids, raw = TaskContext.get().partitionId() << 40, 0, [], []
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
                ids.append(doc_id)
                raw.append(encoder.encode(text) + end)
                held += len(raw[-1]) // 4
                if held >= problem:
                    pieces, n = _pieces(ids, raw, ends, window, sequence, with_ids)
                    yield pieces
                    sequence, held, ids, raw = sequence + n, 0, [], []
        if raw:
            yield _pieces(ids, raw, ends, window, sequence, with_ids)[0]

    ship(docs.sparkSession)
    return in_document_order(docs).mapInPandas(cut, PIECE + ", ids binary" * with_ids)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), vocabulary_path())
