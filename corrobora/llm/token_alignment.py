"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and how often each pair of ids does."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corrobora.llm.common import load, ship, whole_text
from corrobora.llm.encoding import _PRINTABLE, _SHOWN, vocabulary_path
from corrobora.operators.joins import lookup_join
from corrobora.session import narrow, pin

PIECES = "piece_bpe_32k.model"
#: Units that a worker remembers, beyond which only what the last as many held stays at hand, and the longest of them in characters.
MEMORY, REMEMBERED = 200_000, 64
#: Words given to the libraries as one text.
TOGETHER = 64
#: Marks that, after letters, may be aligned apart from them.
MARKS = ".,;:!?%&*$#)\"|"
#: Documents per output batch, so that a batch of link arrays stays small.
BATCH = 500

_BYTE = {**{chr(b): b for b in _PRINTABLE}, **{shown: b for b, shown in _SHOWN.items()}}
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_BLANKS = re.compile(r"\s\s")
#: Neither tokenizer joins what stands before a single space, or line break, between two non-blanks with what follows.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def common_ends(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """(i, j) with ``a[i] == b[j]`` of two ascending lists, by galloping.

    The shorter list drives: for each of its values the step into the longer one
    doubles until it has passed the value, and a binary search settles the last step.
    """
    swapped = len(a) > len(b)
    short, long = (b, a) if swapped else (a, b)
    found, low, n = [], 0, len(long)
    for i, value in enumerate(short):
        high, step = low, 1
        while high < n and long[high] < value:
            low, high, step = high + 1, high + step, 2 * step
        low = bisect_left(long, value, low, min(high, n))
        if low < n and long[low] == value:
            found.append((low, i) if swapped else (i, low))
            low += 1
    return found


def align(ends_a: Sequence[int], ends_b: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(a_from, a_to, b_from, b_to) of each group: the tokens between two common ends.

    The differences of the common indexes are the numbers of tokens that
    overlap; each group's last two tokens end together and are its link.
    """
    found = common_ends(ends_a, ends_b)
    return [(a0 + 1, a1 + 1, b0 + 1, b1 + 1) for (a0, b0), (a1, b1) in zip([(-1, -1), *found[:-1]], found)]


class Aligner(dict):
    """Aligned units of text: ``unit -> (n_a, n_b, n_groups, groups, links)``, or None where the bytes disagree.

    A unit that begins with a line break stands for itself, one in a tuple for
    marks after a letter, any other for itself after a space: the cuts at which
    both tokenizers start a token. When the memory is full it becomes ``before``,
    from which units that are met again are taken over.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        super().__init__()
        self.before: dict = {}
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        self.bytes_a = {k: bytes(_BYTE[c] for c in t) for t, k in self.a.get_vocab().items() if all(c in _BYTE for c in t)}
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [self._piece(p) for p in pieces]
        self.wide_a, self.wide_b = {k: len(v) for k, v in self.bytes_a.items()}, [*map(len, self.bytes_b)]
        self.decimal = [*map(str, range(max(len(pieces), max(self.bytes_a) + 1)))]
        joined = {m for p in pieces for m in re.findall(r"(?<=[^\W\d_])[^\w\s]", p)}
        #: letters, then marks that no piece of B holds after a letter and A matches apart from letters
        self.tail = re.compile(f"([^\\W\\d_]+)([{re.escape(''.join(m for m in MARKS if m not in joined))}]+)")

    __hash__ = object.__hash__

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = _BYTE_PIECE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        """The groups of a text from its ids."""
        found = self.aligned_at(text, [len(text.encode())], a, b)
        return found and found[0]

    def aligned_at(self, text: str, cuts: Sequence[int], a: list[int], b: list[int]) -> list[tuple] | None:
        """The groups of each unit of a text, which end at ``cuts`` (in bytes); None where the bytes disagree, or tokens do not end there."""
        raw = text.encode()
        if b"".join([self.bytes_a[k] for k in a]) != raw or b"".join([self.bytes_b[k] for k in b]) != raw:
            return None
        ends_a = [*accumulate([self.wide_a[k] for k in a])]
        groups = align(ends_a, [*accumulate([self.wide_b[k] for k in b])])
        names, at = self.decimal, iter(cuts)
        names_a, names_b = [names[k] for k in a], [names[k] for k in b]
        found, shown, links, from_a, from_b, cut = [], [], [], 0, 0, next(at)
        for i, k, j, n in groups:
            shown.append(f"{','.join(names_a[i:k])}|{','.join(names_b[j:n])}")
            links.append(a[k - 1] << 32 | b[n - 1])
            if ends_a[k - 1] >= cut:
                if ends_a[k - 1] > cut:
                    return None
                found.append((k - from_a, n - from_b, len(shown), ";".join(shown), tuple(links)))
                shown, links, from_a, from_b, cut = [], [], k, n, next(at, 0)
        return found

    def learn(self, units: set[str]) -> None:
        """Align the units that are not remembered, all in one call of each library."""
        parts = {u: self.tail.fullmatch(u) for u in units if not self.known(u)}
        new = {u for u, m in parts.items() if not m}
        new.update(k for m in parts.values() if m for k in (m[1], (m[2],)) if not self.known(k))
        words = [u for u in new if not isinstance(u, tuple) and u.isalpha()]
        self.learn_each([u for u in new if isinstance(u, tuple) or not u.isalpha()] + self.learn_words(words))
        for unit, m in parts.items():
            if m:
                word, tail = self[m[1]], self[(m[2],)]
                whole = word and tail
                self[unit] = whole and (*(x + y for x, y in zip(word[:3], tail)), f"{word[3]};{tail[3]}", word[4] + tail[4])

    def known(self, unit: str | tuple) -> bool:
        """Whether a unit is remembered; one from before is taken over."""
        if unit in self:
            return True
        if unit in self.before:
            self[unit] = self.before[unit]
            return True
        return False

    def learn_words(self, words: list[str]) -> list[str]:
        """Align words of letters, many as one text; returns those of texts whose bytes or ends disagree."""
        some = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        texts, left = [" ".join(w) for w in some], []
        ids_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for own, text, a, b in zip(some, texts, ids_a, self.b.encode(texts, num_threads=1)):
            found = self.aligned_at(" " + text, [*accumulate([len(w.encode()) + 1 for w in own])], a.ids, b)
            if found:
                self.update(zip(own, found))
            else:
                left += own
        return left

    def learn_each(self, units: list[str]) -> None:
        """Align units one by one."""
        own = [u[0] if isinstance(u, tuple) else u if u[:1] == "\n" else " " + u for u in units]
        ids_a = self.a.encode_batch_fast(own, add_special_tokens=False)
        # B puts a space before any text: a piece of its own before a line break, joined with the letter before marks
        ids_b = self.b.encode(["a" + u[0] if isinstance(u, tuple) else u for u in units], num_threads=1)
        for unit, text, a, b in zip(units, own, ids_a, ids_b):
            self[unit] = self.aligned(text, a.ids, b[1:] if text[:1] != " " else b)

    def units(self, text: str) -> list[str]:
        """The text in units; a text whose blanks are all single needs no pattern."""
        if _BLANKS.search(text) or text[0].isspace() or text[-1].isspace():
            first, *rest = _CUT.split(" " + text)
            return [first[1:], *(u if u[0] == "\n" else u[1:] for u in rest)]
        return text.replace("\n", " \n").split(" ")

    def documents(self, texts: Sequence[str]) -> list[list[tuple]]:
        """The aligned units of each whole text; none where a unit's bytes disagree, or of an empty text."""
        if len(self) > MEMORY:
            self.before = dict(self)
            self.clear()
        cut = [self.units(t) if t else [] for t in texts]
        odd = {}  # the first unit follows a space, so one that begins with a line break is looked at apart
        for n, units in enumerate(cut):
            if units and units[0][:1] == "\n":
                text = " " + units.pop(0)
                odd[n] = self.aligned(text, self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]))
        new = set().union(*cut)
        self.learn(new)
        found = [[*([odd[n]] if n in odd else []), *map(self.__getitem__, units)] for n, units in enumerate(cut)]
        for unit in new:
            if len(unit) > REMEMBERED:
                del self[unit]
        return [[] if None in f else f for f in found]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this worker."""
    return Aligner(path_a, path_b)


ALIGNED = "doc_id long, tag long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<long>"


def align_documents(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """One row per document: token and group counts, the digest of its groups, its distinct links and how often each occurs.

    ``links`` holds the A id in the upper 32 bits and the B id in the lower.
    ``with_groups`` adds the groups themselves. ``tag`` numbers the rows. See :func:`alignment` for nulls and disagreeing bytes.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = aligner(path_a, path_b)
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                part, out = frame.iloc[at : at + BATCH], []
                for found in tool.documents(part["text"]):
                    shown = ";".join([f[3] for f in found])
                    links, times = np.unique(np.fromiter(chain.from_iterable([f[4] for f in found]), np.int64), return_counts=True)
                    counts = [sum([f[k] for f in found]) for k in range(3)]
                    digest = hashlib.sha256(shown.encode()).hexdigest() if found else ""
                    out.append((*counts, int(times.sum()), digest, links, times.astype(np.int64), *([shown] if with_groups else [])))
                names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times", *(["groups"] if with_groups else [])]
                made = pd.DataFrame(out, columns=names, index=part.index)
                yield pd.concat([part[["doc_id", "tag"]].astype({"doc_id": "Int64"}), made], axis=1)

    ship(docs.sparkSession)
    numbered = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), F.monotonically_increasing_id().alias("tag"))
    return numbered.mapInPandas(rows, ALIGNED + ", groups string" * with_groups)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, total, best): how often each id pair is linked in all documents, and whether no A id is linked to its B id more often."""
    each = aligned.select(F.explode(F.arrays_zip("links", "times")).alias("x")).select("x.links", "x.times")
    totals = pin(each.groupBy(F.col("links").alias("link")).agg(F.sum("times").alias("total")), "links")
    b = F.col("link").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    highest = totals.groupBy(b).agg(F.max("total").alias("highest"))
    return lookup_join(totals.withColumn("b", b), highest, ["b"], "inner").select("link", "total", (F.col("total") == F.col("highest")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Token, group and link counts of every document, with the corpus-wide counts of its links.

    Tokenizer A (byte-level, JSON) sees a space and the text, B (sentencepiece)
    puts that space itself. Null and empty texts, and texts whose tokens of
    either side do not give back the bytes of space and text, have no tokens:
    zeros and an empty digest. A null doc_id stays null; repeated rows come
    back repeatedly and count repeatedly; an empty table gives none. Other
    columns are not read. Links move as distinct pairs per document; their
    counts are broadcast up to a measured size and joined by salted shuffle beyond.
    """
    aligned = pin(align_documents(docs, path_a, path_b), "aligned")
    each = aligned.select("tag", F.explode(F.arrays_zip("links", "times")).alias("x")).select("tag", F.col("x.links").alias("link"), "x.times")
    seen = lookup_join(each, link_counts(narrow(aligned, "links", "times")), ["link"], "inner")
    sums = seen.groupBy("tag").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("total")).alias("count_sum"),
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("links", "times").join(sums, "tag", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(load(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path(PIECES))
