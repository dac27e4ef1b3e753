"""Encoding of whole texts with the tokenizers library, word by word and with a bounded memory of words."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: Words remembered per worker; beyond, the memory starts anew.
MEMORY = 1_000_000
#: Byte-level vocabularies write each byte as one printable character: itself, or the next free one from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_AMBIGUOUS = re.compile(r"\s\s")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Ids of a text as little-endian unsigned 32-bit integers.

    The pattern that splits text before the merges never joins across a blank
    that follows a non-blank, nor across a line break between two non-blanks.
    So a text whose blanks are all single is cut at its spaces and line breaks,
    and each distinct piece goes through the library once. Any other text, and
    any whose blanks are not the two, goes through the library in parts cut
    before such blanks; a text that holds an added token (``<|endoftext|>``) goes through it whole.

    The keys are pieces: one that begins with a line break stands for itself,
    any other for itself after a space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        #: what the library takes as one token wherever it stands in a text
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.n_ids = self.library.get_vocab_size()
        self.marks = {mark: self.whole(mark) for mark in (".", ",", "\n")}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def match(self, word: str) -> bytes:
        """Ids of one match of the pattern, straight from the library's merges."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_SHOWN))]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        last = piece[-1:]
        if piece.isalpha():
            found = self.match(" " + piece)
        elif last in (".", ",") and piece[-2:-1].isalpha():
            found = self[piece[:-1]] + self.marks[last]  # letters and marks are matched apart
        elif piece[:1] == "\n" and piece[1:].isalpha():
            found = self.marks["\n"] + self.match(piece[1:])
        else:
            found = self.whole(piece if piece[:1] == "\n" else " " + piece)
        self[piece] = found
        return found

    __hash__ = object.__hash__

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, null as empty."""
        if not text:
            return b""
        if any(token in text for token in self.added):
            return self.whole(text)
        if _AMBIGUOUS.search(text) or text[-1].isspace() or text[0].isspace():
            return b"".join([self.whole(part) for part in _safe_parts(text)])
        if len(self) > MEMORY:
            self.clear()
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


_SAFE = re.compile(r"(?<=\S)(?= \S)")


def _safe_parts(text: str, size: int = 100_000) -> list[str]:
    """The text in parts of at least ``size`` characters, cut before a single space between two non-blanks."""
    parts, at = [], 0
    while at < len(text):
        cut = _SAFE.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        parts.append(text[at:end])
        at = end
    return parts


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker."""
    return WordEncoder(path)
