"""Token ids of a public tokenizer file, with the ids of words kept from one text to the next."""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np

#: In these characters Python's classes and lower case agree with the tokenizer's.
_PLAIN = re.compile(r"[\t-\r -~\xa0-ɏ‐-‧‰-›€]*\Z")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
_KEEP = 600_000


def byte_letters() -> list[str]:
    """The letter by which byte-level BPE writes each byte: printable ones as they are, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordTokenizer:
    """Encodes with a word-level BPE file of at most 65,536 ids.

    A text in plain characters is cut at white space here, and the ids of each
    part are kept; any other text goes to the library whole. Both ways give the
    library's ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.bpe = self.library.model.tokenize
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            if len(self.pieces) >= _KEEP // 2:
                self.pieces.clear()
            s = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
            got = self.pieces[p] = array("H", [t.id for t in self.bpe(s)]).tobytes()
        return got

    def _part(self, s: str) -> bytes:
        if s.isalpha():
            return self._piece(s)
        if s[-1] in ",.;:!?" and s[:-1].isalpha():
            return self._piece(s[:-1]) + self._piece(s[-1])
        return b"".join(map(self._piece, _PIECE.findall(s)))

    def encode(self, text: str) -> np.ndarray:
        if not _PLAIN.match(text) or "<|" in text:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)
        words = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()
        get = self.parts.get
        found = list(map(get, words))
        if None in found:
            if len(self.parts) >= _KEEP:
                self.parts.clear()
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    x = get(w)
                    if x is None:
                        x = self.parts[w] = self._part(w)
                    found[i] = x
        return np.frombuffer(b"".join(found), np.uint16)
