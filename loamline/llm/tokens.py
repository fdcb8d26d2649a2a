"""Token ids of whole texts by a public BPE vocabulary, with a bounded cache of words.

The vocabulary's pre-tokenizer never joins text across white space, and its normalizer works inside
words, so the ids of a text are the ids of its words one after another. Words repeat far more often
than texts: most are answered from the cache.
"""

from __future__ import annotations

import re
import sys
from array import array

# Marks that may stand behind a word: together they are one pre-token. Quotes and what special tokens begin or end
# with are left to the tokenizer.
_MARKS = b"!#$%&()*+,-./:;=?@[]^_{}~"

# A Latin word, which is one pre-token; ASCII capitals are not in it, as texts come in lower case.
_LATIN = re.compile("[a-zß-öø-ÿÀ-ÖØ-Þ]+")

# A capital that a mark behind it may join: the normalizer composes before it lower-cases.
_MARKED = re.compile(rb"[A-Z][\x80-\xff]")


def _byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte: printable ones stand for themselves,
    the others get the letters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _bytes_of(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class WordTokens(dict):
    """Word (bytes) -> its ids as little-endian 32-bit numbers; filled on demand.

    At ``limit`` words the cache starts anew and keeps the full one as a second line until the next
    time, so words in use stay and memory is bounded by twice the limit.
    """

    def __init__(self, path: str, limit: int = 500_000):
        super().__init__()
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._limit = limit
        self._before: dict[bytes, bytes] = {}
        self._marks: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        found = self._before.get(word)
        if found is None:
            found = self._encode(word)
        if len(self) >= self._limit:
            self._before = dict(self)
            self.clear()
        self[word] = found
        return found

    def _encode(self, word: bytes) -> bytes:
        letters = word.rstrip(_MARKS)
        if not (letters.isalpha() and letters.islower()) and not _LATIN.fullmatch(letters.decode("utf-8", "replace")):
            return _bytes_of(self._tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if len(letters) < len(word):
            # The word without its marks is likely to occur as well, and the marks are few.
            return self[letters] + self._of_marks(word[len(letters):])
        shown = letters.decode() if letters.isascii() else "".join(
            [self._letters[b] for b in letters.decode().lower().encode()])
        return _bytes_of([t.id for t in self._model.tokenize(shown)])

    def _of_marks(self, marks: bytes) -> bytes:
        found = self._marks.get(marks)
        if found is None:
            found = _bytes_of([t.id for t in self._model.tokenize(marks.decode())])
            if len(marks) <= 8 and len(self._marks) < 4096:
                self._marks[marks] = found
        return found

    def of(self, text: bytes) -> bytes:
        """All ids of a text. Strings of special tokens keep their case, and so do words in which a mark may
        belong to a capital; all else is lower-cased first, as the normalizer would do, so that fewer words
        differ."""
        if b"<|" in text:
            words = text.split()
        elif _MARKED.search(text):
            words = [w if _MARKED.search(w) else w.lower() for w in text.split()]
        else:
            words = text.lower().split()
        return b"".join(map(self.__getitem__, words))
