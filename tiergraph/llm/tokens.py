"""Token ids by a public tokenizer, word by word.

The tokenizer drops white space and never joins across it, so a text's ids are those of its parts between spaces and
line ends; each distinct part is encoded once and kept. Parts are lower-cased before the look-up where that is surely
the tokenizer's own lower-casing, and a word is split from one mark that follows it. Texts in which a special token's
string may stand go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

#: Parts kept at a time in one Python worker.
CACHE = 500_000
#: Precomposed letters and marks that lower-casing maps one by one.
_PLAIN = re.compile("[\x00-\u012f\u0132-\u024f]*")
_MARKS = tuple(".,;:!?")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """encode(text) gives ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept in the machine's own order, which must be little-endian with 4 bytes")
        super().__init__()
        self.path = path
        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}

    def _raw(self, text: str) -> bytes:
        return array("I", self.tool.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        """part: lower case, without white space, of letters that normalisation leaves as they are."""
        word = part[:-1] if part[-1:] in _MARKS else part
        if not word.isalpha():
            ids = self._raw(part)
        elif word is not part:
            ids = self[word] + self[part[-1]]
        else:
            plain = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            ids = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[part] = ids
        return ids

    def _part(self, part: str) -> bytes:
        return self[part.lower()] if _PLAIN.fullmatch(part) else self._raw(part)

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return self._raw(text)
        parts = text.replace("\n", " ")
        if text.isascii() or _PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, parts.lower().split(" ")))
        return b"".join(map(self._part, parts.split(" ")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
