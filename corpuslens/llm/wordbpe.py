"""Ids of whole texts by a BPE with word ends, through the tokenizers library, with a cache of pieces.

The tokenizer drops white space and merges nothing across it, and its special strings hold none; so a text may be cut at
spaces and line ends, and a piece's ids don't depend on its place. Texts of Latin-1 alone are cut further, into the very
pieces that the tokenizer makes of them, since there its normal form is the text in lower case; they go to its BPE model
directly.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import public_tokenizers
from tokenizers import Tokenizer

from .bpe import byte_of_char

MODEL = "word_bpe_49k.json"
#: The tokenizer's own pattern for lower-case Latin-1 (fixed values: its contractions, letters and numbers up to U+00FF).
_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r\x20\x85\xa0"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


def _slices(text: str, size: int) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end at spaces."""
    at = 0
    while len(text) - at > size and (end := text.find(" ", at + size)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


class _Pieces(dict):
    """Ids of pieces (little-endian 32-bit, as bytes). Those of the last ``limit`` and up to as many before are kept."""

    RECENT = 48

    def __init__(self, encode: Callable[[str], list[int]], limit: int) -> None:
        self.encode, self.limit = encode, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.encode(piece)).tobytes()
        if len(piece) <= self.RECENT:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class WordEncoder:
    """One for a Python worker, see :func:`encoder`. Memory: twice ``limit`` pieces, and those of ``AT_ONCE`` characters."""

    AT_ONCE = 1 << 20

    def __init__(self, model: str, limit: int = 600_000) -> None:
        self.model = Tokenizer.from_file(public_tokenizers.path(model))
        self.size = max(self.model.get_vocab(with_added_tokens=True).values()) + 1
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        bpe, visible = self.model.model, {b: c for c, b in byte_of_char().items()}
        self.words = _Pieces(lambda p: [t.id for t in bpe.tokenize(p if p.isascii() and p.isalnum() else p.encode().decode("latin-1").translate(visible))], limit)
        self.others = _Pieces(lambda p: self.model.encode(p, add_special_tokens=False).ids, limit // 8)

    def _encoded(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            plain = not any(x in text for x in self.special)
        except UnicodeEncodeError:
            plain = False
        if plain:
            return b"".join(map(self.words.__getitem__, PIECES.findall(text.lower())))
        return b"".join(map(self.others.__getitem__, text.replace("\n", " ").split(" ")))

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, little-endian 32-bit."""
        if len(text) <= self.AT_ONCE:
            return self._encoded(text)
        return b"".join(map(self._encoded, _slices(text, self.AT_ONCE)))


_KEPT: dict[str, WordEncoder] = {}


def encoder(model: str = MODEL) -> WordEncoder:
    if model not in _KEPT:
        _KEPT[model] = WordEncoder(model)
    return _KEPT[model]
