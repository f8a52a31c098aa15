"""Byte-level BPE ids of whole texts by the public tokenizer, with a cache of text pieces.

The tokenizer splits a text before it merges anything, and a run of white space always begins a new piece unless it
ends in a single space that a word takes along. So the text may be cut before every single space, and each cut-off
part has the same ids alone as in place. Where two spaces meet, cuts come only before a space that a non-space
follows.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable
from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

MODEL = "byte_bpe_50k.json"
#: The same vocabulary as merge ranks: parts never met before are encoded with them, several times faster. Texts with a
#: special token's string go through the tokenizer file itself, and the tests hold both against each other.
RANKS = {MODEL: "byte_bpe_50k.tiktoken"}
_CUT = re.compile(r" (?=\S)")


def byte_of_char() -> dict[str, int]:
    """The visible character that stands for each byte in the vocabulary: printable bytes for themselves, the rest
    by code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Parts(dict):
    """Ids of parts of texts (little-endian 32-bit, as bytes); all but a text's first part follow a space."""

    LIMIT, RECENT = 500_000, 48

    def __init__(self, model: Callable[[str], list[int]], lead: str) -> None:
        self.model, self.lead = model, lead
        self.bare = self if not lead else _Parts(model, "")

    def __missing__(self, part: str) -> bytes:
        ids = self._ids(part)
        if len(part) <= self.RECENT:
            if len(self) >= self.LIMIT:
                self.clear()
            self[part] = ids
        return ids

    def _ids(self, part: str) -> bytes:
        """A line end between two non-spaces, and a mark after letters, are pieces of their own; so the letters' ids
        are looked up by themselves."""
        head, end, tail = part.partition("\n")
        if end and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self.bare.encoded("\n") + self.bare[tail]
        if len(part) > 1 and part[-1] in ".,;:!?" and part[:-1].isalpha():
            return self[part[:-1]] + self.bare.encoded(part[-1])
        return self.encoded(part)

    def encoded(self, part: str) -> bytes:
        ids = self.get(part)
        return array("I", self.model(self.lead + part)).tobytes() if ids is None else ids


class Encoder:
    """One for a Python worker, see :func:`encoder`."""

    def __init__(self, model: str) -> None:
        self.model = Tokenizer.from_file(public_tokenizers.path(model))
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(public_tokenizers.path(RANKS[model])).read_bytes().splitlines())}
        plain = tiktoken.Encoding(model, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = [t.content for t in self.model.get_added_tokens_decoder().values()]

        def ids(text: str) -> list[int]:
            if any(t in text for t in special):
                return self.model.encode(text, add_special_tokens=False).ids
            return plain.encode_ordinary(text)

        self.later = _Parts(ids, " ")
        self.first = self.later.bare
        self._bytes: np.ndarray | None = None

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, little-endian 32-bit."""
        if not text:
            return b""
        parts = _CUT.split(text) if "  " in text else text.split(" ")
        return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))

    def n_bytes(self) -> np.ndarray:
        """The number of text bytes of each id."""
        if self._bytes is None:
            of = byte_of_char()
            vocab = self.model.get_vocab(with_added_tokens=True)
            self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self._bytes[i] = len(token) if all(c in of for c in token) else len(token.encode())
        return self._bytes


_KEPT: dict[str, Encoder] = {}


def encoder(model: str = MODEL) -> Encoder:
    if model not in _KEPT:
        _KEPT[model] = Encoder(model)
    return _KEPT[model]
