"""Texts cut at spaces into pieces that a byte-level tokenizer treats independently, and a bounded cache of their ids.

The tokenizer's pattern attaches one space to what follows it. A space before a
character that is not white space therefore always begins a new token, and a
text may be cut there: the ids of the text are the ids of its pieces in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

_LOOSE = re.compile(r" (?=\s|$)")
SPECIAL = "<|endoftext|>"
Encode = Callable[[list[str]], list[bytes]]


def pieces(text: str) -> list[str]:
    """Pieces of a text. Each but the first stands for itself with one space before it."""
    parts = text.split(" ")
    if not _LOOSE.search(text):
        return parts
    joined = parts[:1]
    for part in parts[1:]:
        if not part or part[0].isspace():
            joined[-1] += " " + part
        else:
            joined.append(part)
    return joined


class PieceCache:
    """Ids of pieces as bytes, kept in two generations of at most ``limit`` entries.

    ``encode`` turns any strings into the ids of each, ``encode_pieces`` does so
    for strings that all start with a space before something else. What is not
    kept is encoded again, so the limit bounds memory and changes no result.
    """

    def __init__(self, encode: Encode, encode_pieces: Encode | None = None, limit: int = 400_000):
        self.encode, self.encode_pieces, self.limit = encode, encode_pieces or encode, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, wanted: set[str], before: str = "") -> None:
        """Make sure that the ids of these keys, each with ``before`` before it, are among the young ones."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        missing = []
        for key in wanted.difference(self.young):
            if (known := self.old.get(key)) is None:
                missing.append(key)
            else:
                self.young[key] = known
        if missing:
            self.young.update(zip(missing, self.encode_pieces([before + key for key in missing]), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. The texts hold no special token."""
        cut = [pieces(t) for t in texts]
        heads = self.encode([parts[0] for parts in cut])
        self.learn(set().union(*[parts[1:] for parts in cut]), " ")
        get = self.young.__getitem__
        return [head + b"".join(map(get, parts[1:])) for head, parts in zip(heads, cut, strict=True)]


def as_ids(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{width}")
