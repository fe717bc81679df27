"""Cached encoding of text pieces: a piece seen before costs one dictionary lookup.

Cuts are made only where the tokenizer's own splitting pattern always cuts, so the joined ids equal those of the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

#: Executors run as many workers as they have cores; the tokenizers library must not start threads in each.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that a worker keeps; beyond that the cache starts anew, so memory stays bounded.
CACHE_PIECES = 500_000


class PieceCache:
    """piece -> encoded bytes; encode_many gets the pieces that are missing."""

    def __init__(self, encode_many: Callable[[list], Iterable], limit: int = CACHE_PIECES):
        self.encode_many, self.limit, self.known = encode_many, limit, {}

    def get(self, lists: list[list]) -> dict:
        need = set().union(*lists)
        missing = list(need.difference(self.known))
        if missing and len(self.known) + len(missing) > self.limit:
            self.known, missing = {}, list(need)
        self.known.update(zip(missing, self.encode_many(missing)))
        return self.known

    def find(self, pieces: list) -> list:
        """The encoded bytes of pieces that are all different."""
        out = list(map(self.known.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            some = [pieces[i] for i in missing]
            made = list(self.encode_many(some))
            if len(self.known) + len(some) > self.limit:
                self.known = {}
            self.known.update(zip(some, made))
            for i, x in zip(missing, made):
                out[i] = x
        return out


def lead_pieces(text: str) -> list:
    """For byte-level patterns in which a space belongs to the word behind it.

    Pieces after the first stand for " piece", or for themselves if they start with a line end. The first is a 1-tuple.
    """
    out: list = text.replace("\n", " \n").split(" ")
    out[0] = (out[0],)
    return out


def lead_source(piece) -> str | None:
    """The text that a piece of lead_pieces stands for; None if the pattern may not cut at its edges."""
    if isinstance(piece, tuple):
        return piece[0] if not piece[0] or not piece[0][-1].isspace() else None
    body = piece[1:] if piece[:1] == "\n" else piece
    if not body or body[0].isspace() or body[-1].isspace():
        return None
    return piece if body is not piece and piece[0] == "\n" else " " + piece


class LeadEncoder:
    """Whole texts to id bytes through lead_pieces; texts with other white space go to encode_many whole."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = CACHE_PIECES):
        self.plain = encode_many
        self.cache = PieceCache(self._many, limit)

    def _many(self, pieces: list) -> list:
        sources = [lead_source(p) for p in pieces]
        ids = iter(self.plain([s for s in sources if s is not None]))
        return [None if s is None else next(ids) for s in sources]

    def __call__(self, texts: list[str]) -> list[bytes]:
        lists = [lead_pieces(t) for t in texts]
        known = self.cache.get(lists).__getitem__
        out: list = []
        whole = []
        for i, pieces in enumerate(lists):
            try:
                out.append(b"".join(map(known, pieces)))
            except TypeError:  # a piece without an encoding of its own
                out.append(None)
                whole.append(i)
        if whole:
            for i, ids in zip(whole, self.plain([texts[i] for i in whole])):
                out[i] = ids
        return out


def byte_letters() -> dict[str, int]:
    """The printable characters by which a byte-level vocabulary file writes bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
