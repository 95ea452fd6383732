"""Encoding by chunks that a byte-level tokenizer handles independently of each other.

Where no space touches other white space, every match of the split pattern that begins with a
space begins a new chunk, so a chunk (a space and what follows up to the next one) has the same
ids wherever it stands. Few chunks are distinct, so tasks remember what they made of them.
"""

from __future__ import annotations

import array
import base64
import sys
from collections.abc import Callable

# Longer chunks are not remembered.
REMEMBERED_CHARS = 64


class ChunkEncoder:
    """Text -> bytes, by ``encode`` for any text; chunks are remembered within ``limit`` entries.

    ``encode`` must split by a pattern in which only white space looks ahead and a space may
    begin a match.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int):
        self.encode_any, self.limit = encode, limit
        self.known: dict[str, bytes | None] = {}

    def missing(self, parts: list[str]) -> list[str]:
        """Inner parts not yet known, for callers that make many at once."""
        return [part for part in {*parts[1:-1]}.difference(self.known) if independent(part)]

    def learn(self, part: str) -> bytes | None:
        value = self.encode_any(" " + part) if independent(part) else None
        if len(part) <= REMEMBERED_CHARS:
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[part] = value
        return value

    def encode(self, text: str) -> bytes:
        parts = text.split(" ")
        if len(parts) < 3 or parts[0][-1:].isspace() or parts[-1][:1].isspace():
            return self.encode_any(text)
        known, learn, head, tail = self.known, self.learn, parts[0], parts[-1]
        try:
            middle = b"".join(map(known.__getitem__, parts[1:-1]))
        except KeyError:
            values = [known[part] if part in known else learn(part) for part in parts[1:-1]]
            if None in values:
                return self.encode_any(text)
            middle = b"".join(values)
        except TypeError:  # a part that touches white space
            return self.encode_any(text)
        return (self.encode_any(head) if head else b"") + middle + self.encode_any(" " + tail)


def independent(part: str) -> bool:
    """May this part stand between two spaces? Not when white space touches either of them."""
    return part != "" and part.strip() == part


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [byte for byte in range(256) if byte not in set(own)]
    return {chr(byte): byte for byte in own} | {chr(256 + n): byte for n, byte in enumerate(others)}


def little_endian(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    values = array.array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()
