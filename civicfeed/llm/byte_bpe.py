"""Byte-level BPE by sentencepiece: a model serialised from a rank file, encoding and exact decoding."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import with_scores

#: Distinct pre-tokens that a Python worker keeps at most; on overflow it starts anew.
CACHE = 200_000


def byte_letters() -> list[str]:
    """A printable, non-space character for each byte: itself where it is one, else the next one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE ModelProto whose piece with id r is the token of rank r and scores -r.

    Bytes become letters, text is not normalised, and no space is added, removed or escaped. The unknown
    piece, which a vocabulary of all bytes never uses, comes last.
    """
    letters = byte_letters()
    by_rank = {r: t for t, r in ranks.items()}
    size = max(by_rank) + 1
    pieces = []
    for r in range(size):
        token = by_rank.get(r)
        name = "".join(letters[b] for b in token) if token is not None else f"▁gap{r}"
        kind = 1 if token is not None else 5  # normal, unused
        pieces.append((name, -float(r), kind))
    pieces.append(("<unk>", 0.0, 2))
    body = b"".join(
        _bytes_field(1, _bytes_field(1, name.encode()) + b"\x15" + struct.pack("<f", score) + _int_field(3, kind))
        for name, score, kind in pieces
    )
    off = 2**64 - 1  # -1: no such piece
    trainer = _int_field(3, 2) + _int_field(4, len(pieces)) + _int_field(40, size)
    trainer += _int_field(41, off) + _int_field(42, off) + _int_field(43, off)
    normaliser = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return body + _bytes_field(2, trainer) + _bytes_field(3, normaliser)


class ByteBPE:
    """Encoder and decoder of one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.letters = dict(enumerate(byte_letters()))
        # the rank files' own library takes \s as Unicode's White_Space; Python's has U+001C to U+001F besides
        own = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.find = regex.compile(own).findall
        self.seen: dict[str, list[int]] = {}

    def _learn(self, tokens: Iterator[str]) -> None:
        new = [t for t in set(tokens) if t not in self.seen]
        if len(self.seen) + len(new) > CACHE:
            self.seen.clear()
        hard = []
        for t in new:
            rank = self.ranks.get(t.encode())
            if rank is None:
                hard.append(t)
            else:
                self.seen[t] = [rank]  # a token of the vocabulary stays whole
        mapped = [t.encode().decode("latin-1").translate(self.letters) for t in hard]
        self.seen.update(zip(hard, self.processor.encode(mapped, num_threads=1), strict=True))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; null and empty texts have none."""
        tokens = self.find(text or "")
        seen = self.seen
        try:
            return list(chain.from_iterable([seen[t] for t in tokens]))
        except KeyError:
            self._learn(tokens)
            if all(t in self.seen for t in set(tokens)):
                return list(chain.from_iterable([seen[t] for t in tokens]))
            self.seen.clear()
            self._learn(tokens)
            return list(chain.from_iterable([seen[t] for t in tokens]))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; an id outside the vocabulary is an error."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder in each Python worker."""
    return ByteBPE(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array<int>) of each whole text and, if asked for, ``decoded`` (binary) from those ids.

    Null and empty texts have no ids and decode to no bytes. Each row is encoded by itself: repeated rows
    get equal ids, an empty frame stays empty, and input columns named like a result are replaced.
    """

    def fn(texts: list[str | None]) -> dict[str, list]:
        bpe = coder(path, pattern)
        ids = [bpe.encode(t) for t in texts]
        out: dict[str, list] = {"ids": ids}
        if decoded:
            out["decoded"] = [bpe.decode(x) for x in ids]
        return out

    return with_scores(df, text, fn, {"ids": "array<int>"} | ({"decoded": "binary"} if decoded else {}))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of the ids; null ids decode to null."""

    def fn(rows: list[list[int] | None]) -> dict[str, list]:
        bpe = coder(path, pattern)
        return {"decoded": [None if x is None else bpe.decode(x) for x in rows]}

    return with_scores(df, ids, fn, {"decoded": "binary"})
