"""Token ids of whole texts by a public byte-level BPE vocabulary, split at forced boundaries."""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank file of the vocabulary, and the pattern that splits text before its merges (fixed values of the public tokenizer).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of fragments whose ids a worker remembers before it starts anew, and of the longest remembered one.
REMEMBERED, WORTH = 1 << 23, 1 << 10


def read_ranks(path: str = VOCABULARY) -> bytes:
    """The rank file, read on the driver: its size is fixed by the vocabulary (under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and their ranks: a line holds a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def inside_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """At [a, b] whether byte b follows byte a inside any token. Where it doesn't, no merge ever joins the two."""
    inside = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        b = np.frombuffer(token, dtype=np.uint8)
        inside[b[:-1], b[1:]] = True
    return inside


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """At each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


class Encoder:
    """Encodes texts fragment by fragment.

    A cut between two bytes is certain if the pair occurs inside no token, so that no merge crosses it, and if the
    splitting pattern treats both sides alone as it does together. The latter holds between a visible ASCII
    character and a following white space (a piece of the pattern never goes on from the one to the other, and its
    only look ahead is for white space), and inside a run of letters. Fragments between certain cuts are
    encoded independently and the ids put together; equal fragments are encoded once.
    """

    def __init__(self, data: bytes):
        import tiktoken

        self.ranks = parse_ranks(data)
        self.inside = inside_pairs(self.ranks)
        self._bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        #: visible ASCII characters before which nothing joins with a line end
        self._before = frozenset(chr(c) for c in range(0x21, 0x7F) if not self.inside[c, ord("\n")])
        self._apart = ~self.inside.ravel()
        self._known: dict[str, array] = {}
        self._known_chars = 0

    def _letter_cuts(self, text: str) -> list[int]:
        """The places of all certain boundaries between two letters."""
        b = np.frombuffer(text.encode(), dtype=np.uint8)
        pair = b[:-1].astype(np.uint16)
        pair <<= 8
        pair |= b[1:]
        at = np.flatnonzero(self._apart.take(pair))
        if not len(at):
            return []
        begins = (b & 0xC0) != 0x80
        chars = np.cumsum(begins) - 1
        at = chars[1:][at[begins[1:][at]]]
        letter = _letters().take(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
        return at[letter[at - 1] & letter[at]].tolist()

    def _lines(self, text: str) -> list[str]:
        """text between the certain cuts before line ends."""
        out: list[str] = []
        held: list[str] = []
        for part in text.split("\n"):
            if held and held[-1][-1:] in self._before:
                out.append("".join(held))
                held = ["\n" + part]
            else:
                held.append("\n" + part if held else part)
        return [*out, "".join(held)]

    def fragments(self, text: str) -> list[str]:
        """The fragments of text between certain cuts, before line ends and inside runs of letters, whatever its length."""
        cuts = self._letter_cuts(text)
        out, start, i = [], 0, 0
        for line in self._lines(text):
            end = start + len(line)
            while i < len(cuts) and cuts[i] < end:
                out.append(text[start : cuts[i]])
                start, i = cuts[i], i + 1
            out.append(text[start:end])
            start = end
        return out

    def encode(self, text: str) -> array:
        """The ids of text, without special tokens; strings that look like them are ordinary text.

        Each fragment is encoded alone; those that a worker has met lately have their ids already.
        """
        ids = array("i")
        known = self._known
        for part in self.fragments(text):
            have = known.get(part)
            if have is None:
                have = array("i", self._bpe.encode_ordinary(part))
                if len(part) <= WORTH:
                    if self._known_chars > REMEMBERED:
                        known.clear()
                        self._known_chars = 0
                    known[part] = have
                    self._known_chars += len(part)
            ids += have
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a list of ids."""
        return self._bpe.decode_bytes(ids)


_data: dict[str, bytes] = {}


@lru_cache(maxsize=4)
def _encoder_of(digest: str) -> Encoder:
    return Encoder(_data[digest])


def encoder(data: bytes) -> Encoder:
    """The encoder of a vocabulary; a worker process builds it once."""
    digest = hashlib.sha256(data).hexdigest()
    _data[digest] = data
    return _encoder_of(digest)


def token_ids(text: str | Column, ranks: bytes) -> Column:
    """A column of the ids of each text. An empty and a null text give an empty list."""

    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(ranks)
        for part in parts:
            flat, ends = array("i"), array("i", [0])
            for t in part:
                if t.is_valid:
                    flat += e.encode(t.as_py())
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32)))

    return F.arrow_udf(ids, "array<int>")(text)


def token_counts(text: str | Column, ranks: bytes) -> Column:
    """A column of the number of tokens of each text; 0 for an empty and a null one."""

    def counts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(ranks)
        for part in parts:
            yield pa.array([len(e.encode(t)) if t else 0 for t in part.to_pylist()], type=pa.int64())

    return F.arrow_udf(counts, "long")(text)


def byte_lengths(ids: str | Column, text: str | Column, ranks: bytes) -> Column:
    """A column of the number of bytes that the ids decode to, or -1 where these differ from the text's."""

    def lengths(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        e = encoder(ranks)
        for a, b in parts:
            out = []
            for i, t in zip(a.to_pylist(), b.to_pylist()):
                back = e.decode(i)
                out.append(len(back) if back == (t or "").encode() else -1)
            yield pa.array(out, type=pa.int64())

    return F.arrow_udf(lengths, "long")(ids, text)
