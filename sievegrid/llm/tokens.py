"""Token ids of columns of texts, by a public tokenizer's ranks, which the driver reads and broadcasts: under 1 MB."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Fixed value: the pre-token pattern that the byte-level ranks were made with, in its faster form without backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: A longer run is encoded by the stretch, cut before a space that follows a letter.
STRETCH = 1 << 20


class Encoder:
    """Ids below 2^16; ``end`` is the first free one."""

    def __init__(self, content: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1

    def ids(self, text: str) -> list[int]:
        """The ids of a text and the end token."""
        out: list[int] = []
        at = 0
        while len(text) - at > STRETCH:
            cut = text.rfind(" ", at + 1, at + STRETCH)
            while cut > at and not text[cut - 1].isalpha():
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                break
            out += self.encoding.encode_ordinary(text[at:cut])
            at = cut
        rest = self.encoding.encode_ordinary(text[at:])
        rest.append(self.end)
        return out + rest if out else rest

    def sizes(self, texts: pa.Array) -> np.ndarray:
        """Numbers of ids, ends included."""
        return np.fromiter((len(self.ids(t or "")) for t in texts.to_pylist()), np.int64, len(texts))

    def encode(self, texts: pa.Array, rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids, bounds) by chunks of rows."""
        for first in range(0, len(texts), rows):
            part = [np.array(self.ids(t or ""), np.uint16) for t in texts.slice(first, rows).to_pylist()]
            yield first, first + len(part), np.concatenate(part), np.concatenate([[0], np.cumsum([len(p) for p in part])])


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The content of a file that only the driver needs to see."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=2)
def encoder(content: bytes) -> Encoder:
    """One a worker."""
    return Encoder(content)
