"""Packing by optimal length buckets.

Sequences are padded to their bucket's length. Dynamic programming over the histogram of all lengths chooses the
boundaries of least padding; inside a bucket, seeded order deals sequences to batches of a token budget. Documents longer
than ``max_len`` tokens are cut into pieces of that length, so the histogram has at most ``max_len`` rows, whatever
the corpus holds.

Defined cases: a null or empty text gives one row of length 0 without bucket, batch and tokens; repeated rows and null ids are
packed as separate documents; an empty table gives an empty one; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.tokens import encoder, share_ranks
from sievegrid.operators.ordering import shuffled_prefix
from sievegrid.session import stage


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` lengths that give the least padding. lengths: rising and distinct."""
    d = len(lengths)
    if d == 0:
        return []
    k = min(buckets, d)
    number = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    words = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    best = np.full(d + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(k):
        then, cut = np.full(d + 1, np.inf), np.zeros(d + 1, int)
        then[0] = 0.0
        for j in range(1, d + 1):
            cost = best[:j] + lengths[j - 1] * (number[j] - number[:j]) - (words[j] - words[:j])
            cut[j] = int(np.argmin(cost))
            then[j] = cost[cut[j]]
        best = then
        cuts.append(cut)
    ends, j = [], d
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = cut[j]
    return ends[::-1]


def pack(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 8,
    max_len: int = 2048,
    budget: int = 32768,
    seed: int = 23,
) -> DataFrame:
    """(id, piece, start, length, bucket, bucket_len, padding, batch, slot, tokens), a row a piece.

    Units are tokens of the tokenizer at ``ranks_path``; the end of a text counts as one. ``tokens`` holds a piece's ids as
    little-endian uint16. A batch is the pair (bucket, batch); it holds at most budget // bucket_len pieces, and is full
    but for a bucket's last.
    """
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(text), F.lit(seed)).alias("draw"), text.alias("text"))
    ranks = share_ranks(docs.sparkSession, ranks_path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, ids, bounds in encoder(ranks.value).encode(batch.column(2)):
                size = np.diff(bounds)
                size = np.where(size == 1, 0, size)  # an end alone
                pieces = np.maximum(-(-size // max_len), 1)
                owner = np.repeat(np.arange(last - first), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = piece * max_len
                length = np.minimum(size[owner] - begin, max_len)
                at = bounds[owner] + begin
                tokens = [ids[i : i + n].astype("<u2").tobytes() if n else None for i, n in zip(at, length, strict=True)]
                names = [batch.column(i).slice(first, last - first).take(pa.array(owner)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(piece), pa.array(begin), pa.array(length), pa.array(tokens, pa.binary())], names=["id", "draw", "piece", "start", "length", "tokens"])

    kind = base.schema["id"].dataType.simpleString()
    pieces = stage(base.mapInArrow(cut, f"id {kind}, draw long, piece long, start long, length long, tokens binary"), "pieces")

    histogram = pieces.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()
    ends = best_boundaries(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets)
    fits = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array().cast("array<long>")
    bucket = F.size(F.filter(fits, lambda e: e < F.col("length")))
    placed = pieces.where("length > 0").withColumn("bucket", bucket).withColumn("bucket_len", F.get(fits, F.col("bucket")))
    dealt = shuffled_prefix(placed, ["bucket"], F.lit(1), F.xxhash64("draw", "piece"), "at").withColumn("room", F.floor(F.lit(budget) / F.col("bucket_len")))
    nothing = {"bucket": "int", "bucket_len": "long", "padding": "long", "batch": "long", "slot": "long"}
    empty = pieces.where("length = 0").select("id", "piece", "start", "length", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], "tokens")
    out = dealt.select("id", "piece", "start", "length", "bucket", "bucket_len", (F.col("bucket_len") - F.col("length")).alias("padding"), F.floor(F.col("at") / F.col("room")).alias("batch"), F.pmod("at", "room").alias("slot"), "tokens")
    return out.unionByName(empty).withColumnRenamed("id", id_col)
