"""Periodic runs of words, by bit-parallel lags.

A run is a stretch of words with smallest period q, at least max(least, times * q) long, that no neighbour extends.
The ids of a text's words are big-integer bit planes. For a lag q the planes are XORed with themselves shifted by q and the
differences ORed: zeros are words equal to the one q further on. Zero stretches shorter than the least are removed by
shift-doubling AND; what stays is where runs begin. A stretch of a multiple of its smallest period is the same
stretch as that period's, since it holds at least twice the longer one, and is reported once.

Lags that can't have a run are passed over: if m is the power of two with m/2 < q <= m, the m words at each of the first
words of a run have their next equal m words exactly q further on, at more than q places. Equal stretches are told apart by
exact ranks, doubled in width each step, over all texts of a chunk at once, so only texts with some candidate lag make planes,
and a text of n words has at most some sqrt(n) of them, whatever is in it.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a null id is looked at like others;
repeated rows get repeated results; an empty table gives an empty one; texts are whole, of any length; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.textvec import chunks, packed_words

RUN = "struct<start:long,length:long,period:long>"


def candidate_lags(ids: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> dict[int, list[int]]:
    """The lags that may have a run, by row. ``ids`` differ between rows; row r has the places bounds[r] to bounds[r + 1]."""
    n, width = len(ids), 1
    rank, alive, end = ids.astype(np.int64), np.arange(len(ids)), bounds[1:][row]
    found: dict[int, list[int]] = {}
    while len(alive):
        order = alive[np.argsort(rank[alive], kind="stable")]
        same = rank[order[1:]] == rank[order[:-1]]
        first, second = order[:-1][same], order[1:][same]
        gap = second - first
        fits = (2 * gap > width) & (gap <= width)
        lags, times = np.unique(row[first[fits]] * (n + 1) + gap[fits], return_counts=True)
        for key in lags[times > lags % (n + 1)].tolist():
            found.setdefault(key // (n + 1), []).append(key % (n + 1))
        again = np.zeros(n, bool)
        again[first] = again[second] = True
        nxt = alive[again[alive] & (alive + 2 * width <= end[alive])]
        nxt = nxt[again[nxt + width]]
        wider = np.full(n, -1, np.int64)
        wider[nxt] = np.unique(rank[nxt] * n + rank[nxt + width], return_inverse=True)[1]
        rank, alive, width = wider, nxt, 2 * width
    return found


def planes_of(ids: np.ndarray) -> list[int]:
    """Bit b of the word ids of all places, as one integer for each b."""
    dense = np.unique(ids, return_inverse=True)[1]
    bits = int(dense.max()).bit_length() if len(dense) else 0
    return [int.from_bytes(np.packbits(((dense >> b) & 1).astype(bool), bitorder="little").tobytes(), "little") for b in range(bits)]


def runs_at(planes: list[int], n: int, q: int, least: int, times: int) -> list[tuple[int, int]]:
    """(start, length) of the longest stretches of period q that are long enough."""
    need = max(least, times * q) - q
    if need + q > n:
        return []
    differ = 0
    for plane in planes:
        differ |= plane ^ (plane >> q)
    equal = ~differ & ((1 << (n - q)) - 1)
    have = 1
    while have < need and equal:
        step = min(have, need - have)
        equal &= equal >> step
        have += step
    if not equal:
        return []
    bits = np.unpackbits(np.frombuffer(equal.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]]).astype(np.int8)))
    return [(a, b - a - 1 + need + q) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def runs_of(ids: np.ndarray, lags: list[int], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, ordered by start, then period."""
    planes, seen, out = planes_of(ids), set(), []
    for q in sorted(lags):
        for stretch in runs_at(planes, len(ids), q, least, times):
            if stretch not in seen:
                seen.add(stretch)
                out.append((*stretch, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row: runs as (start, length, period) by start, then period.

    ``collapsed`` has the words but for those that a run contains after its first period, joined by one space.
    ``times`` must be 4 or more: the filter of lags rests on that.
    """
    if times < 4:
        raise ValueError("times must be at least 4")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                rows = last - first
                word, row = packed_words(data, offsets)
                counts = np.bincount(row, minlength=rows)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                codes = word.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = np.unique(row * (len(word) + 1) + codes, return_inverse=True)[1]
                runs: list[list[dict]] = [[] for _ in range(rows)]
                gone = np.zeros(len(word) + 1, np.int64)
                for r, lags in candidate_lags(ids, row, bounds).items():
                    for start, length, period in runs_of(ids[bounds[r] : bounds[r + 1]], lags, least, times):
                        runs[r].append({"start": start, "length": length, "period": period})
                        gone[bounds[r] + start + period] += 1
                        gone[bounds[r] + start + length] -= 1
                kept = np.cumsum(gone)[:-1] == 0
                sizes = np.bincount(row[kept], minlength=rows)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), word.filter(pa.array(kept)).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(counts), pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pc.binary_join(listed, " ")],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_col)
