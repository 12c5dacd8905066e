"""Best-fit decreasing packing of documents into sequences.

Best-fit decreasing looks only at lengths, and lengths are at most the
capacity.  So the packing of the whole corpus is solved on the histogram of
lengths (``capacity`` numbers, whatever the corpus): bins that are equally full
are kept as one range of bin numbers, a segment tree over the remaining
capacities finds the tightest range that still takes a length in logarithmic
time, and a run of equal lengths fills a range at once.  The result is exactly
that of best-fit decreasing, document by document.  Each piece then finds its
place from its length and its rank among the pieces of that length; ranks come
from counts per task and length, so no length is gathered anywhere.

Defined results: a null text is empty and holds the separator only; repeated
rows and ids are packed as often as they occur; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, saved, sized
from .tokens import shared_ids, tokenizer_path

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: which of them has open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1 - 1).bit_length()
        while self.size < capacity + 1:
            self.size *= 2
        self.any = [False] * (2 * self.size)

    def set(self, at: int, value: bool) -> None:
        i = at + self.size
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int:
        """The smallest open capacity of ``least`` or more, else -1."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


@dataclass
class Placement:
    """``n_bins`` bins from ``first_bin`` each take ``each`` pieces of ``length``, of the ranks from ``rank`` on."""

    length: int
    rank: int
    each: int
    n_bins: int
    first_bin: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Place ``histogram[length]`` pieces of each length; equal lengths go to bins in their order.

    Among equally tight bins the lowest range opened last-in is taken first;
    the number of bins doesn't depend on it.
    """
    tree, open_bins, out, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"no bin takes a piece of {length}")
        later: list[tuple[int, int, int]] = []  # ranges that are full for this length
        while left:
            room = tree.tightest(length)
            if room < 0:
                first, n, new = bins, -(-left // (capacity // length)), True
                room = capacity
            else:
                first, n = open_bins[room].pop()
                new = False
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                out.append(Placement(length, rank, each, full, first, capacity - room))
                rank += full * each
                left -= full * each
                later.append((room - each * length, first, full))
            if full < n and left and left < each:
                out.append(Placement(length, rank, left, 1, first + full, capacity - room))
                later.append((room - left * length, first + full, 1))
                rank += left
                left, full = 0, full + 1
            if new:
                bins += full
            elif full < n:
                later.append((room, first + full, n - full))
        for room, first, n in later:
            if room:
                open_bins.setdefault(room, []).append((first, n))
                tree.set(room, True)
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, path: str | None = None) -> DataFrame:
    """Token pieces of all documents, with the task that made each and its rank there among equal lengths.

    Only documents longer than ``capacity`` are cut.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    end = int(separator).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, part, ranks = shared_ids(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for doc, coded in zip(batch["doc_id"], ids.batch(texts), strict=True):
                coded += end
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    one = coded[at : at + 4 * capacity]
                    n = len(one) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(one), part, ranks[n]))
                    ranks[n] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out
        ids.forget()  # a text holds so many words of its own that the next task would learn most anew

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInPandas(released(cut), PIECES)


def place(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for saved ``pieces``."""
    spark = made.sparkSession
    counts = saved(made.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # at most one row a length
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_decreasing(histogram, capacity)
    table = np.array([(p.length, p.rank, p.each, p.first_bin, p.offset) for p in plan], dtype=np.int64).reshape(-1, 5)
    order = np.lexsort((table[:, 1], table[:, 0]))
    shipped = spark.sparkContext.broadcast(table[order])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shipped.value
        # a key that orders by length, then rank: ranks of one length are below the sum of all
        scale = int(t[:, 1].max(initial=0)) + 1
        keys = t[:, 0] * scale + t[:, 1]
        for b in batches:
            length = b["length"].to_numpy(np.int64)
            rank = (b["rank"] + b["before"]).to_numpy(np.int64)
            # ranks beyond the last placement's first rank belong to that placement
            at = np.searchsorted(keys, length * scale + np.minimum(rank, scale - 1), "right") - 1
            k = rank - t[at, 1]
            out = b[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["sequence_id"] = t[at, 3] + k // t[at, 2]
            out["offset"] = t[at, 4] + (k % t[at, 2]) * length
            yield out

    return made.join(sized(starts), ["length", "part"]).mapInPandas(released(assign), PACKED)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, separator: int = 0, path: str | None = None) -> DataFrame:
    """One row per piece of every document, packed into sequences of at most ``capacity`` tokens."""
    return place(saved(pieces(docs, capacity, separator, path), "pieces"), capacity)
