"""Comparing the members of buckets tile by tile.

A bucket of up to ``TILE`` members is one tile.  A larger one is dealt into
chunks, and each pair of chunks is a tile, so that no task holds more than two
chunks and yet every pair of members meets once.  Pairs are never emitted: a
tile gives each member's links as a sum, and the edges of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released

TILE = 512
FOUND = "a long, b long, w long"


def dealt(members: DataFrame, key: list[str], n: Column, uid: str) -> DataFrame:
    """``members`` (with bucket size ``n``), once for each tile that they are in.

    Adds ``ti, tj`` (the tile of the bucket) and ``chunk``.
    """
    m = F.ceil(n / F.lit(TILE)).cast("int")
    out = members.withColumn("_m", m).withColumn("chunk", F.pmod(F.xxhash64(uid, F.lit(17)), F.col("_m")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return out.select(*members.columns, "chunk", F.least("chunk", "_o").alias("ti"), F.greatest("chunk", "_o").alias("tj"))


def forest(rows: np.ndarray, cols: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The pairs that join parts not joined before."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def each_group(rows: DataFrame, by: list[str], one: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``one`` on each group of rows with equal ``by``; groups are streamed in order, one held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch[c].to_numpy() for c in by]
            new = np.zeros(len(batch), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
            out = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                now = tuple(c[x] for c in cols)
                if now != last and held:
                    out.append(one(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                held.append(batch.iloc[x:y])
                last = now
            out = [o for o in out if o is not None]
            if out:
                yield pd.concat(out)
        if held and (o := one(pd.concat(held) if len(held) > 1 else held[0])) is not None:
            yield o

    return rows.repartition(*by).sortWithinPartitions(*by).mapInPandas(released(run), schema)


def pairs_of(tile: pd.DataFrame, compare: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """What ``compare`` finds in a tile; in a tile of two chunks, the pairs across them."""
    i, j = compare(tile)
    if len(i) and tile["ti"].iat[0] != tile["tj"].iat[0]:
        chunk = tile["chunk"].to_numpy()
        across = chunk[i] != chunk[j]
        i, j = i[across], j[across]
    return i, j


def found_rows(tile: pd.DataFrame, i: np.ndarray, j: np.ndarray, uid: str, weight: str) -> pd.DataFrame:
    """Rows (a, null, w) and (a, b, null) of the linked pairs (i, j) of a tile, as ``each_tile`` gives them."""
    ids, w = tile[uid].to_numpy(np.int64), tile[weight].to_numpy(np.int64)
    total = np.bincount(i, w[j], len(ids)) + np.bincount(j, w[i], len(ids))
    has = np.flatnonzero(total)
    edges = forest(i, j, len(ids))
    a = np.concatenate([ids[has], ids[[x for x, _ in edges]]])
    b = pd.array([None] * len(has) + ids[[y for _, y in edges]].tolist(), dtype="Int64")
    return pd.DataFrame({"a": a, "b": b, "w": pd.array(total[has].astype(np.int64).tolist() + [None] * len(edges), dtype="Int64")})


def each_tile(members: DataFrame, key: list[str], compare: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], uid: str = "rid", weight: str = "size") -> DataFrame:
    """Run ``compare`` on every tile of ``dealt`` members.

    ``compare`` gives positions (i, j), i < j, of the linked pairs of a tile.
    Returns rows (a, null, w): a has links to members that weigh w, and
    (a, b, null): an edge.
    """

    def one(tile: pd.DataFrame) -> pd.DataFrame | None:
        if len(tile) < 2:
            return None
        i, j = pairs_of(tile, compare)
        return found_rows(tile, i, j, uid, weight) if len(i) else None

    return each_group(members, [*key, "ti", "tj"], one, FOUND)
