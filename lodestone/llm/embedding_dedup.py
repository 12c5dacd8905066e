"""Near copies among embeddings: iterative quantisation, multi-index Hamming tables, rerank by cosine.

On a bounded sample (``FIT_ROWS`` vectors, the first by a hash of their values)
principal directions are found and rotated, again and again, so that the signs
of the rotated vectors lose least: balanced binary codes.  Every vector gets
the codes of some rotations; each code is cut into substrings, and vectors of
one label that share a substring in one place meet in a bucket of that table.
Substrings grow with the logarithm of the largest label, as long as rotations
can be added until a pair at the threshold meets with the target recall; beyond
that they stay shorter and buckets grow.  How often the bits of such a pair
agree is measured on the sample, with its own near pairs and with vectors moved
to the threshold.  Within a bucket a pair is retrieved, in the first table where
it meets, if its codes of that table's rotation differ in few bits; retrieved
vectors are compared by cosine in double precision.  Buckets are worked through tile by tile (see ``tiles``).

Defined results: vectors are compared only within one label and length; those
that have a null label, are null, empty or zero, or hold null or non-finite
components link with nothing; equal rows link with each other; a null id never
names a component with ids; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, sized
from .components import connected_components
from .tiles import dealt, each_group, each_tile, pairs_of

THRESHOLD, TARGET_RECALL = 0.93, 0.999
BITS, FIT_ROWS, ITERATIONS, MAX_ROTATIONS = 64, 20_000, 40, 12  # more rotations only where substrings of one bit need them
PROBES, PROBE_ROTATIONS, LEAST_AGREEMENT = 4_000, 4, 0.25
BUCKET = 32  # members of a bucket that substrings are made long enough for


def fit_rotations(x: np.ndarray, count: int, bits: int = BITS, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the unit vectors ``x`` and ``count`` projections (dim x code bits) learned by iterative quantisation."""
    d = x.shape[1]
    c = min(d, bits)
    mean = x.mean(axis=0) if len(x) else np.zeros(d)
    v = x - mean
    _, axes = np.linalg.eigh(v.T @ v + 1e-9 * np.eye(d))
    axes = axes[:, ::-1][:, :c]
    low, out = v @ axes, []
    for k in range(count):
        r = np.linalg.qr(np.random.Generator(np.random.PCG64(k)).normal(size=(c, c)))[0]
        for _ in range(iterations if len(x) else 0):
            b = np.where(low @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(b.T @ low)
            r = (left @ right).T
        out.append(axes @ r)
    return mean, np.stack(out)


def plan_recall(agreements: list[np.ndarray], width: int, meetings: int) -> float:
    """The least mean chance that pairs whose bits agree so often share one of ``meetings`` substrings."""
    return min(float(np.mean(1 - (1 - a**width) ** meetings)) for a in agreements)


def plan_tables(n: int, bits: int = BITS, threshold: float = THRESHOLD, target: float = TARGET_RECALL, measured: list[np.ndarray] | None = None) -> tuple[int, int, int]:
    """Substring bits, tables a rotation, and rotations for ``n`` vectors of one label."""
    agreements = [np.array([1 - math.acos(threshold) / math.pi]), *(measured or [])]
    widest = min(bits, max(8, math.ceil(math.log2(max(n, 2) / BUCKET))))
    for width in range(widest, 0, -1):
        tables = max(1, bits // width)
        rotations = 1
        while plan_recall(agreements, width, tables * rotations) < target and (rotations < MAX_ROTATIONS or width == 1):
            rotations += 1
        if plan_recall(agreements, width, tables * rotations) >= target:
            break
    return width, tables, rotations


def measure_agreement(x: np.ndarray, mean: np.ndarray, projections: np.ndarray, threshold: float = THRESHOLD) -> list[np.ndarray]:
    """How often the bits of near pairs agree: of unit vectors ``x`` moved to the threshold, and of near pairs among them."""
    x = x[:PROBES]
    if len(x) < 2 or x.shape[1] < 2:
        return []
    away = np.random.Generator(np.random.PCG64(1)).normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    some = np.linspace(0, len(i) - 1, min(len(i), PROBES)).astype(int)
    pairs = [(x, threshold * x + math.sqrt(1 - threshold**2) * away), (x[i[some]], x[j[some]])]
    same = [np.concatenate([((a - mean) @ p >= 0) == ((b - mean) @ p >= 0) for p in projections], axis=1) for a, b in pairs if len(a)]
    return [np.maximum(s.mean(axis=1), LEAST_AGREEMENT) for s in same]


def code_radius(bits: int, threshold: float, measured: list[np.ndarray]) -> float:
    """Bits in which the codes of a near pair differ at most, four deviations beyond the pairs that agree least."""
    most = bits * (1 - min([1 - math.acos(threshold) / math.pi, *(float(a.min()) for a in measured)]))
    return most + 4 * math.sqrt(most)


def encode(x: np.ndarray, mean: np.ndarray, projections: np.ndarray) -> np.ndarray:
    """Codes (rows x rotations, as int64) of unit vectors."""
    weights = np.uint64(1) << np.arange(projections.shape[2], dtype=np.uint64)
    codes = [((((x - mean) @ p) >= 0).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64) for p in projections]
    return np.stack(codes, axis=1).view(np.int64)


def substrings(codes: np.ndarray, width: int, tables: int) -> np.ndarray:
    """Rows x (rotations * tables): the table keys of codes."""
    u = codes.view(np.uint64)
    mask = np.uint64((1 << width) - 1) if width < 64 else np.uint64(2**64 - 1)
    parts = [(u[:, r] >> np.uint64(t * width)) & mask for r in range(u.shape[1]) for t in range(tables)]
    return np.stack(parts, axis=1)


def _first_meeting(keys: np.ndarray, table: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return ~(keys[i, :table] == keys[j, :table]).any(axis=1) if table and len(i) else np.ones(len(i), bool)


def valid_vectors(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``vec_id, label, x, k1, k2`` of the vectors that can link; equal vectors of a label have equal k1, k2."""
    x = F.col("x")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    ok = F.col("label").isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("k1", F.xxhash64("label", "x")).withColumn("k2", F.xxhash64("x", F.lit(1), "label"))


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    every = valid_vectors(df, vec_id, embedding, label)
    reps = every.where("ok").groupBy("k1", "k2").agg(F.count("*").alias("size"), F.min("vec_id").alias("min_id"), F.min(F.struct("label", "x")).alias("one"))
    reps = saved(reps.select("k1", "k2", "size", "min_id", "one.label", "one.x").withColumn("rid", F.monotonically_increasing_id()), "vectors")

    largest = reps.groupBy("label", F.size("x").alias("dim")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    sample = [r["x"] for r in reps.orderBy(F.xxhash64("k1"), "rid").limit(FIT_ROWS).select("x").collect()]
    fitted, plans, radius = {}, {}, {}
    for d in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == d], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        measured = measure_agreement(x, *fit_rotations(x, PROBE_ROTATIONS), threshold)
        plans[d] = plan_tables(largest, min(BITS, d), threshold, target, measured)
        radius[d] = code_radius(min(BITS, d), threshold, measured)
        fitted[d] = fit_rotations(x, plans[d][2])

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            vectors = [np.asarray(v, dtype=np.float64) for v in b["x"]]
            dims = np.array([len(v) for v in vectors])
            codes: list = [None] * len(b)
            for d in set(dims.tolist()):
                at = np.flatnonzero(dims == d)
                x = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in at])
                if d not in fitted:  # a length that the sample doesn't hold
                    plans[d] = plan_tables(largest, min(BITS, d), threshold, target)
                    fitted[d] = fit_rotations(np.empty((0, d)), plans[d][2])
                for i, c in zip(at, encode(x, *fitted[d]), strict=True):
                    codes[i] = c
            keys = [substrings(c[None, :], *plans[d][:2])[0].view(np.int64) for c, d in zip(codes, dims.tolist(), strict=True)]
            yield pd.DataFrame({"rid": b["rid"], "label": b["label"].astype(str), "dim": dims, "code": codes, "keys": keys})

    codes = saved(reps.select("rid", F.col("label").cast("string").alias("label"), "x").mapInPandas(coded, "rid long, label string, dim int, code array<long>, keys array<long>"), "codes")

    # retrieval: who has a near code in a table where the two meet first
    place = ["label", "dim", "tab", "key"]
    members = codes.select("rid", "label", "dim", "code", "keys", F.posexplode("keys").alias("tab", "key"))
    sizes = saved(members.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    tiles = dealt(members.join(sized(sizes), place), place, F.col("n"), "rid")

    def near_codes(tile: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        codes, keys, dim = np.stack(tile["code"].to_numpy()).view(np.uint64), np.stack(tile["keys"].to_numpy()), int(tile["dim"].iat[0])
        code = codes[:, int(tile["tab"].iat[0]) * codes.shape[1] // keys.shape[1]]
        bits = np.bitwise_count(code[:, None] ^ code[None, :])
        most = radius[dim] if dim in radius else code_radius(min(BITS, dim), threshold, [])
        i, j = np.nonzero(np.triu(bits <= most, 1))
        first = _first_meeting(keys, int(tile["tab"].iat[0]), i, j)
        return i[first], j[first]

    def retrieve(tile: pd.DataFrame) -> pd.DataFrame | None:
        i, j = pairs_of(tile, near_codes)
        return tile.iloc[np.unique(np.concatenate([i, j]))][["rid", *place]] if len(i) else None

    found = each_group(tiles, [*place, "ti", "tj"], retrieve, "rid long, label string, dim int, tab int, key long").distinct()
    found = saved(found, "retrieved")

    # rerank: cosine of the original vectors
    n = found.groupBy(*place).agg(F.count("*").alias("n"))
    full = found.join(n, place).join(reps.select("rid", "size", "x"), "rid").join(codes.select("rid", "keys"), "rid")

    def close(tile: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack(tile["x"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        first = _first_meeting(np.stack(tile["keys"].to_numpy()), int(tile["tab"].iat[0]), i, j)
        return i[first], j[first]

    links = saved(each_tile(dealt(full, place, F.col("n"), "rid"), place, close), "vector-links")
    counts = links.where(F.col("b").isNull()).groupBy(F.col("a").alias("rid")).agg(F.sum("w").alias("links"))
    parts = connected_components(links.where(F.col("b").isNotNull()))
    named = reps.select("rid", "k1", "k2", "size", "min_id").join(parts.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    names = named.groupBy("component").agg(F.min("min_id").alias("name"))
    sets = named.join(names, "component").join(counts, "rid", "left").select("k1", "k2", F.lit(True).alias("ok"), "size", F.coalesce("links", F.lit(0)).alias("links"), "name")
    out = every.select("vec_id", "k1", "k2", "ok").join(saved(sets, "vector-sets"), ["k1", "k2", "ok"], "left")
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("name", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("name", "vec_id")).alias("kept"),
    )
