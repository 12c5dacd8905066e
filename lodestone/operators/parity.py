"""Comparing datasets: fingerprints, differences, change summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row that doesn't depend on the order of the rows: count, xor and sum of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(columns or df.columns)])
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))


def portable_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row that any engine can compute: count, and the sum of 60 bits of each row's MD5 over its known values."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("total"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with ``side``."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.columns == b.columns and not multiset_difference(a, b).limit(1).count()


def change_summary(df: DataFrame, pairs: dict[str, tuple[str, str]], tolerance: float = 1e-12) -> DataFrame:
    """Per column: rows equal, changed, gained and lost between an old and a new version."""

    def one(name: str, old: str, new: str) -> Column:
        o, n = F.col(old), F.col(new)
        both = o.isNotNull() & n.isNotNull()
        close = F.abs(o - n) <= tolerance
        return F.struct(F.lit(name).alias("column_name"), F.count_if(both & close | o.isNull() & n.isNull()).alias("equal_rows"), F.count_if(both & ~close).alias("changed"), F.count_if(o.isNull() & n.isNotNull()).alias("gained"), F.count_if(o.isNotNull() & n.isNull()).alias("lost"))

    cells = [one(k, *v) for k, v in pairs.items()]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def material(n_changed: Column, n_rows: Column, floor: int = 1000, share: float = 0.01) -> Column:
    """Whether a change passes the gate of ``floor`` rows or a share of all."""
    return n_changed >= F.greatest(F.lit(floor), F.ceil(n_rows * share))


def schema_difference(a: DataFrame, b: DataFrame) -> list[tuple[str, str | None, str | None]]:
    x, y = dict(a.dtypes), dict(b.dtypes)
    return [(c, x.get(c), y.get(c)) for c in sorted({*x, *y}) if x.get(c) != y.get(c)]
