"""Readers, writers, artifacts and lineage of tables."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import parity
from ..operators.expect import ExpectationError
from .extractions import EXTRACTIONS


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def require_inputs(spark: SparkSession, *paths: str) -> None:
    """All inputs exist and aren't empty."""
    bad = []
    for path in paths:
        fs, p = _fs(spark, path)
        if not fs.exists(p) or fs.getContentSummary(p).getLength() == 0:
            bad.append(path)
    if bad:
        raise FileNotFoundError(f"missing or empty inputs: {bad}")


def read_jdbc(spark: SparkSession, url: str, query: str, user: str | None = None, password: str | None = None, driver: str | None = None, **options: str) -> DataFrame:
    """A query of a database; its filters and projections run there.  Names come in lower case."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in {"user": user, "password": password, "driver": driver, **options}.items():
        reader = reader.option(k, v) if v is not None else reader
    df = reader.load()
    return df.toDF(*[c.lower() for c in df.columns])


def extraction_query(table: str, columns: Sequence[str], where: dict[str, str] | None = None, order: str | Sequence[str] = ()) -> str:
    """Projection and equality filters over one view."""
    order = [order] if isinstance(order, str) else list(order or ())
    for name in (table, *columns, *(where or {}), *order):
        if not re.fullmatch(r"[A-Za-z_][\w.$]*", name):
            raise ValueError(f"not a name: {name}")
    cond = " AND ".join(f"{k} = '{v.replace(chr(39), chr(39) * 2)}'" for k, v in (where or {}).items())
    return f"SELECT {', '.join(columns) or '*'} FROM {table}" + (f" WHERE {cond}" if cond else "") + (f" ORDER BY {', '.join(order)}" if order else "")


def extract(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """One of the declared extractions, read from a database."""
    return read_jdbc(spark, url, extraction_query(*EXTRACTIONS[name]), **options)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where_in: tuple[str, Sequence] | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Parquet or CSV by suffix; the projection and the IN filter reach the scan."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("xls", "xlsx", "pkl", "pickle"):
        raise ValueError(f"{kind} files aren't read")
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)
    if where_in:
        df = df.where(F.col(where_in[0]).isin(*where_in[1]))
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, metadata: dict | None = None, partition_by: Sequence[str] = ()) -> None:
    """Write beside the target and rename: readers see all or nothing, and nothing is overwritten."""
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.incomplete"
    fs, s = _fs(spark, staging)
    fs.delete(s, True)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    if metadata is not None:
        write_json(spark, f"{staging}/_lineage.json", metadata)
    jvm = spark.sparkContext._jvm
    if not fs.rename(s, jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"can't publish {path}")


def write_json(spark: SparkSession, path: str, value) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str):
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_metadata(spark: SparkSession, path: str) -> dict:
    return read_json(spark, f"{path.rstrip('/')}/_lineage.json")


def add_columns(df: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``extra``, those of equal name replaced, by key."""
    new = [c for c in extra.columns if c not in keys]
    return df.drop(*new).join(extra.select(*keys, *new), list(keys), "left").select(*[c for c in df.columns if c not in new], *new)


def verify_written(spark: SparkSession, path: str, expected: DataFrame) -> None:
    """The files hold the expected columns, types and rows."""
    got = spark.read.parquet(path)
    if diff := parity.schema_difference(got, expected):
        raise ExpectationError(f"{path}: columns or types differ: {diff}")
    if got.columns != expected.columns:
        raise ExpectationError(f"{path}: the order of the columns differs")
    if parity.fingerprint(got).first() != parity.fingerprint(expected).first():
        raise ExpectationError(f"{path}: rows differ")


def save_state(state: DataFrame, path: str, version: str, params: dict) -> None:
    """A fitted state as Parquet by level, with a manifest."""
    write_table(state, path, {"version": version, "params": params, "columns": state.columns}, ["level"])


def load_state(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, dict]:
    meta = read_metadata(spark, path)
    if meta["version"] != version:
        raise ValueError(f"{path} has version {meta['version']}, not {version}")
    state = spark.read.parquet(path).select(*meta["columns"])
    if state.groupBy("level", "key").count().where("count > 1").limit(1).count():
        raise ExpectationError(f"{path}: keys repeat")
    return state, meta["params"]


def save_neighbors(points: DataFrame, path: str, version: str, route: Sequence[str], value: str, k: int) -> None:
    """The points of a neighbour search, and how it is asked."""
    write_table(points, path, {"version": version, "params": {"route": list(route), "value": value, "k": k}, "columns": points.columns})


def load_neighbors(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, dict]:
    return _versioned(spark, path, version)


def _versioned(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, dict]:
    meta = read_metadata(spark, path)
    if meta["version"] != version:
        raise ValueError(f"{path} has version {meta['version']}, not {version}")
    return spark.read.parquet(path).select(*meta["columns"]), meta["params"]


def save_scale(scale: DataFrame, path: str, version: str, source: str) -> None:
    """A grade scale or bucket map, with its source and a digest of its rows; at most a few hundred rows."""
    rows = sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in scale.limit(10_000).collect())
    write_table(scale, path, {"version": version, "params": {"source": source, "digest": hashlib.sha256("\n".join(rows).encode()).hexdigest()}, "columns": scale.columns})


def load_scale(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, dict]:
    scale, params = _versioned(spark, path, version)
    rows = sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in scale.limit(10_000).collect())
    if hashlib.sha256("\n".join(rows).encode()).hexdigest() != params["digest"]:
        raise ExpectationError(f"{path}: rows differ from those that were saved")
    return scale, params


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a leaderboard whose columns must stay the same."""
    spark = df.sparkSession
    if exists(spark, path) and (diff := parity.schema_difference(spark.read.parquet(path), df)):
        raise ExpectationError(f"{path}: columns differ: {diff}")
    df.write.mode("append").parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def params_digest(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()


SPLITS, STAGES = ("train", "valid", "test"), ("raw", "clean", "merged", "features", "model")


def table_path(root: str, stage: str, name: str, split: str | None = None, generation: str = "v1") -> str:
    """Where a table lies; stages and splits are a closed list and names stay inside the root."""
    if stage not in STAGES or split is not None and split not in SPLITS:
        raise ValueError(f"unknown stage or split: {stage}, {split}")
    if not re.fullmatch(r"[a-z0-9_]+", name) or not re.fullmatch(r"v\d+", generation):
        raise ValueError(f"not a table name or generation: {name}, {generation}")
    return "/".join([root.rstrip("/"), f"generation={generation}", stage, name, *([f"split={split}"] if split else [])])
