"""Token counts of documents in flat token files, by a scan for separators.

A token file is a stream of fixed-width ids in which a separator ends each
document; it has no index.  It is read in blocks: each block's separators are
found by one vectorised comparison, and a prefix scan over the blocks of a file
(running sums and maxima of a window) tells each block how many documents ended
before it and where the last one did, so documents that run over any number of
blocks are stitched without reading a block twice.

Defined results: a null text is empty and counts 0; tokens after a file's last
separator are an unfinished document, reported with ``ended`` false; repeated
rows count each; a document's strings of special tokens are ordinary text, so a
separator is only ever the file's own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved
from .tokens import shared_ids, tokenizer_path

SEPARATOR, DTYPE, BLOCK_IDS = 49_407, "<u2", 1 << 17
STREAM = "file string, block long, data binary, ordinal long, doc_id long"


def token_stream(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR, dtype: str = DTYPE, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One token file a task, as rows of blocks, and rows that name the documents of each file in order."""
    path = path or tokenizer_path("word_bpe_49k.json")
    width = np.dtype(dtype).itemsize

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, file = shared_ids(path, False), f"tokens-{TaskContext.get().partitionId():06d}"
        end = np.array([separator], dtype).tobytes()
        held, block, ordinal = bytearray(), 0, 0

        def blocks(all_of_it: bool) -> list[tuple]:
            nonlocal block, held
            out, at, step = [], 0, width * block_ids
            while len(held) - at >= step or all_of_it and at < len(held):
                out.append((file, block, bytes(held[at : at + step]), None, None))
                block, at = block + 1, at + step
            del held[:at]
            return out

        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                coded = np.frombuffer(ids.one(text if isinstance(text, str) else ""), "<u4")
                held += coded.astype(dtype).tobytes()
                held += end
                rows.append((file, None, None, ordinal, doc))
                ordinal += 1
                rows += blocks(False)
            yield _stream(rows)
        if held:
            yield _stream(blocks(True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInPandas(write, STREAM)


def _stream(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["file", "block", "data", "ordinal", "doc_id"])
    return out.astype({"block": "Int64", "ordinal": "Int64", "doc_id": "Int64"})


def read_token_files(spark: SparkSession, path: str, dtype: str = DTYPE, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``file, block, data`` of flat binary files of any size; a folder's files, or those of a pattern.

    Spark lists names and sizes only; each block is read by itself, as a range
    of bytes, through ``pyarrow.fs`` (local or shared folders, HDFS, object
    stores).  Bytes behind a file's last whole id raise.
    """
    width = np.dtype(dtype).itemsize
    step = width * block_ids

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        name, opened = None, None
        for b in batches:
            for file, block, length in zip(b["file"], b["block"].tolist(), b["length"].tolist(), strict=True):
                if length % width:
                    raise ValueError(f"{file} ends within an id")
                if file != name:
                    if opened is not None:
                        opened.close()
                    store, inside = fs.FileSystem.from_uri(file if "://" in file else file.replace(":/", ":///", 1))
                    name, opened = file, store.open_input_file(inside)
                data = opened.read_at(min(step, length - block * step), block * step)
                yield pd.DataFrame({"file": [file], "block": [block], "data": [data]})
        if opened is not None:
            opened.close()

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    last = F.floor((F.col("length") - 1) / step).cast("long")
    blocks = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return blocks.repartition("file", "block").sortWithinPartitions("file", "block").mapInPandas(ranges, "file string, block long, data binary")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """``file, ordinal, n_tokens, ended`` of every document of the files."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [np.frombuffer(d, dtype) for d in b["data"]]
            yield pd.DataFrame({"file": b["file"], "block": b["block"], "n": [len(x) for x in ids], "ends": [np.flatnonzero(x == separator).astype(np.int64) for x in ids]})

    found = saved(blocks.select("file", "block", "data").mapInPandas(scan, "file string, block long, n long, ends array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    here = found.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    here = here.withColumn("last", F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1) + 1))
    here = here.withColumn("done", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("long")).withColumn("open", F.coalesce(F.max("last").over(before), F.lit(0)))
    docs = here.select("file", "start", "done", "open", "ends", F.posexplode("ends").alias("i", "e"))
    began = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("start") + F.get("ends", F.col("i") - 1) + 1)
    whole = docs.select("file", (F.col("done") + F.col("i")).alias("ordinal"), (F.col("start") + F.col("e") - began).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = here.groupBy("file").agg(F.sum("n").alias("n"), F.coalesce(F.max("last"), F.lit(0)).alias("open"), F.sum(F.size("ends")).alias("ordinal")).where("n > open")
    return whole.unionByName(rest.select("file", "ordinal", (F.col("n") - F.col("open")).alias("n_tokens"), F.lit(False).alias("ended")))


def document_token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens``: the documents written to token files, and counted there."""
    stream = saved(token_stream(docs, path), "token-files")
    counted = count_tokens(stream.where("data is not null"))
    names = stream.where("ordinal is not null").select("file", "ordinal", "doc_id")
    return names.join(counted.where("ended"), ["file", "ordinal"]).select("doc_id", "n_tokens")
