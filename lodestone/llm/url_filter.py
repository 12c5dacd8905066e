"""URL filters over a sorted digest array.

Rules and listed hosts are kept in one flat file: 64-bit xxhash keys in
ascending order, and beside them the stored strings.  The driver writes the
file into the shared folder, Spark ships it to every executor once, and all
Python workers of an executor map the same pages.  A batch of URLs becomes an array of candidate
keys that a vectorised binary search probes; a hit counts only if the stored
string equals the candidate, whatever other strings share its key.  A host's
candidates are its last labels, no more than the longest host of an entry has,
so a host of any length costs the same.

A rule is ``host`` + ``path`` (``example.com/en/7``).  It fits its host and all
subdomains if the URL's path starts with the rule's; the longest fitting rule
wins, then the one with the longer host.  Where none fits, the list of hosts
decides: listed hosts and their subdomains are blocked, others allowed.

Defined results: a URL that is null or lacks ``://`` has an empty host and path
and is allowed; repeated rows stay; an empty table gives an empty result; other
columns of the input are carried on untouched by ``judge_urls``, whose own
column gets underscores where the input has one of that name.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

ALLOW, BLOCK, LISTED = 1, 2, 3
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_REST = re.compile(r"([^/?#]*)([^?#]*)")
RESULT = "host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    host, path = _REST.match(url, at + 3).groups()
    return host.translate(_LOWER), path


def key_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def digest_bytes(entries: list[tuple[str, int]], key=key_of) -> bytes:
    """Sorted keys, string offsets, actions and strings, after a header: number of entries, of path lengths, most labels of a host."""
    strings = [s.encode("utf-8", "surrogatepass") for s, _ in entries]
    keys = np.array([key(s) for s, _ in entries], dtype=np.uint64)
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum([len(strings[i]) for i in order], dtype=np.uint64)
    lengths = np.array(sorted({len(s) - s.find("/") for s, a in entries if a != LISTED}), dtype=np.uint64)
    labels = max((1 + s.split("/", 1)[0].count(".") for s, _ in entries), default=0)
    head = np.array([len(entries), len(lengths), labels], dtype=np.uint64)
    return b"".join([head.tobytes(), lengths.tobytes(), keys[order].tobytes(), ends.tobytes(), bytes(entries[i][1] for i in order), *[strings[i] for i in order]])


def write_digest_file(entries: list[tuple[str, int]], path: str, key=key_of) -> None:
    with open(path, "wb") as f:
        f.write(digest_bytes(entries, key))


class DigestFile:
    """A mapped digest file."""

    def __init__(self, path: str, key=key_of):
        self.key = key
        n, m, labels = np.fromfile(path, dtype=np.uint64, count=3).astype(int)
        self.most_labels = int(labels)
        self.path_lengths = np.fromfile(path, dtype=np.uint64, count=m, offset=24).astype(int).tolist()
        at = 24 + 8 * m
        self.keys = np.memmap(path, np.uint64, "r", at, (n,)) if n else np.empty(0, np.uint64)
        self.ends = np.memmap(path, np.uint64, "r", at + 8 * n, (n,)) if n else np.empty(0, np.uint64)
        self.actions = np.memmap(path, np.uint8, "r", at + 16 * n, (n,)) if n else np.empty(0, np.uint8)
        self.strings = np.memmap(path, np.uint8, "r", at + 17 * n) if os.path.getsize(path) > at + 17 * n else np.empty(0, np.uint8)

    def string(self, i: int) -> str:
        begin = int(self.ends[i - 1]) if i else 0
        return bytes(self.strings[begin : int(self.ends[i])]).decode("utf-8", "surrogatepass")

    def find(self, texts: list[str], actions: tuple[int, ...]) -> np.ndarray:
        """The index of the entry equal to each text and with one of the actions, else -1."""
        probes = np.fromiter((self.key(x) for x in texts), np.uint64, len(texts))
        low = np.searchsorted(self.keys, probes, "left")
        high = np.searchsorted(self.keys, probes, "right")
        out = np.full(len(texts), -1, np.int64)
        for j in np.flatnonzero(high > low):
            for i in range(low[j], high[j]):
                if self.actions[i] in actions and self.string(i) == texts[j]:
                    out[j] = i
                    break
        return out


def _judge(index: DigestFile, urls: list[str | None]) -> pd.DataFrame:
    parts = [split_url(u) for u in urls]
    suffixes = {}
    for host in {h for h, _ in parts}:
        labels = host.rsplit(".", index.most_labels)[-index.most_labels :] if host and index.most_labels else []
        suffixes[host] = [".".join(labels[i:]) for i in range(len(labels))]
    # each distinct candidate is hashed and probed once a batch
    wanted: dict[str, int] = {}
    per_url: list[list[tuple[int, int, int]]] = []
    for host, path in parts:
        mine = []
        for s in suffixes[host]:
            for n in index.path_lengths:
                if n <= len(path):
                    mine.append((len(s) + n, len(s), wanted.setdefault(s + path[:n], len(wanted))))
        per_url.append(sorted(mine, reverse=True))
    hosts = {s: i for i, s in enumerate(sorted({s for x in suffixes.values() for s in x}))}
    found, texts = index.find(list(wanted), (ALLOW, BLOCK)), list(wanted)
    listed = index.find(list(hosts), (LISTED,)) >= 0
    rules, verdicts = [], []
    for (host, _), mine in zip(parts, per_url, strict=True):
        hit = next((k for _, _, k in mine if found[k] >= 0), None)
        if hit is not None:
            rules.append(texts[hit])
            verdicts.append("allow" if index.actions[found[hit]] == ALLOW else "block")
        else:
            rules.append(None)
            verdicts.append("block" if any(listed[hosts[s]] for s in suffixes[host]) else "allow")
    return pd.DataFrame({"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": pd.Series(rules, dtype=object), "verdict": verdicts})


def ship_digest_file(spark: SparkSession, entries: list[tuple[str, int]]) -> str:
    """Write the digest file and give it to all executors; returns its name among Spark's files."""
    entries = sorted(set(entries))
    name = "urls-" + hashlib.sha256(repr(entries).encode()).hexdigest()[:24] + ".digests"
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestone/{sc.applicationId}/{name}")
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not store.exists(path):
        out = store.create(path)
        out.write(bytearray(digest_bytes(entries)))
        out.close()
    sc.addFile(store.makeQualified(path).toString())
    return name


def judge_urls(df: DataFrame, rules: list[tuple[str, str]], listed_hosts: tuple[str, ...] = (), url: str = "url", out: str = "judged") -> DataFrame:
    """``df`` with one more column, a struct of host, path, rule and verdict, named ``out``.

    ``rules`` are (``host/path``, ``allow`` or ``block``).  No shuffle.
    """
    entries = [(r, {"allow": ALLOW, "block": BLOCK}[a]) for r, a in rules] + [(h, LISTED) for h in listed_hosts]
    if any("/" not in r for r, _ in rules):
        raise ValueError("a rule is a host and a path that begins with /")
    name = ship_digest_file(df.sparkSession, entries)

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = DigestFile(SparkFiles.get(name))
        for urls in batches:
            yield _judge(index, [None if u is None or u != u else u for u in urls])

    while out.lower() in [c.lower() for c in df.columns]:
        out += "_"
    return df.withColumn(out, judge(F.col(f"`{url}`")))
