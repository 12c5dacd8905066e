"""SentencePiece encoding and decoding of documents of any length.

The segmentation is the best path over a vocabulary's pieces and scores, as in
a unigram model.  A text longer than ``CHUNK`` is cut into chunks.  A piece that
crosses a cut ends up to ``M - 1`` characters behind it, so the state at a cut
is that number, and what a chunk does to the scores of the states is a matrix
over (max, +).  The matrices of each block of ``BLOCK`` chunks are multiplied in
a task of their own, the products are scanned document by document, and each
block then scans its own chunks: the scores at every cut.  Each chunk finds, by
itself, which state it is entered in for each state it is left in; those maps
are composed by the same scan from the end, and each chunk is backtraced, by
itself, between its two states.  The ids are those of one pass over the whole
text, ties included.

Pieces hold the blank mark only in front (or are runs of it), so a blank after
another character is a place that every path passes.  Words between such places
are solved once, when the chunk's matrix is made; what is left of such a chunk
for the later steps is the text at its ends.

Such words are solved by the ``tokenizers`` library's best path over the same
pieces, scores and rule for ties; those with characters outside the vocabulary,
which become byte pieces, and all other stretches are solved here.

Defined results: a null or empty text has no ids; repeated rows stay; an empty
table gives an empty result; other columns are ignored.  Decoding gives back the text, with U+2581
read as a blank, as the library does.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import tokenizer_path

MARK, CHUNK, BLOCK = "▁", 32_768, 256
CACHE_WORDS, CACHE_CHARS = 350_000, 48  # words that a worker remembers (of late, and before), and the longest that it does
NONE = -np.inf


class Pieces:
    """A vocabulary's pieces and scores."""

    def __init__(self, path: str):
        import sentencepiece
        from tokenizers import Tokenizer, models

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): float(model.get_score(i)) for i in plain}
        self.id = {model.id_to_piece(i): i for i in plain}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.text = [model.id_to_piece(i) for i in range(n)]
        #: What each id stands for.
        self.bytes = [t.encode() for t in self.text]
        for byte, i in self.byte.items():
            self.bytes[i] = bytes([byte])
        for i in filter(model.is_control, range(n)):
            self.bytes[i] = b""
        self.longest = max(map(len, self.score))
        #: Each beginning of a piece, with the piece's score if it is one.
        self.prefixes: dict[str, float | None] = {p[:k]: None for p in self.score for k in range(1, len(p))} | self.score
        self.unknown = min(self.score.values()) - 10
        if any(MARK in p[1:] and p.strip(MARK) for p in self.score):
            raise ValueError("a piece holds the blank mark inside")
        #: By id; of a character's byte pieces the first has its score.
        self.points = np.array([self.score.get(t, 0.0) for t in self.text])
        for byte, i in self.byte.items():
            self.points[i] = 0.0 if 0x80 <= byte < 0xC0 else self.unknown
        # best paths of words by a library: the same pieces, scores and ids; others' places hold what no word is
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.strange = next(i for i in range(n) if self.id.get(self.text[i]) != i)
        named = [(t, self.score[t]) if self.id.get(t) == i else (f"\0{i}", 0.0) for i, t in enumerate(self.text)]
        self.library = Tokenizer(models.Unigram(named, self.strange, False))
        self.foreign = re.compile("([^" + "".join(map(re.escape, sorted(set("".join(self.score))))) + "])")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was learned before the cache was last full

    def forward(self, text: str, entry: dict[int, float], upto: int) -> tuple[list[float], list[int]]:
        """Best scores and the starts of last pieces (-1: an entry) of paths that take pieces starting before ``upto``.

        A character outside the vocabulary is an unknown piece; of equal paths
        the one whose last piece starts first stays.
        """
        n, get = len(text), self.prefixes.get
        best, back = [NONE] * (n + 1), [-1] * (n + 1)
        for at, s in entry.items():
            if at <= n:
                best[at] = s
        for at in range(min(upto, n)):
            b = best[at]
            if b == NONE:
                continue
            known = False
            for end in range(at + 1, min(n, at + self.longest) + 1):
                s = get(text[at:end], False)
                if s is False:
                    break
                if s is not None:
                    known = known or end == at + 1
                    if b + s > best[end]:
                        best[end], back[end] = b + s, at
            if not known and b + self.unknown > best[at + 1]:
                best[at + 1], back[at + 1] = b + self.unknown, at
        return best, back

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        return [i] if i is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def path(self, text: str, back: list[int], at: int) -> tuple[int, list[int]]:
        """Where the path to ``at`` entered, and its ids."""
        parts = []
        while back[at] >= 0:
            parts.append(text[back[at] : at])
            at = back[at]
        return at, [i for p in reversed(parts) for i in self.ids_of(p)]

    def word(self, text: str) -> bytes:
        """The ids of a word, as little-endian unsigned 32-bit numbers."""
        _, back = self.forward(text, {0: 0.0}, len(text))
        return array("I", self.path(text, back, len(text))[1]).tobytes()

    def _by_parts(self, text: str) -> bytes:
        """The ids of a word cut at characters that no piece holds, as every path passes there."""
        out = []
        for part in filter(None, self.foreign.split(text)):
            ids = self.words.get(part)
            if ids is None:
                ids = self.word(part)
                if len(part) <= CACHE_CHARS:
                    self.words[part] = ids
            out.append(ids)
        return b"".join(out)

    def _learned(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that aren't in ``words``: remembered from before, or by the library, or where a character is unknown by ``word``."""
        made = {w: self.older[w] for w in words if w in self.older}
        asked = [w for w in words if w not in made]
        for w, e in zip(asked, self.library.encode_batch_fast(asked, add_special_tokens=False), strict=True):
            ids = e.ids
            made[w] = self._by_parts(w) if self.strange in ids or "\0" in w else array("I", ids).tobytes()
        if len(self.words) + len(made) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        self.words.update((w, ids) for w, ids in made.items() if len(w) <= CACHE_CHARS)
        return made

    def ids(self, text: str) -> bytes:
        """The ids of a text that begins and ends where every path passes."""
        words = cut_words(text)
        parts = list(map(self.words.get, words))
        if None in parts:
            made = self._learned({w for w, p in zip(words, parts, strict=True) if p is None})
            parts = [made[w] if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)


def cut_words(text: str) -> list[str]:
    """Words, each with its blank marks in front but the last of a run alone in its word's: cut where every path passes."""
    parts = text.split(MARK)
    out, run = [parts[0]] if parts[0] else [], ""
    for p in parts[1:]:
        run += MARK
        if p:
            out.append(run + p)
            run = ""
    return out + [run] if run else out


def normal(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


@lru_cache(maxsize=2)
def shared_pieces(path: str) -> Pieces:
    """One vocabulary a worker process."""
    return Pieces(path)


def encode(pieces: Pieces, text: str) -> bytes:
    """Ids of a whole text, as little-endian unsigned 32-bit numbers."""
    return pieces.ids(normal(text))


def decode(pieces: Pieces, ids: bytes) -> str:
    """The text of ids, without the blank that encoding puts in front."""
    whole = _spelled(pieces, ids).decode("utf-8", "replace").replace(MARK, " ")
    return whole[1:] if whole.startswith(" ") else whole


def _spelled(pieces: Pieces, ids: bytes) -> bytes:
    return b"".join(map(pieces.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _passes(pieces: Pieces, text: str, n: int) -> tuple[int, int] | None:
    """The first and last place of a chunk of ``n`` characters that every path passes: a blank mark after another character.

    The first lies behind all states in which the chunk can be entered.
    """
    at = text.find(MARK, pieces.longest - 1)
    while 0 < at < n and text[at - 1] == MARK:
        at = text.find(MARK, at + 1)
    if not 0 < at < n:
        return None
    last = text.rfind(MARK, at, n)
    while last > at and text[last - 1] == MARK:
        last = text.rfind(MARK, at, last)
    return at, last


class Solved:
    """A chunk of ``n`` characters: its text up to the first passed place, the ids to the last one, and its text from there.

    A chunk without such places is all ``head``.
    """

    def __init__(self, n: int, head: str, ids: bytes | None, tail: str | None):
        self.n, self.head, self.ids, self.tail = n, head, ids, tail

    @staticmethod
    def of(pieces: Pieces, text: str, n: int) -> Solved:
        places = _passes(pieces, text, n)
        if places is None:
            return Solved(n, text, None, None)
        first, last = places
        return Solved(n, text[:first], pieces.ids(text[first:last]), text[last:])

    def transfer(self, pieces: Pieces, tail_end: int) -> np.ndarray:
        """From each entry state to each exit state."""
        m = pieces.longest
        out = np.full((m, m), NONE)

        def ends(text: str, entry: int, upto: int) -> list[float]:
            best, _ = pieces.forward(text, {entry: 0.0}, upto)
            return (best[upto : upto + m] + [NONE] * m)[:m]

        if self.ids is None:
            for o in range(min(m, self.n + 1)):
                out[o] = ends(self.head, o, self.n)
        else:
            middle = pieces.points[np.frombuffer(self.ids, "<u4")].sum()
            tail = np.array(ends(self.tail, 0, tail_end))
            for o in range(m):
                best, _ = pieces.forward(self.head, {o: 0.0}, len(self.head))
                out[o] = best[len(self.head)] + middle + tail
        return out

    def way_back(self, pieces: Pieces, entry: np.ndarray) -> list[int]:
        """For each exit state, the state in which its best path enters."""
        upto = self.n if self.ids is None else len(self.head)
        best, back = pieces.forward(self.head, _states(entry), upto)
        if self.ids is not None:
            return [pieces.path(self.head, back, upto)[0]] * pieces.longest
        return [pieces.path(self.head, back, upto + o)[0] if upto + o < len(best) and best[upto + o] != NONE else 0 for o in range(pieces.longest)]

    def part(self, pieces: Pieces, entry: np.ndarray, leave: int, tail_end: int) -> bytes:
        """The ids of the chunk's part of the best path, between its entry and its exit state."""
        upto = self.n if self.ids is None else len(self.head)
        _, back = pieces.forward(self.head, _states(entry), upto)
        if self.ids is None:
            return array("I", pieces.path(self.head, back, upto + leave)[1]).tobytes()
        head = array("I", pieces.path(self.head, back, upto)[1]).tobytes()
        _, back = pieces.forward(self.tail, {0: 0.0}, tail_end)
        return head + self.ids + array("I", pieces.path(self.tail, back, tail_end + leave)[1]).tobytes()


def _states(entry: np.ndarray) -> dict[int, float]:
    return {o: float(s) for o, s in enumerate(entry) if s != NONE}


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two chunks' matrices one after the other; also scores of states, and a matrix."""
    return (a[..., :, None] + b).max(axis=-2)


def follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two maps from exit to entry state one after the other, the later chunk's first; also a state, and a map."""
    return b[a]


def tree_scan(rows: DataFrame, step: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, load: Callable[[bytes], np.ndarray], backward: bool = False) -> DataFrame:
    """``uid, k, state``: the state before each element ``e`` of ``uid``, in the order of ``k`` or against it.

    ``step`` is associative.  Products of blocks, a scan of the products, a scan
    in each block: a task holds one element and one state at a time.
    """
    shape, kind = start.shape, start.dtype

    def order(*names: str) -> list:
        return [F.col(n).desc() if backward and n != "uid" else F.col(n) for n in names]

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, acc = None, None
        for rows in batches:
            out = []
            for uid, block, e in zip(rows["uid"].tolist(), rows["block"].tolist(), rows["e"], strict=True):
                if (uid, block) != key:
                    if key is not None:
                        out.append((*key, acc.tobytes()))
                    key, acc = (uid, block), load(e)
                else:
                    acc = step(acc, load(e))
            yield pd.DataFrame(out, columns=["uid", "block", "e"])
        if key is not None:
            yield pd.DataFrame([(*key, acc.tobytes())], columns=["uid", "block", "e"])

    def states(place: str, by: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, state = None, None
            for rows in batches:
                out = []
                for i, at in enumerate(zip(*[rows[c].tolist() for c in by], strict=True)):
                    if at != key:
                        key = at
                        state = np.frombuffer(rows["s"].iat[i], kind).reshape(shape) if "s" in rows else start
                    out.append((rows["uid"].iat[i], rows[place].iat[i], state.tobytes()))
                    state = step(state, load(rows["e"].iat[i]))
                yield pd.DataFrame(out, columns=["uid", place, "state"])

        return run

    rows = rows.select("uid", "k", F.floor(F.col("k") / BLOCK).cast("long").alias("block"), "e")
    blocks = rows.repartition("uid", "block").sortWithinPartitions(*order("uid", "block", "k")).mapInPandas(products, "uid long, block long, e binary")
    begin = blocks.repartition("uid").sortWithinPartitions(*order("uid", "block")).mapInPandas(states("block", ["uid"]), "uid long, block long, state binary")
    inside = rows.join(begin.withColumnRenamed("state", "s"), ["uid", "block"]).repartition("uid", "block").sortWithinPartitions(*order("uid", "block", "k"))
    return inside.mapInPandas(states("k", ["uid", "block"]), "uid long, k long, state binary")


PARTS = "uid long, k long, doc_id long, n int, ids binary, same boolean"


def _giant_parts(rows: DataFrame, path: str, chunk: int) -> DataFrame:
    """The ids of each chunk of the texts of ``doc_id, text``, and whether they decode to the chunk's part of the text."""
    m = shared_pieces(path).longest

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uid, doc, text in zip(b["uid"], b["doc_id"].astype("Int64"), b["text"], strict=True):
                t = normal(text)
                for k, at in enumerate(range(0, len(t), chunk)):
                    yield pd.DataFrame({"uid": [uid], "doc_id": pd.array([doc], "Int64"), "k": [k], "n": [min(chunk, len(t) - at)], "chunk": [t[at : at + chunk + m]]})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = shared_pieces(path)
        for b in batches:
            for x in b.itertuples(index=False):
                c = Solved.of(pieces, x.chunk, x.n)
                last = len(x.chunk) - len(c.tail or "")
                same = c.ids is None or _spelled(pieces, c.ids).decode("utf-8", "replace") == x.chunk[len(c.head) : last]
                e = c.transfer(pieces, x.n - last).tobytes()
                row = {"uid": x.uid, "doc_id": x.doc_id, "k": x.k, "n": x.n, "head": c.head, "ids": c.ids, "tail": c.tail, "tail_end": x.n - last, "same": same, "e": e}
                yield pd.DataFrame([row]).astype({"doc_id": "Int64"})

    named = rows.withColumn("uid", F.monotonically_increasing_id())
    chunks = named.mapInPandas(cut, "uid long, doc_id long, k long, n int, chunk string").repartition("uid", "k")
    solved = saved(chunks.mapInPandas(solve, "uid long, doc_id long, k long, n int, head string, ids binary, tail string, tail_end int, same boolean, e binary"), "chunks")
    first = np.full(m, NONE)
    first[0] = 0.0
    entry = tree_scan(solved, combine, first, lambda e: np.frombuffer(e).reshape(m, m)).withColumnRenamed("state", "entry")

    def rebuilt(b: pd.DataFrame) -> Iterator[tuple]:
        for x in b.itertuples(index=False):
            yield x, Solved(x.n, x.head, x.ids, x.tail), np.frombuffer(x.entry)

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = shared_pieces(path)
        for b in batches:
            yield pd.DataFrame({"uid": b["uid"], "k": b["k"], "entry": b["entry"], "e": [np.array(c.way_back(pieces, e), np.int64).tobytes() for _, c, e in rebuilt(b)]})

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = shared_pieces(path)
        for b in batches:
            out = []
            for x, c, e in rebuilt(b):
                leave = int(np.frombuffer(x.leave, np.int64)[0])
                ids = c.part(pieces, e, leave, x.tail_end)
                begin, spelled = int(np.frombuffer(x.way, np.int64)[leave]), _spelled(pieces, ids).decode("utf-8", "replace")
                end = x.n + leave if c.ids is None else x.tail_end + leave
                same = spelled == c.head[begin:end] if c.ids is None else x.same and spelled.startswith(c.head[begin:]) and spelled.endswith(c.tail[:end])
                out.append((x.uid, x.k, x.doc_id, x.n, ids, same and len(spelled) == x.n + leave - begin))
            made = pd.DataFrame(out, columns=["uid", "k", "doc_id", "n", "ids", "same"])
            yield made.astype({"doc_id": "Int64"})

    back = saved(solved.drop("e").join(entry, ["uid", "k"]).select("uid", "k", "n", "head", "ids", "tail", "entry").mapInPandas(ways, "uid long, k long, entry binary, e binary"), "ways")
    leave = tree_scan(back, follow, np.zeros(1, np.int64), lambda e: np.frombuffer(e, np.int64), backward=True).withColumnRenamed("state", "leave")
    known = back.withColumnRenamed("e", "way").join(leave, ["uid", "k"])
    return solved.drop("e").join(known, ["uid", "k"]).mapInPandas(trace, PARTS)


def _split(docs: DataFrame, path: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text`` of the documents that are solved whole, and of those that are cut."""
    if chunk < shared_pieces(path).longest:
        raise ValueError("a chunk must hold the longest piece")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where(F.length("text") <= chunk), rows.where(F.length("text") > chunk)


def _joined(parts: DataFrame, whole: Callable[[pd.DataFrame], tuple], begin: tuple, row: Callable[[object, tuple], tuple], schema: str, columns: list[str]) -> DataFrame:
    """One row a text from its parts in order; a task holds what has been gathered of one text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid, doc, acc = None, None, begin
        for b in batches:
            out = []
            for x in b.astype({"doc_id": "Int64"}).itertuples(index=False):
                if x.uid != uid:
                    if uid is not None:
                        out.append(row(doc, acc))
                    uid, doc, acc = x.uid, x.doc_id, begin
                acc = whole(acc, x)
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})
        if uid is not None:
            yield pd.DataFrame([row(doc, acc)], columns=columns).astype({"doc_id": "Int64"})

    return parts.repartition("uid").sortWithinPartitions("uid", "k").mapInPandas(run, schema)


def encode_documents(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) of every document; texts longer than ``chunk`` by chunks."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    small, giant = _split(docs, path, chunk)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = shared_pieces(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "ids": [encode(pieces, t) for t in b["text"]]})

    schema = "doc_id long, ids binary"
    parts = _giant_parts(giant, path, chunk)
    joined = _joined(parts, lambda acc, x: (*acc, x.ids), (), lambda doc, acc: (doc, b"".join(acc)), schema, ["doc_id", "ids"])
    return saved(small.mapInPandas(whole, schema).unionByName(joined), "codec")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = shared_pieces(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "text": [decode(pieces, i) for i in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(texts, "doc_id long, text string")


def _crc_times(a: int, b: int) -> int:
    """Product of two residues modulo the CRC-32 polynomial, bits in the order of the checksum."""
    out = 0
    for _ in range(32):
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_joined(a: int, b: int, n: int) -> int:
    """The CRC-32 of two byte strings one after the other; the second has ``n`` bytes."""
    shift, power, n = 0x80000000, 0x40000000, 8 * n  # x ** 0, x ** 1
    while n:
        if n & 1:
            shift = _crc_times(shift, power)
        power, n = _crc_times(power, power), n >> 1
    return _crc_times(a, shift) ^ b


def codec_report(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_chars, n_ids, ids_crc32, same``: every document encoded and decoded, and whether that gives back its text.

    No text and no ids of a giant document are gathered: checksums of its
    chunks' ids are joined.
    """
    path = path or tokenizer_path("piece_bpe_32k.model")
    schema, columns = "doc_id long, n_chars long, n_ids long, ids_crc32 long, same boolean", ["doc_id", "n_chars", "n_ids", "ids_crc32", "same"]
    small, giant = _split(docs, path, chunk)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = shared_pieces(path)
        for b in batches:
            out = []
            for doc, t in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                ids = encode(pieces, t)
                out.append((doc, len(t), len(ids) // 4, zlib.crc32(ids), decode(pieces, ids) == t.replace(MARK, " ")))
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"uid": b["uid"], "k": b["k"], "doc_id": b["doc_id"].astype("Int64"), "n": b["n"], "n_ids": [len(i) // 4 for i in b["ids"]], "crc": [zlib.crc32(i) for i in b["ids"]], "same": b["same"]})

    parts = _giant_parts(giant, path, chunk).mapInPandas(digest, "uid long, k long, doc_id long, n int, n_ids long, crc long, same boolean")
    add = lambda acc, x: (acc[0] + x.n, acc[1] + x.n_ids, crc_joined(acc[2], x.crc, 4 * x.n_ids), acc[3] and x.same)
    # the mark in front is no character of the text
    joined = _joined(parts, add, (-1, 0, 0, True), lambda doc, acc: (doc, *acc), schema, columns)
    return saved(small.mapInPandas(whole, schema).unionByName(joined), "codec")
