"""Token ids of texts, as little-endian bytes, by a public BPE tokenizer with word ends.

The tokenizer merges within words only.  Texts of plain Latin letters, digits
and marks are cut into words here and each distinct word is merged once a
worker, by ``tiktoken`` over the same vocabulary, in which a byte that UTF-8
doesn't use stands for the word end.  Other texts are cut at blanks and line
breaks, and the ids of each distinct piece come from the ``tokenizers``
library, with which the first way is held equal in the tests.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Words, and pieces between blanks, that a worker remembers, and the longest that it does.
CACHE_WORDS, CACHE_CHARS = 100_000, 48
_WORD_END = b"\xff"
#: Letters that have one code point, one lower case and no context: Latin without U+0130.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ňŊ-ž]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ž]+|[0-9]|[^\\sa-z0-9À-ÖØ-öø-ž]+")
_SPECIAL = re.compile(r"<\|(?:startof|endof)text\|>")


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers has a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _word_ranks(path: str) -> dict[bytes, int]:
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters, ranks = _byte_letters(), {}
    for token, i in vocab.items():
        if not _SPECIAL.fullmatch(token):
            word, end = (token[:-4], _WORD_END) if token.endswith("</w>") and len(token) > 4 else (token, b"")
            ranks[bytes(letters[c] for c in word) + end] = i
    return ranks | {_WORD_END: len(vocab)}


class _Cache(dict):
    """Ids of words, learned when first asked for; when full, what was asked for of late stays."""

    def __init__(self, learn):
        super().__init__()
        self.learn, self.older = learn, {}

    def __missing__(self, word: str) -> bytes:
        coded = self.older.get(word)
        if coded is None:
            coded = self.learn(word) if word else b""
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = coded
        return coded

    def forget(self) -> None:
        self.clear()
        self.older = {}


class PieceIds:
    """Ids of texts by a ``tokenizers`` file of the kind above.

    ``special=True`` encodes the strings of special tokens as those tokens, as
    the library does unless told otherwise.
    """

    def __init__(self, path: str, special: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = not special
        merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=_word_ranks(path), special_tokens={})._core_bpe.encode_single_piece
        self.library, self.special = library, special
        self.words = _Cache(lambda word: array("I", merge(word.encode() + _WORD_END)).tobytes())
        words = self.words

        def learned(piece: str) -> bytes:
            if piece.isalpha():  # one word: it is remembered as a piece, not as a word too
                return words.get(piece) or words.learn(piece)
            return b"".join([words[w] for w in _WORDS.findall(piece)])

        self.pieces = _Cache(learned)
        self.others = _Cache(lambda piece: array("I", library.encode(piece, add_special_tokens=False).ids).tobytes())

    def one(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        known = self.others
        if _PLAIN.fullmatch(text) and not (self.special and "<|" in text):
            text, known = text.lower(), self.pieces
        return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" ")))

    def batch(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]

    def forget(self) -> None:
        """Drop what was learned; the vocabulary stays."""
        for cache in (self.words, self.pieces, self.others):
            cache.forget()


@lru_cache(maxsize=2)
def shared_ids(path: str, special: bool = True) -> PieceIds:
    """One ``PieceIds`` a worker process, which keeps what it has learned from task to task."""
    return PieceIds(path, special)
