"""Token ids of whole texts, fast: a word's ids are looked up, only new words are encoded.

``word_bpe_49k`` drops white space before it merges and never merges across it, so
a text's ids are the ids of its space-separated chunks in order (special strings
hold no space either).  Chunks are cut at ASCII white space only; any other is
left to the tokenizer.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

VOCABULARY = "word_bpe_49k.json"


@functools.cache
def tokenizer(path: str, plain: bool):
    """The tokenizer of a file; ``plain``: special strings in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    return t


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The file's own split rule for lower-cased printable ASCII; what precedes BPE leaves such pieces as they are.
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(rb"[!-~]+")
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0101-\u0148]+")  # small Latin letters: NFC and lower-casing leave them as they are
_MEMOS: dict = {}
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


def _raw(ids: list[int]) -> bytes:
    return np.array(ids, np.uint32).tobytes()


class _Pieces(dict):
    """Piece of the split rule -> its ids, straight from the BPE model."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode()
        written = text if text.isascii() else "".join(map(_ALPHABET.__getitem__, piece))
        self[piece] = got = _raw([x.id for x in self.model.tokenize(written)])
        return got


class _Words(dict):
    """Space-separated chunk -> its ids."""

    def __init__(self, t):
        self.tokenizer, self.pieces = t, _Pieces(t.model)

    def __missing__(self, word: bytes) -> bytes:
        self[word] = got = self._ids(word)
        return got

    def _ids(self, word: bytes) -> bytes:
        body = word.rstrip(_MARKS)
        tail = word[len(body) :]
        if body.isalpha():  # of ASCII letters, as bytes see it; marks after a letter are a piece of their own
            return self.pieces[body.lower()] + (self.pieces[tail] if tail else b"")
        if b"<|" in word:
            return self._whole(word)
        if _PLAIN.fullmatch(word):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))
        small = "".join(map(str.lower, body.decode("utf-8", "replace")))
        if _LATIN.fullmatch(small):
            return self.pieces[small.encode()] + (self.pieces[tail] if tail else b"")
        return self._whole(word)

    def _whole(self, word: bytes) -> bytes:
        return _raw(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)


_KEPT = [_MEMOS]


def remembered(memo: dict) -> dict:
    """A memo that a worker keeps for later tasks, until tasks of another kind ``forget`` it."""
    _KEPT.append(memo)
    return memo


def forget() -> None:
    """Frees what a worker's earlier tasks remembered, for tasks of another kind."""
    for memo in _KEPT:
        memo.clear()


class WordEncoder:
    """Text -> uint32 ids; the memos of words and pieces are bounded and kept for a worker's later tasks."""

    def __init__(self, path: str | None = None, plain: bool = False, limit: int = 1_000_000):
        self.path, self.plain, self.limit = path or vocabulary_path(), plain, limit

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        key = self.path, self.plain
        memo = _MEMOS.get(key)
        if memo is None or len(memo) > self.limit:
            memo = _MEMOS[key] = _Words(tokenizer(*key))
        return [np.frombuffer(b"".join(map(memo.__getitem__, t.split() if t else ())), np.uint32) for t in texts]
