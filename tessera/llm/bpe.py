"""Byte-level BPE of a public rank file, encoded with a segment tree over the ranks of adjacent pairs.

A word's leaves hold ``rank * n + position`` of the pair that starts there, so the minimum at the root is the
lowest rank and, among equal ranks, the leftmost pair. A merge changes three leaves: each is a logarithmic point
update. A word of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import base64
from functools import cache
from itertools import chain

import regex

#: Where the public rank files lie; a parameter of every operator that counts or encodes tokens.
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: how the rank file's vocabulary splits a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered by a worker; the memory is emptied when it is full, which changes no result.
REMEMBERED = 400_000
#: Longer words are encoded afresh, so that the memory stays small.
LONGEST_REMEMBERED = 64
_NONE = 1 << 62


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    known = ranks.get(word)
    if known is not None:
        return [known]
    n = len(word)
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * n + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(leaf: int, key: int) -> None:
        k = width + leaf
        tree[k] = key
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low

    while (root := tree[1]) != _NONE:
        left = root % n
        gone = after[left]
        end = after[gone]
        after[left] = end
        if gone < n - 1:
            put(gone, _NONE)
        if end < n:
            before[end] = left
            rank = ranks.get(word[left : after[end]])
            put(left, _NONE if rank is None else rank * n + left)
        else:
            put(left, _NONE)
        if left:
            first = before[left]
            rank = ranks.get(word[first:end])
            put(first, _NONE if rank is None else rank * n + first)
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : after[at]]])
        at = after[at]
    return out


class _Words(dict):
    """Ids by word, made when first asked for."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(merge_word(word.encode("utf-8", "surrogatepass"), self.ranks))
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts; one per worker process and rank file (see :func:`encoder`)."""

    def __init__(self, path: str = TOKENIZER_FILE) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(SPLIT)
        self.words = _Words(self.ranks)
        self.pieces = {i: b for b, i in self.ranks.items()}

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; an empty list for null and empty texts. Special tokens are ordinary text."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.words.__getitem__, self.split.findall(text))))

    def count(self, text: str | None) -> int:
        """How many ids ``text`` has."""
        if not text:
            return 0
        return sum(map(len, map(self.words.__getitem__, self.split.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.pieces[i] for i in ids)


@cache
def encoder(path: str = TOKENIZER_FILE) -> Encoder:
    return Encoder(path)
