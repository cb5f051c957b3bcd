"""Encoding of texts with a public byte-level BPE vocabulary.

Within one pre-token the lowest-ranked adjacent pair is merged first, of equal ones the leftmost. A segment tree over
the pair ranks holds that pair in its root; a merge changes three leaves, each in logarithmic time, until no pair of the
vocabulary is left. Texts never leave their partition: the operator is a narrow map whose cost follows the input.

Defined cases
- Null and empty texts give the empty list (0 tokens). The text is encoded as stored; strings of special tokens are
  ordinary text. Very long texts and pre-tokens are encoded whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the vocabulary's published pre-token pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A blank run with the word after it: no pre-token reaches beyond either end, so these parts can be encoded one by one.
# Python's \s also holds the separators 1C to 1F, which the vocabulary's pattern counts as marks.
PARTS = r"[^\S\x1c-\x1f]*+[\S\x1c-\x1f]++|[^\S\x1c-\x1f]+"

#: Distinct pre-tokens, and as many parts, that a Python worker remembers. It bounds memory, not what is encoded.
REMEMBERED = 200_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k's ranks; the package only locates files."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    none = len(ranks) * n + n
    size = 1 << (n - 2).bit_length()
    # a leaf is rank * n + position, so that the least leaf is the leftmost pair of the lowest rank
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right

    def put(at: int, leaf: int) -> None:
        at += size
        tree[at] = leaf
        while at > 1:
            at >>= 1
            left, right = tree[2 * at], tree[2 * at + 1]
            least = left if left < right else right
            if tree[at] == least:
                return
            tree[at] = least

    after, before = [*range(1, n + 1)], [*range(-1, n)]
    while (root := tree[1]) != none:
        i = root % n
        j = after[i]
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            rank = ranks.get(word[i : after[k]])
        else:
            rank = None
        put(i, none if rank is None else rank * n + i)
        if j < n - 1:
            put(j, none)
        if (h := before[i]) >= 0:
            rank = ranks.get(word[h:k])
            put(h, none if rank is None else rank * n + h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


@cache
def encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids as packed 32-bit integers; one for each worker and vocabulary."""
    ranks, words, parts = load_ranks(path), regex.compile(PATTERN).findall, re.compile(PARTS).findall

    @lru_cache(REMEMBERED)
    def packed(word: str) -> bytes:
        return np.array(merge_word(word.encode(), ranks), np.int32).tobytes()

    @lru_cache(REMEMBERED)
    def packed_part(part: str) -> bytes:
        return b"".join(map(packed, words(part)))

    return lambda text: b"".join(map(packed_part, parts(text)))


def token_ids(text: Column | str, vocabulary: str | None = None) -> Column:
    """Column of the ids (array of int) of a text column."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder(path)
        rows = [encode(x) if x else b"" for x in texts.to_pylist()]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in rows], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    return ids(text)


def token_count(text: Column | str, vocabulary: str | None = None) -> Column:
    """Column of the number of ids of a text column."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(path)
        return pa.array([len(encode(x)) // 4 if x else 0 for x in texts.to_pylist()], pa.int32())

    return count(text)
