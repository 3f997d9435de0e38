"""Words and word shingles of many texts at once, as 64-bit hashes in arrays.

Texts are joined to one byte string and every word gets a polynomial hash from
prefix sums, so that no Python loop runs per word. A hash stands for its word:
two different words or shingles agree with a probability of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASE = 0x5851F42D4C957F2D
_powers = [np.ones(1, _U), np.ones(1, _U)]

#: Bytes of text handled at once, so that arrays of a batch stay small.
CHUNK_BYTES = 1 << 20

SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x + _U(_STEP)).astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def spaced(separators: bytes = SPACES) -> np.ndarray:
    """Table of 256: which bytes belong to words that ``separators`` divide."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Letters and digits of ASCII, and every byte of other characters.
WORDS_ONLY = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


class Words(NamedTuple):
    """Words of texts, in order. ``first[i]:first[i+1]`` are those of text i."""

    hashes: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of up to ``limit`` bytes, or one longer row."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def rechunked(batches: Iterator[pa.RecordBatch], at: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches cut anew, as ``chunks`` cuts ``rows`` rows at a time by the characters of
    column ``at``: for what depends on the texts beside a text, however small batches are."""
    held: list[pa.RecordBatch] = []
    total = seen = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        begin = 0
        for i, size in enumerate([len(t or "") for t in batch.column(at).to_pylist()]):
            if (begin < i or held) and (total + size > CHUNK_BYTES or seen == rows):
                if begin < i:
                    held.append(batch.slice(begin, i - begin))
                yield joined()
                held, begin, total = [], i, 0
            seen = seen % rows + 1
            total += size
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield joined()


def words_of(texts: list[bytes], letters: np.ndarray) -> Words:
    """Words of the texts; ``start`` and ``end`` are bytes within the text."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    inside = letters[joined]
    inside[begins[1:] - 1] = False
    change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, end = change[::2], change[1::2]
    up, down = _power_tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, _U)
    np.cumsum(_BYTES[joined] * up[: len(joined)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(_STEP))
    owner = np.searchsorted(begins, start, "right") - 1
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    return Words(hashes, owner, first, start - begins[owner], end - begins[owner])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, wherever texts begin or end."""
    last = max(0, len(hashes) - n + 1)
    total = np.full(last, n * _STEP % 2**64, _U)
    for j in range(n):
        total = mix(total) * _U(3) + hashes[j : last + j]
    return mix(total)


def shingles_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of each shingle of ``width`` words, in order.

    A text of fewer words, but at least one, has its whole sequence as its only
    shingle.
    """
    h, owner = words.hashes, words.owner
    sizes = np.diff(words.first)
    found, owners, at = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(1, width + 1):
        last = len(h) - n + 1
        if last <= 0 or not (sizes == n).any() and n < width:
            continue
        here = np.flatnonzero((owner[:last] == owner[n - 1 :]) & ((sizes[owner[:last]] == n) | (n == width)))
        found.append(grams(h, n)[here])
        owners.append(owner[here])
        at.append(here)
    order = np.argsort(np.concatenate(at), kind="stable")
    return np.concatenate(found)[order], np.concatenate(owners)[order]


def ascii_lower(text: str) -> bytes:
    """UTF-8 of the text with A-Z lower-cased, other characters as they are."""
    return text.encode("utf-8").lower()
