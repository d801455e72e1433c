"""Sets of word shingles as 64-bit hashes, many texts at a time.

A word's hash is the difference of two prefix sums of a polynomial over its bytes, so all words of a stretch of texts are
hashed by a few array operations; a shingle's hash mixes those of its words. Two shingles are taken as equal when their
hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(0, 1 << 63, 16, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13  # odd, and 3 modulo 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are hashed in stretches of about so many bytes, which bounds memory.
STRETCH = 1 << 20

_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, STRETCH + (1 << 18))
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))  # type: ignore[assignment]
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lower-cased), and where each text's words begin; one more at the end."""
    data = np.frombuffer((b" ".join(texts) + b" ").lower(), np.uint8)
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)])])
    hashes = _mix((sums[ends] - sums[starts]) * down[starts])
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, at)


def sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of k words, sorted; of fewer words, all of them make one."""
    words, begin = word_hashes(texts)
    if len(words) >= k:
        sums = sum((words[j : len(words) - k + 1 + j] * _PLACES[j] for j in range(k)), np.zeros(1, np.uint64))
        full = _mix(sums + np.uint64(k))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            yield _mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def stretches(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch as bytes (null is empty), in stretches; with the row that each begins at."""
    held: list[bytes] = []
    size = first = 0
    column = batch.column(text)
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    for i, value in enumerate(column):
        t = value.as_py() or b""
        held.append(t)
        size += len(t)
        if size >= STRETCH:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())
