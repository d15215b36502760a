"""Words and shingles of many texts as 64-bit hashes, by whole-array operations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes hashed at a time: bounds the memory of one step, not the length of a text
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1 << 12, np.uint64)
_powers[1:] = _BASE
_powers = np.cumprod(_powers)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        grown = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown)
    return _powers


def _slice_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~_SPACE[b]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    first = starts[0]
    at = np.arange(first, len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
    table = _power_table(int(at.max()) + 1)
    sums = np.add.reduceat(_BYTE[b[first:]] * table[at], starts - first)
    return starts, mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def hash_words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, in order, and where each text's words start (one more at the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data):  # to the end of the word
            ahead = np.flatnonzero(_SPACE[data[end - 1 : end + SLICE]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(end + SLICE, len(data))
        s, h = _slice_words(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def text_batches(batches: Iterator[pa.RecordBatch], text_at: int, most_bytes: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut record batches into parts of about most_bytes of text (a longer text is a part of its own), with null texts as empty ones."""
    for batch in batches:
        column = batch.column(text_at).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.empty(0, np.int64)
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if i > first and held + n > most_bytes:
                yield batch.slice(first, i - first), [x or b"" for x in column.slice(first, i - first).to_pylist()]
                first, held = i, 0
            held += n
        if len(sizes) > first:
            yield batch.slice(first), [x or b"" for x in column.slice(first).to_pylist()]


_STEP = np.array([0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0xC13FA9A902A6328F, 0xE7037ED1A0B428DB, 0x91E10DA5C79E7B1D], np.uint64)


def shingle_sets(texts: Sequence[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's `width`-word shingles; a shorter text's whole sequence is one; no words, no shingles."""
    words, at = hash_words(texts)
    if len(words) >= width:
        runs = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            runs += mix(words[k : len(words) - width + 1 + k] * _STEP[k % 5] + np.uint64(k))
        runs = mix(runs)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            part = words[a:b]
            total = np.full(1, (b - a) * 0xA0761D6478BD642F % (1 << 64), np.uint64)
            for k in range(b - a):
                total = total + mix(part[k : k + 1] * _STEP[k % 5] + np.uint64(k))
            sets.append(mix(total))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
