"""Vectorised word and shingle hashing of Arrow string batches (for Python workers).

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A word's hash is
a polynomial over per-byte random values modulo 2**64, finalised by a bijective
mixer; it is read off prefix sums, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; bounds the arrays whatever the length of a text.
CHUNK = 1 << 20
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240131))
_P = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 8, so powers differ in their low bits
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["up"]) <= size:  # more than CHUNK only for a longer word
        n = max(CHUNK, size) + 1
        for name, base in (("up", int(_P)), ("down", pow(int(_P), -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["up"], _tables["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and n+1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - (at[0] if len(at) else 0)


def slices(batch: pa.RecordBatch, column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have at most ``size`` bytes, or are one text."""
    _, at = buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _chunk_words(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in ``raw``; breaks: positions where a new text begins."""
    up, down = _powers(len(raw))
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    begins[breaks] = ~space[breaks]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    ends = np.append(starts[1:], len(raw))  # bytes of spaces count 0
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + np.uint64(1))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and n+1 offsets of each text's words."""
    raw, at = buffers(texts)
    found_at, found = [], []
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + CHUNK)
        if hi < len(raw):  # end at a text's end or after white space
            last = int(at[np.searchsorted(at, hi, "right") - 1])
            spaces = np.flatnonzero(_SPACE[raw[lo:hi]])
            if last > lo:
                hi = last
            elif len(spaces):
                hi = lo + int(spaces[-1]) + 1
            else:
                hi = int(at[np.searchsorted(at, hi, "right")])
        i, j = np.searchsorted(at, [lo, hi])
        starts, hashes = _chunk_words(raw[lo:hi], at[i:j][at[i:j] < hi] - lo)
        found_at.append(starts + lo)
        found.append(hashes)
        lo = hi
    starts = np.concatenate(found_at) if found_at else np.zeros(0, np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.searchsorted(starts, at)


def short_gram_sets(texts: pa.Array, lengths: list[int], wanted: np.ndarray) -> Iterator[np.ndarray]:
    """For each text which of the sorted hashes ``wanted`` are those of its runs of so many words, under five, hashed like whole sequences."""
    words, at = word_hashes(texts)
    owners, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for m in lengths:
        n = len(words) - m + 1
        if n <= 0:
            continue
        runs = np.full(n, m, np.uint64)
        for k in range(m):
            runs += words[k : k + n] * _MUL[k]
        runs = mix(runs)
        place = np.minimum(np.searchsorted(wanted, runs), len(wanted) - 1)
        hit = np.nonzero((wanted[place] == runs) & (doc[:n] == doc[m - 1 : m - 1 + n]))[0]
        owners.append(doc[hit])
        hashes.append(runs[hit])
    owner, found = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(len(at)))
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield found[order[i:j]]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its set of five-word shingles as a sorted array of distinct hashes.

    With one to four words the whole sequence is the only shingle; without words there is none.
    """
    words, at = word_hashes(texts)
    n = len(words) - SHINGLE + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        runs += words[k : k + n] * _MUL[k]
    runs = mix(runs)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        m = j - i
        if m >= SHINGLE:
            yield np.unique(runs[i : j - SHINGLE + 1])
        elif m:
            yield mix(np.array([(words[i:j] * _MUL[:m]).sum(dtype=np.uint64) + np.uint64(m)], np.uint64))
        else:
            yield runs[:0]
