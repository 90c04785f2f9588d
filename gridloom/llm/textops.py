"""Vectorised text primitives shared by the Python-side operators.

Words are maximal runs of ASCII letters, ASCII digits and non-ASCII bytes, with
A-Z lower-cased; in UTF-8 that is the code point class
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A word's hash is a polynomial over random
byte values modulo 2**64, finished by a bit mixer, so whole buffers are hashed by
cumulative sums and no Python object per word is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the working memory of a task.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit constants that depend on salt alone."""
    x = np.arange(1, n + 1, dtype=np.uint64) + np.uint64((salt * 0x632BE59BD9B4E019) & _MASK)
    return mix64(x * np.uint64(_BASE)) | np.uint64(1)


_byte = np.arange(256)
WORD_BYTE = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
_fold = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte)
BYTE_VALUE = mix64((_fold + 1).astype(np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _hash_block(data: np.ndarray, starts_of_text: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first bytes and end bytes of one buffer; no word spans a start of text.

    With prefixes a row a word: its hash, then those of its first so many bytes (0 if it has no more than that).
    """
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return np.empty((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), none, none
    word = WORD_BYTE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = starts_of_text[starts_of_text < n]
    first[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends_before = cut[cut > 0] - 1
    last[ends_before] = word[ends_before]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUE[data] * up, out=total[1:])
    whole = mix64((total[end] - total[begin]) * down[begin])
    if not prefixes:
        return whole, begin, end
    rows = [whole]
    for k in prefixes:
        part = mix64((total[np.minimum(begin + k, n)] - total[begin]) * down[begin] + np.uint64(k))
        rows.append(np.where(end - begin > k, part, np.uint64(0)))
    return np.stack(rows, 1), begin, end


def hash_words(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i+1]], and where each text's words start."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= BLOCK_BYTES:
            h, begin, _ = _hash_block(data[lo:hi], (offsets[i:j] - lo), prefixes)
            hashes.append(h)
            counts[i:j] = np.diff(np.searchsorted(begin, offsets[i : j + 1] - lo))
        else:  # one long text: blocks that end between words
            at, none = lo, np.zeros(1, np.int64)
            while at < hi:
                stop = min(hi, at + BLOCK_BYTES)
                while stop < hi:
                    gaps = np.flatnonzero(~WORD_BYTE[data[at:stop]])
                    if len(gaps):
                        stop = at + int(gaps[-1]) + 1
                        break
                    stop = min(hi, stop + BLOCK_BYTES)
                h, _, _ = _hash_block(data[at:stop], none, prefixes)
                hashes.append(h)
                counts[i] += len(h)
                at = stop
        i = j
    pointers = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=pointers[1:])
    return (np.concatenate(hashes) if hashes else _hash_block(data[:0], offsets, prefixes)[0]), pointers


def grams(words: np.ndarray, k: int, salt: int = 7) -> np.ndarray:
    """Hash of the k words from each position on, over text borders too: mask those with starts_of()."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(seeds(k, salt)):
        out += words[j : n + j] * c
    return mix64(out)


def gram_starts(pointers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose k words lie in one text, and where each text's such positions start."""
    count = np.maximum(np.diff(pointers) - k + 1, 0)
    ptr = np.zeros(len(pointers), np.int64)
    np.cumsum(count, out=ptr[1:])
    return np.repeat(pointers[:-1] - ptr[:-1], count) + np.arange(ptr[-1]), ptr


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and where each text's start.

    A text of fewer than k words has one shingle of all of them; a text without words
    but with bytes has one of its bytes; an empty text has none.
    """
    words, ptr = hash_words(data, offsets)
    n = np.diff(ptr)
    at, own = gram_starts(ptr, k)
    full = grams(words, k)[at]
    short = np.flatnonzero((n < k) & (np.diff(offsets) > 0))
    if not len(short):
        return full, own
    count = np.diff(own)
    count[short] = 1
    out_ptr = np.zeros(len(ptr), np.int64)
    np.cumsum(count, out=out_ptr[1:])
    out = np.empty(out_ptr[-1], np.uint64)
    is_short = np.zeros(len(n), bool)
    is_short[short] = True
    out[np.repeat(~is_short, count)] = full
    for i in short:
        if n[i]:
            one = grams(words[ptr[i] : ptr[i + 1]], int(n[i]), salt=100 + int(n[i]))
        else:
            raw = data[offsets[i] : offsets[i + 1]].astype(np.uint64)
            one = grams(mix64(raw + np.uint64(1)), len(raw), salt=1000)
        out[out_ptr[i]] = one[0]
    return out, out_ptr


def buffer_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, and the offsets of each."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def arrow_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of an Arrow string column without a copy per text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def row_slices(offsets: np.ndarray, limit: int = BLOCK_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes and at most so many rows each."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, i + rows)
        yield i, j
        i = j
