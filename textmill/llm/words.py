"""Vectorised words, word hashes and word-window hashes over Arrow string columns.

A word is a maximal run of bytes other than space and \\t-\\r, which in UTF-8 is the pattern
[^\\x20\\x09-\\x0D]+. Nulls are empty texts. All hashes are 64-bit, computed with wrapping
arithmetic, and the same on every machine. Working memory is bounded by SEGMENT bytes of text
at a time plus eight bytes for each word of one chunk; only a single longer word exceeds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textmill.llm import worker

U = np.uint64
CHUNK_BYTES = 4 << 20
_LANE, _ODD, _JOIN = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def chunks(batches, column: str, most: int = CHUNK_BYTES):
    """Record batches cut so that `column` has at most `most` bytes in each, or one row. Memory freed by then goes
    back to the system after the last."""
    worker.enter()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(ends):
            floor = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, floor + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    worker.tidy()


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, offs - offs[0]


class Words:
    """The words of a column: byte spans, the first word of each text, and 64-bit hashes."""

    def __init__(self, column, lower: bool = False, cut: tuple[np.ndarray, np.ndarray] | None = None):
        """cut: tables of bytes; a word is also divided between a byte of the first and one of the second."""
        self.bytes, self.offsets = utf8(column)
        buf = self.bytes
        if len(buf):
            solid = ~_SPACE[buf]
            bound = np.zeros(len(buf) + 1, dtype=bool)
            bound[self.offsets] = True
            before = np.zeros(len(buf), dtype=bool)
            before[1:] = solid[:-1]
            before[bound[:-1]] = False
            after = np.zeros(len(buf), dtype=bool)
            after[:-1] = solid[1:]
            after[bound[1:]] = False
            if cut is not None:
                parted = cut[0][buf[:-1]] & cut[1][buf[1:]]
                before[1:] &= ~parted
                after[:-1] &= ~parted
            self.starts = np.flatnonzero(solid & ~before)
            self.ends = np.flatnonzero(solid & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.first[-1] = len(self.starts)
        self.counts = np.diff(self.first)
        self.lower = lower
        self._hash = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.bytes, self.starts, self.ends, self.lower)
        return self._hash

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word positions) and hashes of all windows of n words inside one text."""
        return windows(self.hash, self.first, n)


def folded(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[buf]


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one little-endian number; zeros follow the last."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(buf) + 1,), strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the byte spans buf[start:end], none of them empty."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, dtype=U)
    lanes = _lanes(folded(buf) if lower else buf)
    head = lanes[starts]
    head &= U(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(n, 8)) * 8).astype(U)
    out = mix(head ^ _LANE)
    long = np.flatnonzero(n > 8)
    if len(long):
        count = (n[long] - 1) >> 3  # lanes after the first
        first = np.cumsum(count) - count
        which = np.repeat(np.arange(len(long)), count)
        place = np.arange(len(which)) - first[which] + 1
        at = starts[long][which] + 8 * place
        left = ends[long][which] - at
        more = lanes[at]
        more &= U(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(U)
        key = (place + 1).astype(U)
        more = mix(more ^ (key * _LANE)) * (U(2) * key * _ODD + U(1))
        out[long] += np.add.reduceat(more, first)
    return mix(out + n.astype(U) * _ODD)


def same_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> np.ndarray:
    """Whether each byte span buf[start:end] equals other[begin:finish]; none is empty."""
    n = end - start
    one, two = _lanes(buf), _lanes(other)
    same = n == finish - begin
    same &= (one[start] ^ two[begin]) << ((8 - np.minimum(n, 8)) * 8).astype(U) == 0
    long = np.flatnonzero(same & (n > 8))
    if len(long):
        # a span's last eight bytes, and all whole lanes before them
        count = (n[long] - 1) >> 3
        first = np.cumsum(count) - count
        which = np.repeat(np.arange(len(long)), count)
        at = np.minimum(8 * (np.arange(len(which)) - first[which] + 1), n[long][which] - 8)
        same[long] = np.bitwise_or.reduceat(one[start[long][which] + at] ^ two[begin[long][which] + at], first) == 0
    return same


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, end to end."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def windows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(first)
    last = np.repeat(first[1:], counts) - n
    at = np.flatnonzero(np.arange(len(h)) <= last)
    return at, spans(h, at, at + n)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _JOIN
    out += b
    out ^= out >> U(29)
    out *= _ODD
    out ^= out >> U(32)
    return out


def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences h[start:end], none of them empty: two runs of a power of two of words
    that cover a sequence, and its length."""
    start, end = np.asarray(start), np.asarray(end)
    n = end - start
    out = np.empty(len(n), dtype=U)
    if not len(n):
        return out
    longest, alike, width, runs = int(n.max()), int(n.min()) == int(n.max()), 1, h
    while True:
        if 2 * width > longest and alike:
            return mix(_joined(runs[start], runs[end - width]) + n.astype(U))
        at = np.flatnonzero((n >= width) & (n < 2 * width))
        out[at] = mix(_joined(runs[start[at]], runs[end[at] - width]) + n[at].astype(U))
        width *= 2
        if width > longest:
            return out
        runs = _joined(runs[: -(width // 2)], runs[width // 2 :])


def per_text_unique(values: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted inside it, and the n+1 offsets of the texts."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[keep], t[keep]
    return v, np.searchsorted(t, np.arange(n_texts + 1))


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each text with offsets; a shorter text is one shingle, an empty one none."""
    return sets_of(words.hash, words.first, n)


def sets_of(h: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The same from word hashes and each text's first word."""
    counts = np.diff(first)
    at, grams = windows(h, first, n)
    text = np.searchsorted(first, at, side="right") - 1
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        grams = np.concatenate([grams, spans(h, first[short], first[short + 1])])
        text = np.concatenate([text, short])
    return per_text_unique(grams, text, len(counts))
