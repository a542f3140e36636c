"""A memory of encoded pieces for tokenizers whose result for a piece does not depend on its neighbours."""

from __future__ import annotations

import numpy as np

from textmill.llm.words import U, gathered, same_spans


class Memo:
    """Ids of byte spans: the library encodes a distinct span once. At most `known` spans are remembered
    (and those at hand); then the ones met only once since they were learned are forgotten, and if that
    leaves many, all. What is forgotten is encoded anew when met. Spans are found by hash and compared
    byte by byte with the one remembered; another span of the same hash goes to the library by itself."""

    def __init__(self, made, known: int = 600_000):
        self.made, self.known = made, known
        self._keep(None)

    def _keep(self, which: np.ndarray | None) -> None:
        """Forget all but some spans: of each a key, its ids (place and number) and its bytes (place and number)."""
        if which is None:
            self.keys = np.zeros(0, U)
            self.starts, self.lengths, self.begins, self.sizes = (np.zeros(0, np.int64) for _ in range(4))
            self.met, self.flat, self.raw = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8)
            return
        self.keys, self.lengths, self.sizes = self.keys[which], self.lengths[which], self.sizes[which]
        self.flat = self.flat[gathered(self.starts[which], self.lengths)]
        self.raw = self.raw[gathered(self.begins[which], self.sizes)]
        self.starts, self.begins = np.cumsum(self.lengths) - self.lengths, np.cumsum(self.sizes) - self.sizes
        self.met = np.zeros(len(which), np.int32)

    def _encoded(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[s:e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = [e.ids for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(lengths.sum())), lengths

    def _learn(self, buf: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        flat, lengths = self._encoded(raw, starts, ends)
        sizes = ends - starts
        into = np.searchsorted(self.keys, keys)
        insert = lambda a, b: np.insert(a, into, b)
        self.starts, self.lengths = insert(self.starts, np.cumsum(lengths) - lengths + len(self.flat)), insert(self.lengths, lengths)
        self.begins, self.sizes = insert(self.begins, np.cumsum(sizes) - sizes + len(self.raw)), insert(self.sizes, sizes)
        self.keys, self.met = insert(self.keys, keys), insert(self.met, 0)
        self.flat, self.raw = np.concatenate([self.flat, flat]), np.concatenate([self.raw, buf[gathered(starts, sizes)]])

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the spans end to end, and n+1 offsets of the spans into them."""
        keys, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.known:
            often = np.flatnonzero(self.met > 1)
            self._keep(often if len(often) <= self.known // 2 else None)
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != keys
        raw = b""
        if new.any():
            raw = buf.tobytes()
            self._learn(buf, raw, starts[at[new]], ends[at[new]], keys[new])
            place = np.searchsorted(self.keys, keys)
        self.met[place] += 1
        place = place[which]
        begin, flat = self.starts[place], self.flat
        lengths = self.lengths[place]
        odd = np.flatnonzero(~same_spans(buf, starts, ends, self.raw, self.begins[place], self.begins[place] + self.sizes[place]))
        if len(odd):
            more, sizes = self._encoded(raw or buf.tobytes(), starts[odd], ends[odd])
            begin[odd], lengths[odd] = np.cumsum(sizes) - sizes + len(flat), sizes
            flat = np.concatenate([flat, more])
        return flat[gathered(begin, lengths)], np.concatenate([[0], np.cumsum(lengths)])
