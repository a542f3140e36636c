"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search.

An item is the set of its distinct five-word shingles (A-Z lower-cased; an item of fewer words is
one shingle of all its words; an empty one has none). A document contains it when at least
`threshold` of the item's shingles are among the document's. Items are partitioned by the power
of two of their set size; the upper bound u of a partition fixes how many minima of the hash
order are needed: an item with at least threshold * n shingles present lacks at most
n - ceil(threshold * n) of them, so one of its k = u - ceil(threshold * u) + 1 least hashes is
present. These k minima per item are the search keys: a document meets a key in its own hashes,
or the pair cannot qualify. A document may be as long as it likes; nothing is lost to unequal
sizes, and no pair of a document and an item without a common minimum is looked at. Candidates
are verified by exact shingle containment.

The items' sorted keys go to the executors where their size, checked before, is at most
BROADCAST_BYTES, and documents are read once without a shuffle. A larger benchmark stays distributed: only a
bitmap of its keys, of fixed size, goes to the executors; documents are read once, the shingles that meet the bitmap
join the keys, and the distinct pairs are verified by the item's set and the document's text. Both ways
give the same pairs, whatever the benchmark's size.

Null or empty texts contain nothing and are contained in nothing. Repeated rows and
repeated items yield their own pairs. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm import scratch
from textmill.llm.words import U, Words, chunks, shingle_sets, windows

BROADCAST_BYTES = 64 << 20
SHINGLE = 5


class Index:
    """Items' shingle sets end to end, and the partitions' minima with the items that have them."""

    def __init__(self, ids: list, texts: pa.Array, threshold: float):
        self.threshold = threshold
        w = Words(texts, lower=True)
        self.values, self.offsets = shingle_sets(w, SHINGLE)
        sizes = np.diff(self.offsets)
        keep = np.flatnonzero(sizes)
        self.ids = [ids[i] for i in keep]
        self.begin, self.size = self.offsets[keep], sizes[keep]
        self.short = sorted({int(n) for n in w.counts[keep] if n < SHINGLE})
        keys, owner = [], []
        for i, (b, n) in enumerate(zip(self.begin.tolist(), self.size.tolist(), strict=True)):
            upper = (1 << (n - 1).bit_length()) if n > 1 else 1
            k = min(n, upper - math.ceil(threshold * upper - 1e-9) + 1)
            keys.append(self.values[b : b + k])  # a set is sorted by hash: its first k are its minima
            owner += [i] * k
        self.keys = np.concatenate([*keys, np.zeros(0, U)])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owner = self.keys[order], np.array(owner, dtype=np.int64)[order]
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.keys >> U(48)).astype(np.int64)] = True

    def hashes(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, shingle hash) of a column, short whole-item widths included."""
        out = [words.grams(SHINGLE)] + [words.grams(n) for n in self.short]
        at = np.concatenate([a for a, _ in out])
        return np.searchsorted(words.first, at, side="right") - 1, np.concatenate([h for _, h in out])

    def search(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, shingles found) of all pairs that reach the threshold."""
        text, h = self.hashes(Words(column, lower=True))
        maybe = np.flatnonzero(self.seen[(h >> U(48)).astype(np.int64)])
        low = np.searchsorted(self.keys, h[maybe])
        many = np.searchsorted(self.keys, h[maybe], side="right") - low
        hit = many > 0
        low, many, doc = low[hit], many[hit], text[maybe[hit]]
        ends = np.cumsum(many)
        which = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - many), many)
        pairs = np.unique(np.stack([np.repeat(doc, many), self.owner[which]], axis=1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
        found = np.zeros(len(pairs), dtype=np.int64)
        last, held = -1, None
        bounds = None
        for i, (d, item) in enumerate(pairs.tolist()):
            if d != last:
                if bounds is None:
                    order = np.argsort(text, kind="stable")
                    bounds = np.searchsorted(text[order], np.arange(int(text.max()) + 2))
                held = np.unique(h[order[bounds[d] : bounds[d + 1]]])
                last = d
            b, n = int(self.begin[item]), int(self.size[item])
            at = np.searchsorted(held, self.values[b : b + n])
            found[i] = int((held[np.minimum(at, len(held) - 1)] == self.values[b : b + n]).sum())
        enough = found >= np.ceil(self.threshold * self.size[pairs[:, 1]] - 1e-9)
        return pairs[enough, 0], pairs[enough, 1], found[enough]


def _fits(items: DataFrame) -> bool:
    """Whether the items' index stays under BROADCAST_BYTES; it takes about eight times their text."""
    return 8 * int(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) <= BROADCAST_BYTES


def _held(items: DataFrame, threshold: float):
    got = items.orderBy("i").toArrow()
    return items.sparkSession.sparkContext.broadcast(Index(got.column("i").to_pylist(), got.column("t").combine_chunks(), threshold))


#: Bits of a key's place in the bitmap, and of its place in a page of it: 64 MB in 65,536 pages.
MAP_BITS, PAGE_BITS = 29, 13


def _identity(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for each of the 2 ** MAP_BITS ranges of hashes, set where a key lies."""

    def run(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PAGE_BITS, dtype=np.uint8)
        bits[table.column("slot").to_numpy() & ((1 << PAGE_BITS) - 1)] = 1
        return pa.table({"page": pa.array([table.column("slot")[0].as_py() >> PAGE_BITS], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    slots = keys.select(F.shiftrightunsigned("key", 64 - MAP_BITS).alias("slot")).distinct()
    pages = slots.groupBy(F.shiftright("slot", PAGE_BITS)).applyInArrow(run, "page long, bits binary").toArrow()  # 64 MB at most
    out = np.zeros((1 << (MAP_BITS - PAGE_BITS), 1 << (PAGE_BITS - 3)), dtype=np.uint8)
    for page, bits in zip(pages.column("page").to_pylist(), pages.column("bits"), strict=True):
        out[page] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.ravel()


def _joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(d, u, n, found) of pairs that reach the threshold, d and u the identities of a document and an item, without
    any broadcast that grows with the benchmark. docs: d, t; items: u, t, both distinct."""

    def sets(batches):
        for part in chunks(batches, "t", 2 << 20):
            index = Index(part.column("u").to_pylist(), part.column("t"), threshold)
            words = Words(part.column("t"), lower=True).counts
            width = np.minimum(words[words > 0], SHINGLE)
            whole = [index.values[b : b + n].tobytes() for b, n in zip(index.begin.tolist(), index.size.tolist(), strict=True)]
            many = np.bincount(index.owner, minlength=len(index.ids))
            order = np.argsort(index.owner, kind="stable")
            ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(index.keys[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(index.ids, pa.int64()), pa.array(width.astype(np.int32)), pa.array(index.size.astype(np.int64)), lists, pa.array(whole, pa.binary())], ["u", "width", "n", "minima", "body"])

    known = scratch.table(items.mapInArrow(sets, "u long, width int, n long, minima array<long>, body binary"), "item-sets")
    keys = known.select("u", F.explode("minima").alias("key"))
    widths = sorted(r.width for r in known.select("width").distinct().collect())  # five at most
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(keys))

    def meets(batches):
        bitmap = held.value
        for part in chunks(batches, "t", 2 << 20):
            w = Words(part.column("t"), lower=True)
            for width in widths:
                at, h = w.grams(width)
                slot = h >> U(64 - MAP_BITS)
                hit = np.flatnonzero(bitmap[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8) & 1)
                text = np.searchsorted(w.first, at[hit], side="right") - 1
                each = np.unique(np.stack([text, h[hit].view(np.int64)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([part.column("d").take(pa.array(each[:, 0])), pa.array(each[:, 1])], ["d", "key"])

    pairs = docs.mapInArrow(meets, "d long, key long").join(keys, "key").select("d", "u").distinct()

    def verified(batches):
        for part in chunks(batches, "t", 2 << 20):
            found = []
            w = Words(part.column("t"), lower=True)
            for i, (width, body) in enumerate(zip(part.column("width").to_pylist(), part.column("body"), strict=True)):
                want = np.frombuffer(body.as_buffer(), U)
                mine = w.hash[w.first[i] : w.first[i + 1]]
                have = np.unique(windows(mine, np.array([0, len(mine)]), width)[1])
                at = np.searchsorted(have, want)
                found.append(int((have[np.minimum(at, len(have) - 1)] == want).sum()) if len(have) else 0)
            found = np.array(found, dtype=np.int64)
            fine = pa.array(found >= np.ceil(threshold * part.column("n").to_numpy() - 1e-9))
            yield pa.RecordBatch.from_arrays([x.filter(fine) for x in (part.column("d"), part.column("u"), part.column("n"), pa.array(found))], ["d", "u", "n", "found"])

    beside = pairs.join(known.select("u", "width", "n", "body"), "u").join(docs, "d").select("d", "u", "width", "n", "body", "t")
    return scratch.table(beside.mapInArrow(verified, "d long, u long, n long, found long"), "contained")


def _distributed(docs: DataFrame, items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (k, t, ...) and items (i, t) with identities d and u, and the pairs of these."""
    docs = docs.withColumn("d", _identity("k", "t"))
    items = items.withColumn("u", _identity("i", "t"))
    one = lambda df, c: df.where("t IS NOT NULL").select(c, "t").dropDuplicates([c])
    return docs, items, _joined(one(docs, "d"), one(items, "u"), threshold)


def find(docs: DataFrame, items: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (key, item_id, n_item_shingles, n_found, containment) with containment >= threshold."""
    kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    narrow = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    bench = items.select(F.col(f"`{item_key}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t IS NOT NULL")
    if _fits(bench):
        held = _held(bench, threshold)

        def run(batches):
            index = held.value
            for part in chunks(batches, "t", 2 << 20):
                doc, item, n = index.search(part.column("t"))
                if len(doc):
                    size = index.size[item]
                    yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(doc)), pa.array([index.ids[i] for i in item]), pa.array(size), pa.array(n), pa.array(n / size)], ["k", "i", "n_item_shingles", "n_found", "containment"])

        out = narrow.mapInArrow(run, f"k {kind}, i {item_kind}, n_item_shingles long, n_found long, containment double")
    else:
        named, known, pairs = _distributed(narrow, bench, threshold)
        out = pairs.join(named.select("k", "d"), "d").join(known.select("i", "u"), "u")
        out = out.select("k", "i", F.col("n").alias("n_item_shingles"), F.col("found").alias("n_found"), (F.col("found") / F.col("n")).alias("containment"))
    return out.select(F.col("k").alias(key), F.col("i").alias(item_key), "n_item_shingles", "n_found", "containment")


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    now = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    at = names[docs.columns.index(text)]
    bench = items.select(F.col(f"`{item_key}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t IS NOT NULL")
    if _fits(bench):
        held = _held(bench, threshold)

        def run(batches):
            index = held.value
            for part in chunks(batches, at, 2 << 20):
                doc, _, _ = index.search(part.column(at))
                fine = np.ones(part.num_rows, dtype=bool)
                fine[doc] = False
                yield part.filter(pa.array(fine))

        now = now.mapInArrow(run, now.schema)
    else:
        # a text decides by itself, so texts are their own identities
        found = _distributed(now.select(F.col(at).alias("t"), F.lit(0).alias("k")), bench, threshold)[2].select("d").distinct()
        now = now.join(found, _identity(F.lit(0), at) == F.col("d"), "left_anti")
    return now.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
