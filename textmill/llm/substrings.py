"""Operator 3: substring deduplication by relative Lempel-Ziv parsing.

A document is parsed against the corpus before it (all documents of smaller id). The reference is
indexed in blocks: the least hash of the SEED-word grams in a window of `length` words (its
anchor) names the block that holds every occurrence of that window, so a document meets exactly
the blocks that can hold a factor of `length` words of it, and no others. Consecutive windows with
one anchor form a phrase; the parse goes greedily from phrase to phrase:

1. a phrase whose whole word sequence stands in its block with a smaller document is a copy;
   neighbouring copies run on into one long factor, whatever documents they come from;
2. the first occurrence of a phrase is checked window by window against the other phrases of its
   block: this settles the boundaries of factors, where a copy begins or ends inside a phrase.

Each word of a duplicate window is removed. The result is exact but for 64-bit hash collisions:
a window of `length` words goes if and only if the same word sequence starts in a document with a
smaller id. Windows are judged on the input.

Rows of one id are not smaller than each other, whatever their texts; null ids are never smaller than
another and lose nothing. Null and short texts have no windows. Texts of any length are handled by their
words; a hot passage meets in its block as one row for each distinct phrase and task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import scratch
from textmill.llm.words import Words, chunks, spans

SEED = 10


def _minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width` neighbours, by doubling."""
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def phrases(words: Words, length: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window's word, number of windows, anchor, hash of all its words) of every phrase, in order."""
    h = words.hash
    if len(h) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    up_to = len(h) - seed + 1
    at = np.arange(up_to)
    least = _minimum(spans(h, at, at + seed), length - seed + 1)
    window = np.flatnonzero(np.arange(len(least)) + length <= np.repeat(words.first[1:], words.counts)[: len(least)])
    anchor = least[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(window)))
    start = window[begin]
    return start, count, anchor[begin], spans(h, start, start + count + length - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _phrases(docs: DataFrame, length: int) -> DataFrame:
    """doc, row (hash of the text, which tells rows of one id apart), start (word), n (windows), anchor, phrase; narrow."""

    def run(batches):
        for part in chunks(batches, "t", 2 << 20):
            w = Words(part.column("t"))
            start, n, anchor, phrase = phrases(w, length)
            text = np.searchsorted(w.first, start, side="right") - 1
            yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(text)), part.column("row").take(pa.array(text)), pa.array((start - w.first[text]).astype(np.int32)), pa.array(n.astype(np.int32)), _signed(anchor), _signed(phrase)], ["doc", "row", "start", "n", "anchor", "phrase"])

    return docs.where("k IS NOT NULL").mapInArrow(run, "doc long, row long, start int, n int, anchor long, phrase long")


def _windows(asked: DataFrame, length: int) -> DataFrame:
    """doc, row, at (word), window (hash) of every window of the phrases asked for (k, row, t, asks array<struct<start,n>>)."""

    def run(batches):
        for part in chunks(batches, "t", 1 << 20):
            w = Words(part.column("t"))
            asks = part.column("asks")
            counts = np.diff(np.asarray(asks.offsets))
            flat = asks.flatten()
            start, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            owner = np.repeat(np.arange(part.num_rows), counts)
            which = np.repeat(np.arange(len(start)), n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            at = start[which] + inside
            place = w.first[owner[which]] + at
            row = pa.array(owner[which])
            yield pa.RecordBatch.from_arrays([part.column("k").take(row), part.column("row").take(row), pa.array(at.astype(np.int32)), _signed(spans(w.hash, place, place + length))], ["doc", "row", "at", "window"])

    return asked.mapInArrow(run, "doc long, row long, at int, window long")


#: At most so many keys of a join are hot: each has more than this part of all rows.
HOT = 2000


def _beside(rows: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """Each row with what the class of its keys knows; classes have one row for each key and its number of rows
    (copies). The rows of a hot key stay where they are: its class comes to them by broadcast, of at most HOT
    rows since the copies of all classes add up to at most all rows."""
    total = classes.agg(F.sum("copies")).first()[0] or 0
    here = F.col("copies") > max(1, total // HOT)
    hot = F.broadcast(classes.where(here))
    rest = rows.join(hot.select(*by), by, "left_anti").join(classes.where(~here), by)
    whole = rows.join(hot, by)
    return whole.unionByName(rest.select(*whole.columns))


def duplicate_spans(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, row, spans array<struct<start int, n int>>: the duplicate windows of each document that has any,
    as runs of n windows from a word."""
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("row"))
    found = scratch.table(_phrases(narrow, length), "phrases")
    # one row for each distinct phrase: its first document, summed before the shuffle
    classes = scratch.table(found.groupBy("anchor", "phrase").agg(F.min("doc").alias("least"), F.count("*").alias("copies")), "phrase-classes")
    # blocks with several phrases: there a phrase's first occurrence is checked at its boundaries
    several = classes.groupBy("anchor").agg(F.count("*").alias("phrases")).where("phrases > 1").select("anchor", F.lit(True).alias("several"))
    open_ = classes.join(several, "anchor", "left").where("several OR copies > 1").select("anchor", "phrase", "least", "copies", F.coalesce("several", F.lit(False)).alias("several"))
    known = scratch.table(_beside(found, scratch.table(open_, "open-classes"), ["anchor", "phrase"]).select("doc", "row", "start", "n", "least", "several"), "known-phrases")
    # factors: phrases that stand whole in an earlier document
    copied = known.where("doc > least").select("doc", "row", "start", "n")
    # boundaries: first occurrences, window by window
    asks = known.where("several AND doc = least").groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("asks"))
    asks = scratch.table(asks, "boundary-phrases")
    seen = scratch.table(_windows(narrow.withColumnRenamed("k", "doc").join(asks.hint("merge"), ["doc", "row"]).select(F.col("doc").alias("k"), "row", "t", "asks"), length), "boundary-windows")
    first = seen.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("copies")).where("most > least")
    edges = _beside(seen, scratch.table(first.drop("most"), "repeated-windows"), ["window"]).where("doc > least").select("doc", "row", F.col("at").alias("start"), F.lit(1).alias("n"))
    runs = copied.unionByName(edges).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    out = scratch.table(runs, "duplicate-spans")
    scratch.done_with(found, classes, known, asks, seen)
    return out


def _covered(w: Words, spans_column, length: int) -> np.ndarray:
    """Flags of the words of a column that its spans cover."""
    counts = np.diff(np.asarray(spans_column.offsets))
    flat = spans_column.flatten()
    start, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    place = w.first[np.repeat(np.arange(len(counts)), counts)] + start
    edge = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + n + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _with_spans(docs: DataFrame, length: int, key: str, text: str, columns: list[str]) -> tuple[DataFrame, list[str]]:
    spans_of = duplicate_spans(docs, length, key, text)
    carried = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    empty = F.array().cast("array<struct<start:int,n:int>>")
    # the same plan at every size: spans grow with the corpus, so they are never broadcast by a guess of their size
    joined = carried.join(spans_of.hint("merge"), (F.col("k") == F.col("doc")) & (F.xxhash64("t") == F.col("row")), "left")
    return joined.select("k", "t", F.coalesce("spans", empty).alias("spans"), *[f"c{i}" for i in range(len(columns))]), [f"c{i}" for i in range(len(columns))]


def digest(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    kind = dict(docs.dtypes)[key]
    joined, _ = _with_spans(docs, length, key, text, [])

    def run(batches):
        for part in chunks(batches, "t", 2 << 20):
            w = Words(part.column("t"))
            gone = _covered(w, part.column("spans"), length)
            raw, sums, removed = w.bytes.tobytes(), [], np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            for i in range(part.num_rows):
                b, e = int(w.offsets[i]), int(w.offsets[i + 1])
                if removed[i] == 0:
                    kept = b" ".join(raw[b:e].split())
                else:
                    s = slice(int(w.first[i]), int(w.first[i + 1]))
                    kept = b" ".join([x for x, g in zip(raw[b:e].split(), gone[s].tolist(), strict=True) if not g])
                sums.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sums, pa.string())], ["k", "n_words", "n_removed", "kept_sha256"])

    out = joined.mapInArrow(run, "k long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.col("k").cast(kind).alias(key), "n_words", "n_removed", "kept_sha256")


def removed(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with duplicate words cut out of `text`; what stands between kept words stays as it is.
    Rows and all other columns stay; a text that loses all its words becomes empty."""
    columns = docs.columns
    kinds = dict(docs.dtypes)
    joined, names = _with_spans(docs, length, key, text, columns)

    def run(batches):
        for part in chunks(batches, "t", 2 << 20):
            w = Words(part.column("t"))
            gone = _covered(w, part.column("spans"), length)
            raw, texts = w.bytes.tobytes(), part.column("t").to_pylist()
            lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            for i in np.flatnonzero(lost).tolist():
                b, e = int(w.offsets[i]), int(w.offsets[i + 1])
                s = slice(int(w.first[i]), int(w.first[i + 1]))
                flags, pieces, at = gone[s], [], b
                if flags.all():
                    texts[i] = ""
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    pieces.append(raw[at : int(w.starts[s][x])])
                    at = int(w.starts[s][y]) if y < len(flags) else e
                texts[i] = b"".join([*pieces, raw[at:e]]).decode("utf-8")
            place = {c: i for i, c in enumerate(columns)}
            out = [pa.array(texts, pa.string()) if c == text else part.column(f"c{place[c]}") for c in columns]
            yield pa.RecordBatch.from_arrays(out, names)

    out = joined.mapInArrow(run, ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, columns, strict=True)))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)])
