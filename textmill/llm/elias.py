"""Operator 8: token-id files with Elias-Fano document boundaries.

A file is a sequence of self-contained blocks of at most BLOCK_TOKENS ids or one longer
document. A block holds the ids of consecutive documents end to end (2 or 4 bytes each, by the
vocabulary's size), and two Elias-Fano sequences: the documents' end offsets and their ids in
ascending order. Each sequence of n values below u takes about n * (2 + log2(u / n)) bits: low
bits packed, high bits in unary, and, stored with them, a directory of the place of every 256th one bit. Offsets
are read by select: from a directory entry, over the non-zero bytes up to the next one. Blocks are
rows of a Parquet file (shard, seq, base, n_docs, n_tokens, block), because Spark's committers
make such files safe against lost tasks on any shared store; `block` is the format itself and
can be copied out as it is.

Order: documents are range-partitioned and sorted by id, so shards follow each other; the id
offset of a shard is a running sum over one row per shard. Null text: only the end id. Null
ids come first; rows of one id, or without one, are ordered by their texts, null first. Repeated rows all stay.
Added tokens in a text (<|endoftext|>) get their own ids, as the library's encode gives them.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm import scratch
from textmill.llm.memo import Memo
from textmill.llm.words import U, Words, chunks, folded

BLOCK_TOKENS = 1 << 20
MAGIC = b"TMEF1\0\0\0"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of values in [0, u]."""

    def __init__(self, n: int, low_bits: int, directory: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.directory, self.low, self.high = n, low_bits, directory, low, high

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=U)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        ratio = int(v[-1]) // n
        bits = max(0, ratio.bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits:
            planes = ((v[:, None] >> np.arange(bits, dtype=U)) & U(1)).astype(np.uint8)
            low = np.packbits(planes.ravel(), bitorder="little")
        at = (v >> U(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1, dtype=np.uint8)
        unary[at] = 1
        return cls(n, bits, at[::SAMPLE].astype(np.uint32), low, np.packbits(unary, bitorder="little"))

    def select1(self, i: int) -> int:
        """The place of the i-th one bit: from the directory, at most SAMPLE ones further."""
        place, left = int(self.directory[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        word = int(self.high[byte]) >> (place % 8) << (place % 8)
        while (found := word.bit_count()) <= left:
            left -= found
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        value = (self.select1(i) - i) << self.low_bits
        for k in range(self.low_bits):
            p = i * self.low_bits + k
            value |= (int(self.low[p >> 3]) >> (p & 7) & 1) << k
        return value

    def run(self, c: int) -> np.ndarray:
        """The c-th SAMPLE values: select over the bytes between two entries of the directory, zero bytes left out."""
        begin, count = int(self.directory[c]), min(SAMPLE, self.n - c * SAMPLE)
        end = int(self.directory[c + 1]) // 8 + 1 if c + 1 < len(self.directory) else len(self.high)
        held = self.high[begin // 8 : end]
        some = np.flatnonzero(held)
        bits = np.flatnonzero(np.unpackbits(held[some], bitorder="little"))
        ones = (some[bits >> 3] + begin // 8) * 8 + (bits & 7)
        ones = ones[np.searchsorted(ones, begin) :][:count]
        out = (ones - np.arange(c * SAMPLE, c * SAMPLE + count)).astype(U) << U(self.low_bits)
        if self.low_bits:
            at = c * SAMPLE * self.low_bits // 8  # SAMPLE is a multiple of eight
            planes = np.unpackbits(self.low[at : at + SAMPLE * self.low_bits // 8], bitorder="little")[: count * self.low_bits]
            out |= (planes.reshape(count, -1).astype(U) << np.arange(self.low_bits, dtype=U)).sum(axis=1, dtype=U)
        return out.astype(np.int64)

    def between(self, i: int, j: int) -> np.ndarray:
        """The values i to j - 1."""
        if i >= j:
            return np.zeros(0, np.int64)
        runs = [self.run(c) for c in range(i // SAMPLE, (j - 1) // SAMPLE + 1)]
        return np.concatenate(runs)[i % SAMPLE : i % SAMPLE + j - i]

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.directory.astype("<u4").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, low, high = struct.unpack_from("<QQQQ", data, at)
        at, entries = at + 32, -(-n // SAMPLE)
        directory = np.frombuffer(data, "<u4", entries, at)
        at += 4 * entries
        raw = np.frombuffer(data, np.uint8, low + high, at)
        return cls(n, bits, directory, raw[:low], raw[low:]), at + low + high


class Block:
    """Documents of one block: ids between boundaries, found by select."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token block")
        self.nulls, lowest, width, tokens = struct.unpack_from("<QqQQ", view, 8)
        self.ends, at = EliasFano.read(view, 40)
        self.keys, at = EliasFano.read(view, at)
        self.lowest = lowest
        self.tokens = np.frombuffer(view, np.uint16 if width == 2 else np.uint32, tokens, at)

    @staticmethod
    def pack(keys: list, counts: list[int], ids: np.ndarray, width: int) -> bytes:
        known = [k for k in keys if k is not None]
        lowest = known[0] if known else 0
        head = struct.pack("<QqQQ", len(keys) - len(known), lowest, width, len(ids))
        shifted = np.array(known, dtype=np.int64).astype(U) - np.array(lowest, dtype=np.int64).astype(U) if known else []
        return MAGIC + head + EliasFano.of(np.cumsum(counts)).to_bytes() + EliasFano.of(shifted).to_bytes() + ids.astype(np.uint16 if width == 2 else np.uint32).tobytes()

    def __len__(self) -> int:
        return self.ends.n

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.tokens[start:end]

    def documents(self):
        """(keys, starts, ends) of SAMPLE documents after another, by select."""
        last = 0
        for i in range(0, len(self), SAMPLE):
            ends = self.ends.run(i // SAMPLE)
            j = i + len(ends)
            known = self.keys.between(max(0, i - self.nulls), max(0, j - self.nulls)) + self.lowest
            yield [None] * (j - i - len(known)) + known.tolist(), np.concatenate([[last], ends[:-1]]), ends
            last = int(ends[-1])


@functools.lru_cache(maxsize=4)
def loaded(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_ALNUM, _STOP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP[[44, 46]] = True


#: Texts on which a tokenizer must show that it folds case and that its pieces keep inside words.
PROBES = ("The Cat, and THE dog. It ran 3.5 km", "a b  c\td\n\ne", "one.two,three 1,000.5", "Don't We'll x", "  lead and trail  ")


class WordEncoder:
    """Ids of whole texts through a tokenizer that folds case and whose pieces cross neither ASCII
    white space nor the gap between an ASCII letter or digit and a comma or full stop: a text's ids
    are those of its words in order. Texts that hold an added token (<|endoftext|>) go to the library
    whole; folded words never do, so for them such a token is plain text."""

    def __init__(self, made, known: int = 600_000):
        plain = type(made).from_str(made.to_str())
        plain.encode_special_tokens = True
        self.made, self.memo = made, Memo(plain, known)
        for text in PROBES:
            parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"(?<=[0-9A-Za-z])(?=[.,])", " ", text.lower()))
            if plain.encode(text, add_special_tokens=False).ids != [i for x in parts for i in plain.encode(x, add_special_tokens=False).ids]:
                raise ValueError("this tokenizer does not fold case or has pieces that cross words: its ids cannot be had word by word")
        added = "|".join(re.escape(t.content) for t in made.get_added_tokens_decoder().values())
        self.added = re.compile(added) if added else None

    def _whole(self, column) -> dict[int, list[int]]:
        """Ids of the column's texts with an added token, by row."""
        if self.added is None or not pc.any(pc.match_substring_regex(column, self.added.pattern)).as_py():
            return {}
        rows = [(i, t) for i, t in enumerate(column.to_pylist()) if t and self.added.search(t)]
        return {i: e.ids for (i, _), e in zip(rows, self.made.encode_batch_fast([t for _, t in rows], add_special_tokens=False), strict=True)}

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts end to end, and the number of ids of each text."""
        words = Words(column, lower=True, cut=(_ALNUM, _STOP))
        ids, edges = self.memo.ids(folded(words.bytes), words.starts, words.ends, words.hash)
        ends = edges[words.first]
        counts = np.diff(ends)
        if whole := self._whole(column):
            parts = [np.asarray(whole[i], ids.dtype) if i in whole else ids[s:e] for i, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
            ids, counts = np.concatenate(parts), np.array(list(map(len, parts)), counts.dtype)
        return ids, counts


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that words stay known from task to task."""
    return WordEncoder(loaded(path))


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append end_id to each, and write the blocks in ascending order of the key."""

    def run(batches):
        coder = word_encoder(tokenizer_path)
        width = 2 if max(coder.made.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        shard = _partition()
        state = {"keys": [], "counts": [], "ids": [], "n": 0, "seq": 0, "base": 0}

        def flush():
            block = Block.pack(state["keys"], state["counts"], np.concatenate(state["ids"]), width)
            row = [[shard], [state["seq"]], [state["base"]], [len(state["keys"])], [state["n"]], [block]]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int64()] * 5 + [pa.binary()], strict=True)], ["shard", "seq", "base", "n_docs", "n_tokens", "block"])
            state.update(keys=[], counts=[], ids=[], n=0, seq=state["seq"] + 1, base=state["base"] + state["n"])
            return out

        for part in chunks(batches, "t", 1 << 20):
            ids, counts = coder.encode(part.column("t"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            state["keys"] += part.column("k").to_pylist()
            state["counts"] += (counts + 1).tolist()
            state["ids"].append(ids)
            state["n"] += len(ids)
            if state["n"] >= BLOCK_TOKENS:
                yield flush()
        if state["keys"]:
            yield flush()

    ordered = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    ordered.mapInArrow(run, "shard long, seq long, base long, n_docs long, n_tokens long, block binary").write.option("compression", "zstd").parquet(path)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def read(spark, path: str, key: str = "doc_id") -> DataFrame:
    """Documents of written files: key, start (ids before it in all files), n_tokens, ids_crc32 (of
    its ids as little-endian unsigned 32-bit integers)."""
    blocks = spark.read.schema("shard long, seq long, base long, n_docs long, n_tokens long, block binary").parquet(path)
    # a shard is a partition of the writing job, so this side has one short row for each of its tasks
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))

    def run(batches):
        for part in batches:
            for base, data in zip(part.column("at").to_pylist(), part.column("block"), strict=True):
                block = Block(data.as_buffer())
                wide = memoryview(block.tokens.astype("<u4"))
                for keys, starts, ends in block.documents():
                    sums = [zlib.crc32(wide[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(sums, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return blocks.join(F.broadcast(before), "shard").select((F.col("before") + F.col("base")).alias("at"), "block").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def lookup(block: bytes, doc_id: int) -> np.ndarray | None:
    """One document's ids out of one block, by binary search with select only."""
    held = Block(block)
    low, high = 0, held.keys.n
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if held.keys[mid] + held.lowest < doc_id else (low, mid)
    return held.document(held.nulls + low) if low < held.keys.n and held.keys[low] + held.lowest == doc_id else None


def written_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    path = scratch.fresh(docs.sparkSession, "token-ids")
    write(docs, tokenizer_path, path, end_id)
    return read(docs.sparkSession, path)
