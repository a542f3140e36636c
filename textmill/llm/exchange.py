"""Counts of hashed keys over the whole corpus, brought back to the blocks of documents that ask.

Each task deals the rows it reads into blocks of at most block_bytes() of text (or one longer text),
tokenised once: a block is one row with its texts' keys, their numbers of words, the distinct word
hashes and the words as places among these. A block sends its distinct keys, sorted and
delta-coded, once to each bucket (a range of the key space); a bucket adds up what all blocks
sent and answers each block in the block's own order. So a key crosses the network once for
each block that has it, in a few bytes, and a frequent key is summed inside its block first. Rows
of one id, null ids and a hot source spread over blocks as they are read.

Memory is bounded by a block or by a bucket's keys. A message holds at least one key of its block, so
messages grow at most as the distinct keys of all blocks do, in proportion to the data; that each holds
many keys is a matter of block_bytes(), which follows the executor's memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import scratch
from textmill.llm.words import U, Words, chunks
from textmill.llm.worker import enter, tidy

BLOCK_BYTES = 8 << 20
#: Blocks of text whose keys make one bucket.
BUCKET_BLOCKS = 1
#: Spare bits of a key: of n keys one in 2 ** SPARE at most shares its bits with another.
SPARE = 22
_ZSTD = "zstd"


def block_bytes(spark: SparkSession) -> int:
    """Text in a block: a hundredth of the executor memory of one core, BLOCK_BYTES at least."""
    conf = spark.sparkContext.getConf()
    n, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", conf.get("spark.executor.memory", "1g").lower()).groups()
    memory = int(n) << {"k": 10, "m": 20, "g": 30, "t": 40, "": 0}[unit]
    return max(BLOCK_BYTES, memory // max(1, int(conf.get("spark.executor.cores", "1"))) // 100)


def key_bits(keys: int) -> int:
    """Bits of a hashed key for a corpus of so many: they grow with it, so that collisions stay as rare."""
    return max(40, min(64, max(1, keys).bit_length() + SPARE))


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    planes = np.ascontiguousarray(np.asarray(a, dtype="<u8").view(np.uint8).reshape(-1, 8).T)
    used = int(planes.any(axis=1).nonzero()[0].max()) + 1 if len(a) and planes.any() else 0
    raw = planes[:used].tobytes()
    return len(a).to_bytes(8, "little") + bytes([used]) + (pa.compress(raw, _ZSTD, asbytes=True) if raw else b"")


def unpack(data: bytes) -> np.ndarray:
    n, used = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((8, n), dtype=np.uint8)
    if used:
        out[:used] = np.frombuffer(pa.decompress(data[9:], used * n, _ZSTD, asbytes=True), dtype=np.uint8).reshape(used, n)
    return np.ascontiguousarray(out.T).view("<u8").ravel().astype(U)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=U)


def blocks(docs: DataFrame, name: str, key_type: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """docs: k, t, lane boolean and boolean flags. A table of blocks: block long, lane boolean, k array, n_bytes long,
    the flags as arrays, counts, distinct and codes binary (A-Z lower-cased words). All of a block's rows are on
    one lane, and its number is odd where lane holds."""
    most = block_bytes(docs.sparkSession)
    carried = ["k", *flags]

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held = {lane: {"rows": [[] for _ in carried], "hash": [], "counts": [], "bytes": 0} for lane in (False, True)}

        def flush(lane):
            nonlocal made
            h = held[lane]
            distinct, codes = np.unique(np.concatenate(h["hash"]), return_inverse=True)
            values = [[(task << 32) + 2 * made + lane], [lane], [h["bytes"]], [pack(np.concatenate(h["counts"]))], [pack_sorted(distinct)], [pack(codes)]]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            lists = [pa.ListArray.from_arrays([0, sum(map(len, c))], pa.concat_arrays(c)) for c in h["rows"]]
            made += 1
            held[lane] = {"rows": [[] for _ in carried], "hash": [], "counts": [], "bytes": 0}
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)] + lists, ["block", "lane", "n_bytes", "counts", "distinct", "codes", *carried])

        for part in chunks(batches, "t", min(1 << 20, most)):
            for lane in (False, True):
                rows = part.filter(part.column("lane") if lane else pc.invert(part.column("lane")))
                if not rows.num_rows:
                    continue
                w, h = Words(rows.column("t"), lower=True), held[lane]
                if h["bytes"] and h["bytes"] + len(w.bytes) > most:
                    yield flush(lane)
                    h = held[lane]
                h["hash"].append(w.hash)
                h["counts"].append(w.counts)
                h["bytes"] += len(w.bytes) + rows.num_rows
                for c, column in zip(h["rows"], carried, strict=True):
                    c.append(rows.column(column))
        for lane in (False, True):
            if held[lane]["bytes"]:
                yield flush(lane)
        tidy()

    schema = f"block long, lane boolean, n_bytes long, counts binary, `distinct` binary, codes binary, k array<{key_type}>" + "".join(f", {f} array<boolean>" for f in flags)
    return scratch.table(docs.select("k", "t", "lane", *flags).mapInArrow(run, schema), name)


def words_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A block's word hashes end to end, and the number of words of each text."""
    return unpack_sorted(row["distinct"])[unpack(row["codes"]).astype(np.int64)], unpack(row["counts"]).astype(np.int64)


def buckets_of(made: DataFrame) -> tuple[int, int]:
    """The number of buckets for a table of blocks, and the bytes of its texts."""
    total = int(made.agg(F.sum("n_bytes")).first()[0] or 0)
    return max(1, -(-total // (BUCKET_BLOCKS * block_bytes(made.sparkSession)))), total


def slices(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Bounds of each bucket's share in sorted keys of `bits` bits."""
    edges = [(b << bits) // buckets for b in range(buckets)]
    return np.append(np.searchsorted(keys, np.array(edges, dtype=U)), len(keys))


def messages(block: int, space: int, keys: np.ndarray, counts: list[np.ndarray], buckets: int, bits: int) -> pa.RecordBatch:
    """What a block asks of one key space: a row for each bucket that it has keys for."""
    at = slices(keys, buckets, bits)
    rows = [(b, s, e) for b, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if e > s]
    columns = [pa.array([space] * len(rows), pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([b for b, _, _ in rows], pa.int32()), pa.array([pack_sorted(keys[s:e]) for _, s, e in rows], pa.binary())]
    columns += [pa.array([pack(c[s:e]) for _, s, e in rows], pa.binary()) for c in counts]
    return pa.RecordBatch.from_arrays(columns, ["space", "block", "bucket", "keys", *[f"c{i}" for i in range(len(counts))]])


def message_schema(counts: int) -> str:
    return "space int, block long, bucket int, keys binary" + "".join(f", c{i} binary" for i in range(counts))


def totals(asked: DataFrame, counts: int, name: str, answer: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """asked: messages. Answers (block, space, bucket, a0.. binary, distinct long, occurrences long, others long):
    the sums of each count over all blocks, aligned with the block's own
    keys; distinct keys whose first count is positive, and the sums of first and last counts, are on one
    row of each bucket. `answer` reshapes a sum before it is sent."""

    def run(table: pa.Table) -> pa.Table:
        enter()
        keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        ends = np.cumsum([0, *map(len, keys)])
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        answers, first = [], None
        for c in range(counts):
            given = np.concatenate([unpack(x.as_py()) for x in table.column(f"c{c}")])
            total = np.bincount(where, given, len(every)).astype(U)
            first = total if first is None else first
            sent = answer(total) if answer else total
            answers.append(pa.array([pack(sent[where[s:e]]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()))
        n = len(ends) - 1
        tidy()
        lead = lambda v: pa.array([int(v)] + [0] * (n - 1), pa.int64())
        return pa.Table.from_arrays([table.column("block").combine_chunks(), table.column("space").combine_chunks(), table.column("bucket").combine_chunks(), *answers, lead((first > 0).sum()), lead(first.sum()), lead(total.sum())], ["block", "space", "bucket", *[f"a{c}" for c in range(counts)], "distinct", "occurrences", "others"])

    schema = "block long, space int, bucket int, " + ", ".join(f"a{c} binary" for c in range(counts)) + ", `distinct` long, occurrences long, others long"
    return scratch.table(asked.groupBy("space", "bucket").applyInArrow(run, schema), name)


def answered(table: pa.Table, space: int, column: str) -> np.ndarray:
    """A block's answers of one key space, in the order of its sorted keys."""
    rows = [(b, x) for s, b, x in zip(table.column("space").to_pylist(), table.column("bucket").to_pylist(), table.column(column), strict=True) if s == space]
    return np.concatenate([np.zeros(0, U), *[unpack(x.as_py()) for _, x in sorted(rows, key=lambda r: r[0])]])
