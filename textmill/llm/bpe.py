"""Operator 4: byte-level BPE encoding and decoding.

The tokenizers library encodes whole Arrow batches. Its vocabulary and merges come from a rank
file (base64 token, rank): a token's merge is the pair left when its bytes are merged by lower
ranks only, which makes the library's merge list equal to merging by rank. Bytes are written as
characters by the usual printable-byte table; decoding inverts that table, so ids turn back into
exact bytes even where one character's bytes are split over tokens. Where only ids are asked for, a
text is first cut at places that no piece of the pattern crosses, and each distinct segment goes
through the library once.

Null text: an empty document without ids. Empty tables give empty results. Repeated rows and
equal ids are encoded one by one. Other columns of the input are kept out of the result, so
clashing names cannot arise.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.memo import Memo
from textmill.llm.words import chunks, span_hashes, utf8
from textmill.llm.worker import of_stage

#: Fixed value: the pattern that splits text before merging in this vocabulary's encoders.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_BYTES = 1 << 20


def byte_characters() -> list[str]:
    """The character for each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def _halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] >= rank:
            raise ValueError(f"token {token!r} cannot be reached by merges of lower rank")
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts[0], parts[1]


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str = PATTERN):
    """A tokenizers.Tokenizer that merges by the ranks in a rank file; no special tokens."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    by_rank = sorted(ranks, key=ranks.get)
    merges = [tuple(name[x] for x in _halves(t, ranks[t], ranks)) for t in by_rank if len(t) > 1]
    made = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


_WHITE, _SOLID, _CONT = _flags((9, 13), (32, 32)), _flags((0x21, 0x7E)), _flags((0x80, 0xBF))
#: First bytes of the two-byte characters from U+00C0 on, none of which is white space.
_TWO = _flags((0xC3, 0xDF))
_ALNUM, _STOP = _flags((48, 57), (65, 90), (97, 122)), _flags((44, 44), (46, 46))


def segments(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of byte spans that the pattern splits alike alone and in their text: cut before
    white space that follows what is surely none, before a space that precedes what is surely none, and
    between an ASCII letter or digit and a comma or full stop."""
    n = len(buf)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    if n > 1:
        a, b = buf[:-1], buf[1:]
        firm = _SOLID[a]
        firm[1:] |= _CONT[a[1:]] & _TWO[a[:-1]]
        cut[1:-1] |= (_WHITE[b] & firm) | (_ALNUM[a] & _STOP[b])
        cut[:-2] |= (a == 32) & (_SOLID[b] | _TWO[b])
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


class Coder:
    """Texts to ids through the library, each distinct segment once."""

    def __init__(self, path: str, known: int = 600_000):
        self.memo = Memo(tokenizer(path), known)

    def column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column end to end, and the n+1 offsets of its rows."""
        buf, offsets = utf8(column)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts, ends = segments(buf, offsets)
        ids, edges = self.memo.ids(buf, starts, ends, span_hashes(buf, starts, ends))
        return ids, edges[np.searchsorted(np.append(starts, len(buf)), offsets)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, offsets = self.column(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def coder(path: str) -> Coder:
    """One for each Python worker and stage, so that segments stay known from task to task."""
    return of_stage(Coder, path)


class ByteTable:
    """Bytes of each id, laid end to end, so that a list of ids decodes by one gather."""

    def __init__(self, path: str):
        chars = {c: b for b, c in enumerate(byte_characters())}
        named = tokenizer(path).get_vocab()
        tokens = {i: bytes(chars[c] for c in s) for s, i in named.items()}
        size = max(tokens) + 1
        self.lengths = np.array([len(tokens.get(i, b"")) for i in range(size)])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        if not len(lengths):
            return b""
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.flat[at].tobytes()


@functools.lru_cache(maxsize=4)
def byte_table(path: str) -> ByteTable:
    return ByteTable(path)


def encode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """One row per row of docs: the key, `ids` array<int>, and with offsets=True `spans`, an
    array<struct<begin,finish>> of the code points that each token touches (a token inside a
    character has that character's span)."""
    kind = dict(docs.dtypes)[key]
    out = f"`{key}` {kind}, ids array<int>" + ", spans array<struct<`begin`:int,`finish`:int>>" * offsets

    def run(batches):
        made = tokenizer(ranks_path)
        for part in chunks(batches, "t", BATCH_BYTES):
            texts = ["" if x is None else x for x in part.column("t").to_pylist()]
            found = (made.encode_batch if offsets else made.encode_batch_fast)(texts, add_special_tokens=False)
            ids = [np.array(e.ids, dtype=np.int32) for e in found]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([*ids, np.zeros(0, np.int32)]))
            columns = [part.column("k"), lists]
            if offsets:
                spans = np.array([s for e in found for s in e.offsets], dtype=np.int32).reshape(-1, 2)
                columns.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["begin", "finish"])))
            yield pa.RecordBatch.from_arrays(columns, [key, "ids", "spans"][: len(columns)])

    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, out)


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: the key, `bytes` (exact) and `text` (invalid UTF-8 at a cut becomes U+FFFD). Null ids: empty."""
    kind = dict(encoded.dtypes)[key]

    def run(batches):
        table = byte_table(ranks_path)
        for part in batches:
            lists = part.column("i")
            raw = [table.decode(np.asarray(x.values if x.is_valid else [], dtype=np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], [key, "bytes", "text"])

    return encoded.select(F.col(f"`{key}`").alias("k"), F.col(f"`{ids}`").alias("i")).mapInArrow(run, f"`{key}` {kind}, bytes binary, text string")


def round_trip(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, decode the ids, and describe both in one pass: key, n_tokens, ids_sha256 (decimal ids
    joined by a space), decoded_sha256 (decoded bytes), with with_ids also ids. Row by row, without a shuffle."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        made, table = coder(ranks_path), byte_table(ranks_path)
        said = np.array([b"%d " % i for i in range(len(table.lengths))], dtype=object)
        for part in chunks(batches, "t", BATCH_BYTES):
            ids, offsets = made.column(part.column("t"))
            n, a, b = np.diff(offsets), [], []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                a.append(hashlib.sha256(b"".join(said[ids[s:e]].tolist())[:-1]).hexdigest())
                b.append(hashlib.sha256(table.decode(ids[s:e])).hexdigest())
            columns = [part.column("k"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(offsets.astype(np.int32), ids))
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
