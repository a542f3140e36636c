"""Operator 1: language-model scoring by deleted interpolation.

Tokens are words with A-Z lower-cased and one end per text. Trigram, bigram and unigram
maximum-likelihood estimates and a uniform share for unseen tokens are mixed:

    P1(w)     = m f(w)         + (1 - m) / (V + 1)
    P2(w|v)   = b[k(v)] f(w|v)   + (1 - b[k(v)]) P1(w)
    P3(w|u,v) = c[k(u,v)] f(w|u,v) + (1 - c[k(u,v)]) P2(w|v)

where k buckets a context by the binary logarithm of its frequency; an unseen context has weight
0. The weights are learned by expectation-maximisation on held-out counts: every tenth training
document by hashed id and text is deleted from the counts (whole-corpus counts less the deleted part's), and
the exact estimates of its tokens are written to a table. Each step sums the expectations of all
these tokens on the executors; only sums for each bucket of contexts (4 * BUCKETS + 3 numbers) come to the
driver. Steps end when a token's mean likelihood gains less than TOLERANCE, after ROUNDS at most.
Scores then use the counts of all training documents.

All counts cover all training documents and come back to each block of documents through the
exchange. Unigram keys have 64 bits, so base figures are exact but for 64-bit collisions; keys of bigrams
and trigrams have exchange.key_bits() of the corpus's tokens, up to 64.

Null text: only the end. Null id: scored, not learned from. Repeated rows are learned from and
scored each. Empty tables give no rows. Extra columns never enter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm import exchange, scratch
from textmill.llm.words import U, mix

DELETED = 10
BUCKETS = 32
ROUNDS, TOLERANCE = 40, 2e-5
_END, _START = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)
_P, _Q = U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)


class Tokens:
    """A block's tokens in text order; token i of the block is in text owner[i]."""

    def __init__(self, row: dict, bits: int):
        words, counts = exchange.words_of(row)
        now = np.insert(words, np.cumsum(counts), _END)
        del words
        self.bits = (64, bits, bits)
        self.n = counts + 1
        first = np.cumsum(self.n) - self.n
        self.owner = np.repeat(np.arange(len(counts), dtype=np.int32), self.n)
        self.begins = np.zeros(len(now), dtype=bool)
        self.begins[first] = True
        self.now = now

    def key(self, order: int) -> np.ndarray:
        """Each token's key of an order, made anew when asked for: a block holds only one at a time."""
        if order == 0:
            return self.now
        at = np.flatnonzero(self.begins)
        out = np.empty_like(self.now)
        out[1:] = self.now[:-1]
        out[at] = _START
        if order == 2:
            one = out
            out = np.empty_like(one)
            out[1:] = one[:-1]
            out[at] = _START
            out *= _P
            out += one
            del one
            out = mix(out)
            out *= _Q
        else:
            out *= _P
        out += self.now
        out = mix(out)
        out >>= U(64 - self.bits[order])
        return out

    def __len__(self) -> int:
        return len(self.owner)

    def table(self, order: int, flags: list[np.ndarray]):
        """Sorted distinct keys of an order, and for each of the flags of texts the occurrences in flagged ones."""
        keys, where = np.unique(self.key(order), return_inverse=True)
        return keys, [np.bincount(where, f[self.owner], len(keys)).astype(U) for f in flags]

    def estimates(self, counts: list[np.ndarray], all_tokens: float, all_texts: float, step: int = 1 << 16):
        """counts: of each order, aligned with its sorted keys. Yields, for a slice of the tokens at a time,
        the slice, unigram counts, the three estimates and the buckets of both contexts. Uses the tokens up."""
        places = []
        for order in range(3):
            places.append(np.unique(self.key(order), return_inverse=True)[1].astype(np.int32))
            counts[order] = counts[order].astype(np.float32) if counts[order].max(initial=0) < 1 << 24 else counts[order]
        del self.now
        exchange.tidy()
        for low in range(0, len(self), step):
            part = slice(low, min(low + step, len(self)))
            wide = slice(max(0, low - 1), part.stop)
            one, two, three = (c[p[wide]].astype(np.float64) for c, p in zip(counts, places, strict=True))
            context1, context2 = np.empty(part.stop - low), np.empty(part.stop - low)
            known = wide.start < low  # the token before the slice is at hand
            context1[0 if known else 1 :], context2[0 if known else 1 :] = one[:-1], two[:-1]
            begins = self.begins[part]
            context1[begins], context2[begins] = all_texts, all_texts
            one, two, three = one[int(known) :], two[int(known) :], three[int(known) :]
            with np.errstate(divide="ignore", invalid="ignore"):
                f1 = one / all_tokens if all_tokens else np.zeros(len(one))
                f2 = np.minimum(np.where(context1 > 0, two / context1, 0.0), 1.0)
                f3 = np.minimum(np.where(context2 > 0, three / context2, 0.0), 1.0)
            yield part, one, f1, f2, f3, bucket(context1), bucket(context2)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of the binary logarithm of its frequency."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(np.int64)


class Weights:
    def __init__(self):
        self.one = 0.9
        self.two, self.three = np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5)
        self.two[0] = self.three[0] = 0.0

    def mix(self, f1, f2, f3, k1, k2, unseen: float):
        p1 = self.one * f1 + (1 - self.one) * unseen
        p2 = self.two[k1] * f2 + (1 - self.two[k1]) * p1
        return self.three[k2] * f3 + (1 - self.three[k2]) * p2

    def expected(self, f1, f2, f3, k1, k2, unseen: float) -> np.ndarray:
        """Sums over tokens: for each bucket the trigram's share, all, the bigram's share, what it was asked
        for; then the unigram's share, the logarithm of the likelihood, and the tokens."""
        a3 = self.three[k2] * f3
        a2 = (1 - self.three[k2]) * self.two[k1] * f2
        rest = (1 - self.three[k2]) * (1 - self.two[k1])
        a1, a0 = rest * self.one * f1, rest * (1 - self.one) * unseen
        every = a3 + a2 + a1 + a0
        a3, a2, a1, a0 = a3 / every, a2 / every, a1 / every, a0 / every
        of = lambda k, w=None: np.bincount(k, w, BUCKETS)
        return np.concatenate([of(k2, a3), of(k2), of(k1, a2), of(k1, a2 + a1 + a0), [a1.sum(), np.log(every).sum(), len(k1)]])

    def step(self, sums: np.ndarray) -> None:
        """The maximisation step."""
        hit3, all3, hit2, all2 = np.split(sums[: 4 * BUCKETS], 4)
        for w, hit, every in ((self.three, hit3, all3), (self.two, hit2, all2)):
            w[:] = np.where(every > 0, np.clip(hit / np.maximum(every, 1e-300), 0.0, 0.9999), w)
            w[0] = 0.0
        low = (all2 - hit2).sum()
        if low > 0:
            self.one = float(np.clip(sums[4 * BUCKETS] / low, 1e-4, 0.9999))

    @classmethod
    def learn(cls, estimates: DataFrame, unseen: float) -> Weights:
        """Expectation-maximisation over a table of estimates: a step is one aggregation over it."""
        self, last = cls(), None
        spark = estimates.sparkSession
        for _ in range(ROUNDS):
            held = spark.sparkContext.broadcast((self.one, self.two.copy(), self.three.copy()))

            def run(batches, held=held):
                now = cls()
                now.one, now.two, now.three = held.value
                total = np.zeros(4 * BUCKETS + 3)
                for part in batches:
                    for i in range(part.num_rows):
                        f1, f2, f3 = (np.frombuffer(part.column(c)[i].as_buffer(), np.float64) for c in ("f1", "f2", "f3"))
                        k1, k2 = (np.frombuffer(part.column(c)[i].as_buffer(), np.uint8).astype(np.int64) for c in ("k1", "k2"))
                        total += now.expected(f1, f2, f3, k1, k2, unseen)
                exchange.tidy()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["slot", "v"])

            got = estimates.mapInArrow(run, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v")).collect()
            held.destroy()
            sums = np.zeros(4 * BUCKETS + 3)
            for r in got:
                sums[r.slot] = r.v
            n = sums[-1]
            if not n:
                break
            self.step(sums)
            if last is not None and sums[-2] / n - last < TOLERANCE:
                break
            last = sums[-2] / n
        return self


def _asked(blocks: DataFrame, buckets: int, bits: int) -> DataFrame:
    def run(batches):
        for part in batches:
            for row in (part.slice(i, 1).to_pylist()[0] for i in range(part.num_rows)):
                tokens = Tokens(row, bits)
                train = np.array(row["train"], dtype=np.float64)
                for space in range(3):
                    keys, counts = tokens.table(space, [train, train * row["lane"]])
                    yield exchange.messages(row["block"], space, keys, counts, buckets, tokens.bits[space])
                del tokens
                exchange.tidy()

    return blocks.mapInArrow(run, exchange.message_schema(2))


def _estimates(blocks: DataFrame, answers: DataFrame, n_tokens: int, n_texts: int, bits: int) -> DataFrame:
    """The deleted training tokens' estimates and buckets of contexts, many to a row, against the counts without them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        tokens = Tokens(row, bits)
        kept = [exchange.answered(right, s, "a0") - exchange.answered(right, s, "a1") for s in range(3)]
        train = np.array(row["train"], dtype=bool)
        rows = []
        for part, _, f1, f2, f3, k1, k2 in tokens.estimates(kept, n_tokens, n_texts):
            here = train[tokens.owner[part]]
            rows.append([f[here].tobytes() for f in (f1, f2, f3)] + [k[here].astype(np.uint8).tobytes() for k in (k1, k2)])
        del kept
        exchange.tidy()
        return pa.Table.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["f1", "f2", "f3", "k1", "k2"])

    made = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "f1 binary, f2 binary, f3 binary, k1 binary, k2 binary")
    return scratch.table(made, "held-out-estimates")


def score(docs: DataFrame, learned_from: Column, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    learned_from and held_out are boolean columns over docs; a null learned_from is false."""
    kind = dict(docs.dtypes)[key]
    gone = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit("deleted")), F.lit(DELETED)) == 0
    narrow = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), gone.alias("lane"), F.coalesce(learned_from, F.lit(False)).alias("train"), F.coalesce(held_out, F.lit(False)).alias("held"))
    blocks = exchange.blocks(narrow, "word-blocks", kind, ("train", "held"))
    buckets, size = exchange.buckets_of(blocks)
    bits = exchange.key_bits(size // 4)
    answers = exchange.totals(_asked(blocks, buckets, bits), 2, "gram-counts")
    seen = answers.where("space = 0").agg(F.sum("distinct"), F.sum("occurrences"), F.sum("others")).first()
    vocabulary, n_train, n_deleted = (int(x or 0) for x in seen)
    texts = blocks.select("lane", F.size(F.filter("train", lambda x: x)).alias("n")).groupBy("lane").agg(F.sum("n").alias("n")).collect()
    n_texts, kept_texts = sum(r.n for r in texts), sum(r.n for r in texts if not r.lane)
    unseen = 1.0 / (vocabulary + 1)
    replies = answers.select("block", "space", "bucket", "a0", "a1")
    deleted = blocks.where("lane")
    estimates = _estimates(deleted, replies.where("block % 2 = 1"), n_train - n_deleted, kept_texts, bits)
    weights = Weights.learn(estimates, unseen)
    scratch.done_with(estimates)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = Tokens(left.to_pylist()[0], bits)
        counts = [exchange.answered(right, s, "a0") for s in range(3)]
        texts_here = len(tokens.n)
        base, said, known = (np.zeros(texts_here) for _ in range(3))
        for part, c, f1, f2, f3, k1, k2 in tokens.estimates(counts, n_train, n_texts):
            owner = tokens.owner[part]
            base += np.bincount(owner, np.log10((c + 1) / (n_train + vocabulary + 1)), texts_here)
            said += np.bincount(owner, np.log10(weights.mix(f1, f2, f3, k1, k2, unseen)), texts_here)
            known += np.bincount(owner, c > 0, texts_here)
        known = known.astype(np.int64)
        exchange.tidy()
        columns = [left.column("k").combine_chunks().flatten(), left.column("held").combine_chunks().flatten(), pa.array(tokens.n), pa.array(known), pa.array(np.full(texts_here, n_train, np.int64)), pa.array(base), pa.array(said)]
        return pa.Table.from_arrays(columns, ["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = blocks.groupBy("block").cogroup(replies.select("block", "space", "bucket", "a0").groupBy("block"))
    return out.applyInArrow(run, f"k {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("k", key)
