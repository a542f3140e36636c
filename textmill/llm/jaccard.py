"""Operator 5: n-gram Jaccard join with multiple-global-order prefix filtering.

A document's set is its distinct five-word shingles (A-Z lower-cased; with fewer words the whole
sequence is the one shingle; without words it is empty and linked with nothing). Two documents
link when 100 * |intersection| >= 80 * |union|.

1. The document frequency of every shingle is counted over the whole corpus (see exchange).
2. Several global orders sort shingles by frequency class and then by different hashes. Of a set
   of n, the first n - ceil(0.8 n) + 1 under an order are its prefix: linked sets share a prefix
   token under every order. Tokens of one document only cannot be shared and are left out, so
   only sets that are mostly shared have any prefix tokens at all.
3. Equal sets are one class. Candidates share a prefix token of the first order, have compatible
   sizes and places of that token, and prefixes that intersect under each other order: a pair is first
   tested on 64-bit summaries of these, which never reject a sharing pair, and before its sets are
   verified on the prefixes themselves.
4. Each token's members are first tied to the least of them. Verified links form components. Then
   all remaining pairs of one token whose members are in different components are verified, so a
   pair is skipped only when it is already connected: no group is expanded into all its pairs
   and no link between components is lost. A token with many members is dealt out in parts of at most
   about PART of them, each of which meets the token's other members in a task of its own.
5. Verification intersects the exact sets (64-bit hashes).

Null and empty texts: an empty set, a component of their own. Repeated ids count as one document
whose sets are all linked to it. A null id keeps a null component. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import exchange, graph, scratch
from textmill.llm.words import U, mix, sets_of

SHINGLE = 5
#: Members of a token that one task compares with the others.
PART = 256
ORDERS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _block_sets(row: dict, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """All sets of a block, in the order of its rows; made for about `step` words at a time."""
    words, counts = exchange.words_of(row)
    first = np.concatenate([[0], np.cumsum(counts)])
    values, sizes, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(first, first[at] + step, side="right")) - 1)
        v, o = sets_of(words[first[at] : first[to]], first[at : to + 1] - first[at], SHINGLE)
        values.append(v)
        sizes.append(np.diff(o))
        at = to
    return np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _frequency_class(df: np.ndarray) -> np.ndarray:
    """0 for one document, then 1 + the whole part of the binary logarithm."""
    return np.where(df <= 1, 0, 1 + np.floor(np.log2(np.maximum(df.astype(np.float64), 1)))).astype(U)


def _asked(blocks: DataFrame, buckets: int, bits: int) -> DataFrame:
    def run(batches):
        for part in batches:
            for i in range(part.num_rows):
                row = part.slice(i, 1).to_pylist()[0]
                values, _ = _block_sets(row)
                keys, counts = np.unique(values >> U(64 - bits), return_counts=True)
                del values
                yield exchange.messages(row["block"], 0, keys, [counts], buckets, bits)
                exchange.tidy()

    return blocks.mapInArrow(run, exchange.message_schema(1))


def _prefixes(values: np.ndarray, rank: np.ndarray, offsets: np.ndarray, per_cent: int):
    """For each set: prefix tokens of the first order that are shared, the other orders' ones (places in values, set
    by set and each in order of its value), and summaries of these."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    length = np.where(sizes > 0, sizes - -(-per_cent * sizes // 100) + 1, 0)
    owner = np.repeat(np.arange(n), sizes)
    shared = rank > 0
    # tokens of one document come first under every order, so they only use up places of the prefix
    left = np.maximum(length - np.bincount(owner[~shared], minlength=n), 0)
    some = np.flatnonzero(shared & (left > 0)[owner])
    v, r, o = values[some], rank[some], owner[some]
    held = np.bincount(o, minlength=n)
    inside = np.arange(len(some)) - np.repeat(np.cumsum(held) - held, held)
    chosen_here = inside < left[o]
    out, masks, others = None, [], []
    for salt in ORDERS:
        h = v if not salt else mix(v ^ U(salt))
        chosen = np.lexsort((h, r, o))[chosen_here]
        if out is None:
            out = some[chosen]
        else:
            mask = np.zeros(n, dtype=U)
            np.bitwise_or.at(mask, o[chosen], U(1) << (h[chosen] & U(63)))
            masks.append(mask)
            others.append(some[np.sort(chosen)])  # the values of a set are sorted
    return out, owner, shared, masks, others


def _described(blocks: DataFrame, answers: DataFrame, per_cent: int, bits: int) -> DataFrame:
    """doc, n, a, b (two sums that name the set), alone (tokens of this document only), prefix array<long>, m1, m2,
    p1, p2 binary (the other orders' prefixes, sorted), body binary (the shared shingles)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        values, offsets = _block_sets(left.select(["counts", "distinct", "codes"]).to_pylist()[0])
        _, place = np.unique(values >> U(64 - bits), return_inverse=True)
        rank = exchange.answered(right, 0, "a0")[place] if len(values) else np.zeros(0, U)
        del place
        total = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
        other = np.concatenate([np.zeros(1, U), np.cumsum(mix(values ^ U(0x5851F42D4C957F2D)), dtype=U)])
        a, b = total[offsets[1:]] - total[offsets[:-1]], other[offsets[1:]] - other[offsets[:-1]]
        del total, other
        prefix, owner, shared, masks, others = _prefixes(values, rank, offsets, per_cent)
        n = len(offsets) - 1
        many = np.bincount(owner[prefix], minlength=n) if len(values) else np.zeros(n, np.int64)
        ends = np.concatenate([[0], np.cumsum(many)])
        lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(values[prefix].view(np.int64)))
        bodies = [values[offsets[i] : offsets[i + 1]][shared[offsets[i] : offsets[i + 1]]].tobytes() if many[i] else None for i in range(n)]
        sides = [[values[o[ends[i] : ends[i + 1]]].tobytes() if many[i] else None for i in range(n)] for o in others]
        signed = lambda x: pa.array(x.view(np.int64))
        alone = np.bincount(owner[~shared], minlength=n)
        columns = [left.column("k").combine_chunks().flatten(), pa.array(np.diff(offsets)), signed(a), signed(b), pa.array(alone), lists, signed(masks[0]), signed(masks[1]), *(pa.array(x, pa.binary()) for x in [*sides, bodies])]
        del values, rank, bodies, sides
        exchange.tidy()
        return pa.Table.from_arrays(columns, ["doc", "n", "a", "b", "alone", "prefix", "m1", "m2", "p1", "p2", "body"])

    out = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return out.applyInArrow(run, "doc long, n long, a long, b long, alone long, prefix array<long>, m1 long, m2 long, p1 binary, p2 binary, body binary")


def _possible(pairs: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (u, v with n, at, m1, m2 of each side) that may still link: sizes, places, then the other orders.

    At the first token that two sets share, all they share comes from that place on: a link needs enough
    places behind it on both sides. At a later one the rule may fail, but the pair passed at its first."""
    small, large = F.least("u.n", "v.n"), F.greatest("u.n", "v.n")
    rest = F.least(F.col("u.n") - F.col("u.at"), F.col("v.n") - F.col("v.at"))
    sizes = (100 * small >= per_cent * large) & ((100 + per_cent) * rest >= per_cent * (small + large))
    meet = (F.col("u.m1").bitwiseAND(F.col("v.m1")) != 0) & (F.col("u.m2").bitwiseAND(F.col("v.m2")) != 0)
    return pairs.where(sizes & meet).select(F.col("u.doc").alias("u"), F.col("v.doc").alias("v")).where("u <> v").distinct()


def _common(x, y) -> int:
    """How many values two sorted sets share."""
    x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
    at = np.searchsorted(x, y)
    return int((x[np.minimum(at, len(x) - 1)] == y).sum())


def _verified(pairs: DataFrame, bodies: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (u, v) whose prefixes intersect under every order and whose exact sets link."""
    held = ("n", "p1", "p2", "body")
    side = lambda x: bodies.select(F.col("doc").alias(x), *[F.col(c).alias(f"{c}{x}") for c in held])

    def run(batches):
        for part in batches:
            u, v = part.column("nu").to_numpy(), part.column("nv").to_numpy()
            both = np.zeros(len(u), dtype=np.int64)
            sets = [(part.column(f"{c}u"), part.column(f"{c}v")) for c in held[1:]]
            for i in range(len(u)):
                if all(_common(x[i], y[i]) for x, y in sets[:2]):
                    both[i] = _common(sets[2][0][i], sets[2][1][i])
            fine = pa.array(100 * both >= per_cent * (u + v - both))
            yield pa.RecordBatch.from_arrays([part.column("u").filter(fine), part.column("v").filter(fine)], ["u", "v"])

    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", *[f"{c}{x}" for c in held for x in "uv"]).mapInArrow(run, "u long, v long")


def join(docs: DataFrame, per_cent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id (the least key reachable by links)."""
    kind = dict(docs.dtypes)[key]
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"), F.lit(False).alias("lane"))
    blocks = exchange.blocks(narrow, "word-blocks", "long")
    buckets, size = exchange.buckets_of(blocks)
    bits = exchange.key_bits(size // 4)
    answers = exchange.totals(_asked(blocks, buckets, bits), 1, "shingle-frequencies", _frequency_class)
    sets = scratch.table(_described(blocks.select("block", "k", "counts", "distinct", "codes"), answers.select("block", "space", "bucket", "a0"), per_cent, bits), "shingle-sets")
    scratch.done_with(answers, blocks)

    classes = scratch.table(sets.where("doc IS NOT NULL AND n > 0").groupBy("n", "a", "b").agg(F.min("doc").alias("rep")), "set-classes")
    bodies = sets.where("body IS NOT NULL").join(classes.select("n", "a", "b", F.col("rep").alias("doc")), ["n", "a", "b", "doc"], "left_semi")
    placed_tokens = bodies.select(F.posexplode("prefix").alias("i", "token"), "doc", "n", "alone", "m1", "m2")
    # `at`: how many tokens come before this one in the first order
    tokens = scratch.table(placed_tokens.select("token", F.struct("doc", "n", (F.col("alone") + F.col("i")).alias("at"), "m1", "m2").alias("d")), "prefix-tokens")
    heads = tokens.groupBy("token").agg(F.min("d").alias("u"), F.count("*").alias("members")).where("members > 1")
    stars = _possible(tokens.join(heads, "token").select("u", F.col("d").alias("v")), per_cent)
    links = _verified(stars, bodies, per_cent)
    first = graph.components(links)

    # pairs of one token across components
    placed = tokens.join(first, F.col("d.doc") == F.col("node"), "left").select("token", "d", F.coalesce("component", "d.doc").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members")).where("low < high")
    mixed = mixed.select("token", F.ceil(F.col("members") / PART).cast("int").alias("parts"))
    open_ = scratch.table(placed.join(mixed, "token"), "open-tokens")
    left = open_.select("token", F.pmod(F.xxhash64("d.doc"), F.col("parts")).cast("int").alias("part"), F.col("d").alias("u"), F.col("c").alias("cu"))
    right = open_.select("token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("d").alias("v"), F.col("c").alias("cv"))
    across = _possible(left.join(right, ["token", "part"]).where("cu < cv").select("u", "v"), per_cent)
    more = _verified(across, bodies, per_cent)
    named = more.join(first.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(first.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    second = graph.components(named.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))

    final = (
        classes.join(first, classes.rep == first.node, "left")
        .select("n", "a", "b", F.coalesce("component", "rep").alias("c"))
        .join(second.select("node", F.col("component").alias("root")), F.col("c") == F.col("node"), "left")
        .select("n", "a", "b", F.coalesce("root", "c").alias("component"))
    )
    out = sets.select("doc", "n", "a", "b").join(final, ["n", "a", "b"], "left")
    result = out.select(F.col("doc").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.coalesce("component", "doc")).otherwise(F.col("doc")).cast(kind).alias("component_id"))
    return result


def representatives(docs: DataFrame, per_cent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near duplicates: of each component the row of the least key stays."""
    members = join(docs, per_cent, key, text).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("gone")).distinct()
    return docs.join(members, F.col(f"`{key}`") == F.col("gone"), "left_anti")
