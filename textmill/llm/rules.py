"""Operator 7: quality rules judged by an isolation forest on rule statistics.

Statistics of each whole text come from one vectorised pass without a shuffle. Two base rules
reject outright. An isolation forest learns what good documents look like: its trees split random
features at random values over shares of the labelled good rows and a thin uniform background, and
a document that few splits isolate (a short mean path) is anomalous. The threshold is calibrated on labelled rows: the
anomaly score that separates bad from good best while at most `loss` of the good rows exceed it.

Fitting uses every labelled row that passes the base rules: all good rows are dealt out to the trees, so that
each is in one at least, trees grow on executors, and the threshold is the best of BINS cuts by counts over all labelled
rows. The driver gets the trees and the counts. Without labelled rows of both kinds only the base rules decide.

Null text: no words, so base_failed. Empty tables give no rows. Repeated ids are judged row by row;
a label that repeats or is null counts once or not at all. Extra columns never enter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import scratch
from textmill.llm.words import _SPACE, Words, chunks

#: Trees of a forest, the rows that a tree has at least where there are so many, and its greatest depth.
TREES, TREE_ROWS, DEPTH = 150, 512, 9
#: Uniform background rows for each good one.
BACKGROUND = 0.3
#: Cuts of the score, 0 to 1, among which the threshold is chosen.
BINS = 1 << 16
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "shouts", "bare_words", "stutter")


def _table_of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_IS_SYMBOL, _IS_UPPER, _IS_LOWER = _table_of(SYMBOLS), _table_of(bytes(range(65, 91))), _table_of(bytes(range(97, 123)))
_IS_SHOUT, _IS_DIGIT = _table_of(b"!"), _table_of(b"0123456789")
_IS_LETTERED = _IS_UPPER | _IS_LOWER | _IS_DIGIT | (np.arange(256) >= 0x80)
_IS_POINT = (np.arange(256) & 0xC0) != 0x80


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def statistics(column, window: int = 8) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The STATS of each text, exact, and the float matrix of FEATURES."""
    w = Words(column)
    buf, offs, n = w.bytes, w.offsets, len(w.counts)
    n_words = w.counts.astype(np.int64)
    word_chars = _counts(_IS_POINT[buf] & ~_SPACE[buf], offs)
    n_symbols = _counts(_IS_SYMBOL[buf], offs)
    at, h = w.grams(window)
    text = np.searchsorted(w.first, at, side="right") - 1
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[:-1] |= same
    twice[1:] |= same
    hit = at[order[twice]]
    edges = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + window, -1)
    n_repeat = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])[w.first]) if len(w) else np.zeros(n, np.int64)
    n_dup, n_lines = _lines(buf.tobytes(), offs)
    words = np.maximum(n_words, 1)
    upper, lower = _counts(_IS_UPPER[buf], offs), _counts(_IS_LOWER[buf], offs)
    lettered = np.concatenate([[0], np.cumsum(_IS_LETTERED[buf], dtype=np.int64)])
    bare = np.diff(np.concatenate([[0], np.cumsum(lettered[w.ends] == lettered[w.starts])])[w.first])
    again = np.zeros(len(w), dtype=bool)
    again[1:] = w.hash[1:] == w.hash[:-1]
    again[w.first[:-1][w.counts > 0]] = False
    stutter = np.diff(np.concatenate([[0], np.cumsum(again)])[w.first])
    features = np.stack(
        [
            np.log1p(word_chars / words),
            np.sqrt(n_symbols / words),
            np.sqrt(n_dup / np.maximum(n_lines, 1)),
            np.sqrt(n_repeat / words),
            upper / np.maximum(upper + lower, 1),
            np.sqrt(_counts(_IS_SHOUT[buf], offs) / words),
            np.sqrt(bare / words),
            np.sqrt(stutter / words),
        ],
        axis=1,
    )
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat}, features


def _lines(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word: those equal to an earlier one, and all."""
    dup, lines = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        held = [x for x in raw[s:e].split(b"\n") if x and not x.isspace()]
        lines[i] = len(held)
        dup[i] = len(held) - len(set(held))
    return dup, lines


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), split value, left child (the right one follows), path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray
    expected: float

    @staticmethod
    def _average(n: float) -> float:
        """Mean path of an unsuccessful search among n points."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @classmethod
    def grow(cls, rows: np.ndarray, rng: np.random.Generator, depth: int) -> np.ndarray:
        """One tree over all rows given: of each node feature, split value, left child and path length."""
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rows, 0)]
        while todo:
            at, rows, level = todo.pop()
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if level >= depth or not len(spread):
                nodes[at] = [-1, 0.0, 0, level + cls._average(len(rows))]
                continue
            f = int(rng.choice(spread))
            value = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            below = rows[:, f] < value
            nodes[at] = [f, value, len(nodes), 0.0]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            todo += [(int(nodes[at][2]), rows[below], level + 1), (int(nodes[at][2]) + 1, rows[~below], level + 1)]
        return np.array(nodes)

    @classmethod
    def of(cls, grown: list[np.ndarray], sample: float) -> Forest:
        """Trees of about `sample` rows each."""
        a = np.zeros((len(grown), max(map(len, grown)), 4))
        a[:, :, 0] = -1
        for i, nodes in enumerate(grown):
            a[i, : len(nodes)] = nodes
        return cls(a[:, :, 0].astype(np.int16), a[:, :, 1], a[:, :, 2].astype(np.int32), a[:, :, 3], max(cls._average(sample), 1e-9))

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, sample: int = TREE_ROWS, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
        return cls.of([cls.grow(x[rng.choice(len(x), sample, replace=False)], rng, depth) for _ in range(trees)], sample)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1: 2 ** -(mean path / expected path)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, left, length in zip(self.feature, self.split, self.left, self.length, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= split[at]
                at = np.where(inner, left[at] + right, at)
            total += length[at]
        return 2.0 ** -(total / len(self.feature) / self.expected)


def with_background(good: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Good rows and a thin uniform background over the range of all labelled rows, so that splits
    also fall where good rows never are and what lies there is soon isolated."""
    return np.concatenate([good, rng.uniform(low, high, (max(1, int(BACKGROUND * len(good))), good.shape[1]))])


def threshold(cut: np.ndarray, good: np.ndarray, bad: np.ndarray, loss: float) -> float:
    """cut: bins that hold rows, ascending, with the numbers of good and bad rows in each. Of the cuts that at most
    `loss` of the good rows exceed, the one with the best balance of bad and good rejected, as a score."""
    lost, caught = 1 - np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    gain = np.where(np.cumsum(good) >= (1 - loss) * good.sum(), caught - 5 * lost, -np.inf)
    best = int(np.flatnonzero(gain == gain.max())[-1])
    upper = cut[best + 1] if best + 1 < len(cut) else cut[best] + 1
    return float((cut[best] + 1 + upper) / 2 / BINS)


@dataclass
class Judge:
    forest: Forest | None
    threshold: float

    def accept(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = self.forest.score(x) if self.forest is not None else np.zeros(len(x))
        return score <= self.threshold, score


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, STATS and features array<double>; narrow."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for part in chunks(batches, "t", 2 << 20):
            stats, x = statistics(part.column("t"))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([part.column("k"), *(pa.array(stats[s]) for s in STATS), lists], [key, *STATS, "features"])

    schema = f"`{key}` {kind}, " + ", ".join(f"{s} long" for s in STATS) + ", features array<double>"
    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), dtype=float).reshape(-1, len(FEATURES))


def _forest(labelled: DataFrame, n_good: int, low: np.ndarray, high: np.ndarray, seed: int = 7) -> Forest:
    """Every good row is in one tree at least, in more while trees would have less than their rows."""
    least = TREE_ROWS / (1 + BACKGROUND)
    copies = max(1, min(TREES, int(np.ceil(TREES * least / n_good))))

    def run(table: pa.Table) -> pa.Table:
        tree, good = table.column("tree")[0].as_py(), _matrix(table.column("features"))
        rng = np.random.default_rng([seed, tree])
        rows = with_background(good[np.lexsort(good.T)], low, high, rng)
        return pa.table({"tree": pa.array([tree], pa.int32()), "nodes": pa.array([Forest.grow(rows, rng, DEPTH).ravel()], pa.list_(pa.float64()))})

    dealt = labelled.where("good").select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "id", "features")
    dealt = dealt.select(F.pmod(F.xxhash64("id", "copy"), F.lit(TREES)).cast("int").alias("tree"), "features")
    # at most TREES trees of 2 ** (DEPTH + 1) nodes
    grown = dealt.groupBy("tree").applyInArrow(run, "tree int, nodes array<double>").toArrow().sort_by("tree")
    return Forest.of([np.asarray(x.values).reshape(-1, 4) for x in grown.column("nodes")], n_good * copies * (1 + BACKGROUND) / TREES)


def fit(docs: DataFrame, labels: DataFrame, loss: float = 0.004, key: str = "doc_id", text: str = "text") -> Judge:
    """Fitted on every labelled document that passes the base rules."""
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").alias("id"), F.col("quality")).where("id IS NOT NULL AND quality IS NOT NULL").groupBy("id").agg(F.min("quality").alias("quality"))
    measured = measure(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), "id").where(~base_failed())
    labelled = scratch.table(measured.join(marked, "id").select("id", (F.col("quality") == 1).alias("good"), "features"), "labelled-features")
    ends = [f(F.col("features")[i]) for f in (F.min, F.max) for i in range(len(FEATURES))]
    n_good, n_bad, *ends = labelled.agg(F.count_if("good"), F.count_if(~F.col("good")), *ends).first()
    if n_good < 8 or not n_bad:
        scratch.done_with(labelled)
        return Judge(None, float("inf"))
    forest = _forest(labelled, n_good, np.array(ends[: len(FEATURES)]), np.array(ends[len(FEATURES) :]))
    held = spark.sparkContext.broadcast(forest)

    def run(batches):
        for part in batches:
            if part.num_rows:
                cut = np.minimum(held.value.score(_matrix(part.column("features"))) * BINS, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cut), part.column("good")], ["cut", "good"])

    counts = labelled.select("good", "features").mapInArrow(run, "cut int, good boolean").groupBy("cut").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counts = counts.toArrow().sort_by("cut")  # at most BINS rows
    scratch.done_with(labelled)
    return Judge(forest, threshold(*(counts.column(c).to_numpy() for c in ("cut", "good", "bad")), loss))


def judge(docs: DataFrame, labels: DataFrame, loss: float = 0.004, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """Each row's key (and `columns`), STATS, base_failed, anomaly and kept. One narrow pass after the fit."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, loss, key=key, text=text))
    kinds = dict(docs.dtypes)
    carried = [key, *columns]

    def run(batches):
        for part in chunks(batches, "t", 2 << 20):
            stats, x = statistics(part.column("t"))
            fine, score = model.value.accept(x)
            failed = (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])
            yield pa.RecordBatch.from_arrays([*(part.column(f"c{i}") for i in range(len(carried))), *(pa.array(stats[s]) for s in STATS), pa.array(failed), pa.array(score), pa.array(~failed & fine)], [*(f"c{i}" for i in range(len(carried))), *STATS, "base_failed", "anomaly", "kept"])

    schema = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(carried)) + "".join(f", {s} long" for s in STATS) + ", base_failed boolean, anomaly double, kept boolean"
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *STATS, "base_failed", "anomaly", "kept")
