"""Operators 1, 3, 5, 7, 9, 10 and the pipeline, against brute force on small tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textmill.llm import decontaminate, exchange, graph, interpolation, jaccard, quality, rules, substrings

from .helpers import FOLD, corpus, low_words, odd_rows, table, words


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).cache()


# -- 1


def fold(n):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def test_scores(spark, rows, docs):
    import zlib

    got = {r.doc_id: r for r in interpolation.score(docs, fold(7) != 2, fold(7) == 2).collect()}
    assert len(got) == len(rows)
    end = object()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(t for i, x, *_ in rows if not held(i) for t in [*low_words(x), end])
    n, v = sum(count.values()), len(count)
    for i, x, *_ in rows:
        said = [*low_words(x), end]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(said), sum(count[t] > 0 for t in said), n, held(i))
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in said))
        assert -1e9 < r.score <= 0


def test_mixture_is_a_distribution_and_learns(spark):
    w = interpolation.Weights()
    f = np.array([0.5, 0.25, 0.0])
    one = np.array([0.5, 0.3, 0.2])
    k = np.full(3, 2)
    total = w.mix(one, np.array([0.5, 0.5, 0]), np.array([1.0, 0, 0]), k, k, 0.25).sum() + (1 - w.two[2]) * (1 - w.three[2]) * (1 - w.one) * 0.25
    assert total == pytest.approx(1.0)
    def learned(f3):
        rows = [tuple(x.astype(np.float64).tobytes() for x in (one, f, f3)) + (k.astype(np.uint8).tobytes(),) * 2]
        return interpolation.Weights.learn(spark.createDataFrame(rows * 10, "f1 binary, f2 binary, f3 binary, k1 binary, k2 binary"), 0.25)

    sharp, flat = learned(np.full(3, 0.9)), learned(np.zeros(3))
    assert sharp.three[2] > 0.9 > 0.1 > flat.three[2] and sharp.three[0] == 0


def brute_interpolation(rows, learned_from, w):
    """Scores by plain counting, with given weights."""
    end, begin = object(), object()
    said = {i: [*low_words(t), end] for i, t, *_ in rows}
    one, two, three, c1, c2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, x in said.items():
        if learned_from(i):
            past = [begin, begin, *x]
            for p, q, r in zip(past, past[1:], past[2:], strict=False):
                one[r] += 1
                two[q, r] += 1
                three[p, q, r] += 1
                c1[q] += 1
                c2[p, q] += 1
    n, unseen = sum(one.values()), 1 / (len(one) + 1)
    bucket = lambda c: min(1 + int(math.log2(c)), interpolation.BUCKETS - 1) if c else 0
    out = {}
    for i, x in said.items():
        past, total = [begin, begin, *x], 0.0
        for p, q, r in zip(past, past[1:], past[2:], strict=False):
            p1 = w.one * one[r] / n + (1 - w.one) * unseen
            b, c = w.two[bucket(c1[q])], w.three[bucket(c2[p, q])]
            p2 = b * (two[q, r] / c1[q] if c1[q] else 0) + (1 - b) * p1
            total += math.log10(c * (three[p, q, r] / c2[p, q] if c2[p, q] else 0) + (1 - c) * p2)
        out[i] = total
    return out


def test_scores_are_those_of_the_mixture(rows, docs, monkeypatch):
    import zlib

    learned, plain = [], interpolation.Weights.learn
    monkeypatch.setattr(interpolation.Weights, "learn", lambda *a: learned.append(plain(*a)) or learned[0])
    got = {r.doc_id: r.score for r in interpolation.score(docs, fold(7) != 2, fold(7) == 2).collect()}
    want = brute_interpolation(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, learned[0])
    assert got == pytest.approx(want)
    assert 0 < learned[0].one < 1 and (learned[0].three[1:3] > 0).all()


def test_messages_grow_with_the_data(spark, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(exchange, "block_bytes", lambda spark: 3000)
    rng = random.Random(9)
    seen = []
    for n in (40, 160):
        rows = [(i, " ".join(f"w{rng.randint(0, 300)}" for _ in range(80)), "", "", 0) for i in range(n)]
        blocks = exchange.blocks(table(spark, rows).selectExpr("doc_id AS k", "text AS t", "false AS lane").coalesce(2), "blocks", "long")
        buckets, size = exchange.buckets_of(blocks)
        assert blocks.count() >= size // 3000 and buckets == -(-size // 3000)
        asked = jaccard._asked(blocks, buckets, 40)
        keys = sum(len(exchange.unpack(r.keys)) for r in asked.collect())
        seen.append((asked.count(), keys))
        assert seen[-1][0] <= keys
    assert seen[1][1] <= 4.4 * seen[0][1]


def test_scores_of_odd_and_no_rows(spark):
    yes = F.lit(True)
    assert interpolation.score(table(spark, []), yes, ~yes).count() == 0
    got = interpolation.score(table(spark, odd_rows()), F.col("doc_id") > 0, F.col("doc_id") == 9).collect()
    assert len(got) == 6 and sum(r.n_tokens for r in got) == 80 * 4 + 60 + 6
    assert all(r.train_tokens == 81 * 3 + 61 for r in got)
    none = interpolation.score(table(spark, odd_rows()), F.lit(False), F.lit(True)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in none)


# -- 3


def brute_spans(rows, length):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - length + 1):
            key = tuple(w[j : j + length])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - length + 1):
            if i is not None and first[tuple(w[j : j + length])] < i:
                gone.update(range(j, j + length))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [50, 12])
def test_substring_dedup(rows, docs, length):
    got = substrings.digest(docs, length).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_spans(rows, length)


def test_substring_dedup_of_many_overlaps(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(40):
        a, b = sorted(rng.sample(range(400), 2))
        rows.append((i, " ".join([*(f"u{i}_{k}" for k in range(rng.randint(0, 60))), *base[a:b], f"v{i}", *base[: rng.randint(0, 120)], *base[: rng.randint(0, 120)]]), "", "", 0))
    got = substrings.digest(table(spark, rows), 50).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_spans(rows, 50)


def test_substring_dedup_with_repeated_ids(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(300)]
    cut = lambda: " ".join([f"u{rng.random()}", *base[(a := rng.randint(0, 200)) : a + rng.randint(55, 100)], "v"])
    rows = [(i // 3, cut(), "", "", 0) for i in range(30)] + [(2, "short", "", "", 0), (None, " ".join(base), "", "", 0)]
    got = substrings.digest(table(spark, rows), 50).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_spans(rows, 50)


def test_substring_dedup_keeps_rows_and_columns(spark, docs, rows):
    out = substrings.removed(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    digest = {r.doc_id: r.kept_sha256 for r in substrings.digest(docs).collect()}
    for r in out.collect():
        assert hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest() == digest[r.doc_id]
    odd = sorted(((r.doc_id, r.n_removed) for r in substrings.digest(table(spark, odd_rows())).collect()), key=str)
    assert odd == [(5, 0), (5, 0), (5, 0), (9, 80), (None, 0), (None, 0)]
    assert substrings.digest(table(spark, [])).count() == 0


# -- 5


def brute_sets(t):
    w = low_words(t)
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [brute_sets(t) for _, t, *_ in rows]
    name = {i: i for i, *_ in rows if i is not None}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for p in range(len(rows)):
        for q in range(p):
            a, b = sets[p], sets[q]
            if a and b and rows[p][0] is not None and rows[q][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(rows[p][0]), root(rows[q][0])))
                name[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None) for (i, *_), s in zip(rows, sets, strict=True)), key=str)


def test_components(rows, docs):
    got = jaccard.join(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_components_of_a_dense_group(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        text = list(base)
        for k in rng.sample(range(150), rng.randint(0, 9)):
            text[k] = rng.choice(["x", "y", f"z{i}"])
        rows.append((i, " ".join(text[rng.randint(0, 12) : 150 - rng.randint(0, 12)]), "", "", 0))
    got = jaccard.join(table(spark, rows)).collect()
    want = brute_components(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert 1 < len({c for _, _, c in want}) < 90


def test_components_of_odd_and_no_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(table(spark, odd_rows())).collect()), key=str)
    assert [g[0] for g in got] == [5, 5, 5, 9, None, None] and got[3][2] == 5
    assert {g[2] for g in got if g[0] is None} == {None}
    assert jaccard.join(table(spark, [])).count() == 0
    assert jaccard.representatives(table(spark, [])).count() == 0


def test_representatives(rows, docs):
    want = sorted(i for i, _, c in brute_components(rows) if i == c)
    got = jaccard.representatives(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.select("doc_id").collect()) == want


def test_graph(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 7


def brute_stats(t):
    w, seen, dup = words(t), set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
    count, twice = Counter(windows), set()
    for j, x in enumerate(windows):
        if count[x] > 1:
            twice.update(range(j, j + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(twice)


def labelled(spark, rows):
    return spark.createDataFrame([(i, 0 if "zz" in (t or "") else 1, 0) for i, t, *_ in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def junk(n, at=1000):
    rng = random.Random(2)
    return [(at + i, " ".join(f"zz{rng.randint(0, 500)}{rng.choice('#*$%')*3}" for _ in range(60)), "en", "s", 0) for i in range(n)]


def test_rules(spark, rows):
    every = rows + junk(20)
    got = {r.doc_id: r for r in rules.judge(table(spark, every), labelled(spark, every), loss=0.0).collect()}
    for i, t, *_ in every:
        r, want = got[i], brute_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    good = [r for i, r in got.items() if i < 1000 and not r.base_failed]
    assert all(r.kept for r in good)
    assert sum(got[i].kept for i in range(1000, 1020)) <= 2


def test_rules_without_labels_or_rows(spark, rows):
    none = labelled(spark, []).where("quality = 5")
    got = rules.judge(table(spark, odd_rows()), none).collect()
    assert len(got) == 6 and all(r.kept != r.base_failed for r in got)
    assert rules.judge(table(spark, []), labelled(spark, rows)).count() == 0


def test_every_labelled_row_is_learned_from(spark):
    """The one bad row has the greatest hash of more than 20,000 ids."""
    n = 20_050
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 24), i -> concat('w', i, 'x', id % 9))) AS text")
    last = spark.range(n).selectExpr("id", "xxhash64(id) AS h").orderBy("h", "id").tail(1)[0].id
    judge = rules.fit(docs, spark.range(n).selectExpr("id AS doc_id", f"CAST(id <> {last} AS INT) AS quality"))
    assert judge.forest is not None and judge.threshold < 1


def test_threshold_is_the_best_of_all_cuts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        cut = np.sort(rng.choice(rules.BINS, 12, replace=False))
        good, bad = rng.integers(0, 9, 12) + 1, rng.integers(0, 9, 12)
        bad[-1] += 1
        loss = float(rng.choice([0, 0.1, 0.5]))
        at = rules.threshold(cut, good, bad, loss)
        gain = [(bad[i + 1 :].sum() / bad.sum() - 5 * good[i + 1 :].sum() / good.sum(), i) for i in range(12) if good[i + 1 :].sum() <= loss * good.sum()]
        best = max(g for g, _ in gain)
        kept = int((cut < at * rules.BINS).sum()) - 1
        assert any(i == kept and abs(g - best) < 1e-12 for g, i in gain)


def test_forest_finds_the_odd_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    score = rules.Forest.fit(x).score(np.array([[0, 0, 0], [9, 9, 9]]))
    assert score[1] > 0.6 > 0.5 > score[0]


def path_length(nodes, row):
    """One row's path through one tree, node by node."""
    feature, split, left, length = nodes
    at = 0
    while feature[at] >= 0:
        at = left[at] + (row[feature[at]] >= split[at])
    return length[at]


def test_forest_scores_are_those_of_the_paths(spark, rows):
    every = rows + junk(20)
    docs, labels = table(spark, every), labelled(spark, every)
    judge = rules.fit(docs, labels, loss=0.0)
    forest = judge.forest
    import pyarrow as pa

    stats, x = rules.statistics(pa.array([t for _, t, *_ in every], pa.string()))
    trees = list(zip(forest.feature, forest.split, forest.left, forest.length, strict=True))
    want = {}
    for (i, *_), n, repeat, row in zip(every, stats["n_words"], stats["n_repeat_words"], x, strict=True):
        mean = sum(path_length(t, row) for t in trees) / len(trees)
        score = 2.0 ** -(mean / forest.expected)
        failed = n < 20 or 100 * repeat > 30 * n
        want[i] = (pytest.approx(score), bool(not failed and score <= judge.threshold))
    got = {r.doc_id: (r.anomaly, r.kept) for r in rules.judge(docs, labels, loss=0.0).collect()}
    assert got == want and len({k for _, k in got.values()}) == 2


def test_forest_path_lengths_count_splits_and_leaf_sizes():
    """Each leaf's length is its depth and the mean path among the rows that fell into it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(64, 2))
    forest = rules.Forest.fit(x, trees=5, sample=64)
    for feature, split, left, length in zip(forest.feature, forest.split, forest.left, forest.length, strict=True):
        todo = [(0, x, 0)]
        while todo:
            at, held, depth = todo.pop()
            if feature[at] < 0:
                n = len(held)
                assert length[at] == pytest.approx(depth + (0 if n <= 1 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n))
            else:
                below = held[:, feature[at]] < split[at]
                todo += [(left[at], held[below], depth + 1), (left[at] + 1, held[~below], depth + 1)]


# -- 9


def test_classifier(spark, rows):
    every = [r for r in rows if len(words(r[1])) > 10] + junk(60)
    docs, labels = table(spark, every), labelled(spark, every)
    weights = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    assert len(got) == len(every) and all(0 <= s <= 1 for s in got.values())
    held = [(i, s) for i, s in got.items() if i % 3 == 0]
    assert sum((s >= 0.5) == (i < 1000) for i, s in held) >= 0.95 * len(held)
    again = quality.fit(docs.repartition(7), labels.where("doc_id % 3 <> 0"))
    assert (again == weights).all()


def test_weights_are_those_of_a_plain_loop(spark, rows):
    """Follow the regularised leader, coordinate by coordinate, over the same rows in the same order."""
    import pyarrow as pa

    every = [r for r in rows if len(words(r[1])) > 10][:25] + junk(15)
    docs, labels = table(spark, every), labelled(spark, every)
    bits = 12
    sample = docs.join(labels.select(F.col("doc_id").alias("d"), F.col("quality").alias("y")), F.col("doc_id") == F.col("d")).where("y IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("t"), "y")
    ordered = sample.orderBy(F.xxhash64("id", F.lit("order")), "id").collect()
    made = quality.Ftrl(bits)
    z, n = {}, {}

    def weight(j):
        s = z.get(j, 0.0)
        return 0.0 if abs(s) <= made.l1 else -(s - math.copysign(made.l1, s)) / ((made.beta + math.sqrt(n.get(j, 0.0))) / made.alpha + made.l2)

    for _ in range(2):
        for r in ordered:
            numbers, _ = quality.features(pa.array([r.t]), bits)
            value = {j: math.log1p(c) for j, c in Counter(numbers.tolist()).items()}
            norm = math.sqrt(sum(v * v for v in value.values()))
            value = {j: v / norm for j, v in value.items()} | {1 << bits: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(j) * v for j, v in value.items())))
            step = {j: (p - r.y) * v for j, v in value.items()}
            for j, g in step.items():
                sigma = (math.sqrt(n.get(j, 0.0) + g * g) - math.sqrt(n.get(j, 0.0))) / made.alpha
                z[j], n[j] = z.get(j, 0.0) + g - sigma * weight(j), n.get(j, 0.0) + g * g
    got = quality.train(sample, passes=2, bits=bits)
    assert got == pytest.approx([weight(j) for j in range((1 << bits) + 1)], abs=1e-5) and np.count_nonzero(got) > 100
    scored = {r.doc_id: r.score for r in quality.score(docs, got, bits).collect()}
    for i, t, *_ in every[::7]:
        numbers, _ = quality.features(pa.array([t]), bits)
        value = {j: math.log1p(c) for j, c in Counter(numbers.tolist()).items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-sum(got[j] * v / norm for j, v in value.items()) - got[1 << bits])), abs=1e-5)


def test_the_fit_is_bounded_in_bytes(spark, rows, monkeypatch):
    every = [r for r in rows if len(words(r[1])) > 10] + junk(60)
    docs, labels = table(spark, every), labelled(spark, every)
    whole = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "FIT_BYTES", 3000)
    part = quality.fit(docs, labels)
    assert 0 < np.count_nonzero(part) < np.count_nonzero(whole) / 2
    monkeypatch.setattr(quality, "FIT_TEXT", 0)
    assert not quality.fit(docs, labels).any()


def test_classifier_of_odd_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = table(spark, odd_rows())
    got = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(got) == 6 and all(r.score == 0.5 for r in got)
    assert quality.score(table(spark, []), quality.fit(docs, none)).count() == 0


# -- 10


def brute_contained(rows, items):
    out = []
    for i, t, *_ in rows:
        w = low_words(t)
        for k, x in items:
            v = low_words(x)
            n = min(5, len(v))
            if v:
                want = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
                found = len(want & {tuple(w[j : j + n]) for j in range(len(w) - n + 1)})
                if 100 * found >= 80 * len(want):
                    out.append((i, k, len(want), found))
    return sorted(out, key=str)


def test_decontamination(spark, rows, docs):
    rng = random.Random(4)
    long = [r[1] for r in rows if len(words(r[1])) > 60]
    items = []
    for k in range(30):
        w = words(rng.choice(long))
        at = rng.randint(0, len(w) - 45)
        part = w[at : at + rng.randint(5, 45)]
        for _ in range(k % 4):
            part[rng.randrange(len(part))] = "changed"
        items.append((k, " ".join(part).translate({v: k for k, v in FOLD.items()})))
    items += [(40, "Two words"), (41, "word"), (42, ""), (43, None), (44, "a b c d"), (0, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(docs, bench).collect()
    want = brute_contained(rows, items)
    assert sorted(((r.doc_id, r.item_id, r.n_item_shingles, r.n_found) for r in got), key=str) == want and len(want) > 20
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({r[0] for r in rows} - {w[0] for w in want})


def test_a_large_benchmark_stays_distributed(spark, rows, docs, monkeypatch):
    rng = random.Random(8)
    long = [words(r[1]) for r in rows if len(words(r[1])) > 60]
    items = [(k, " ".join((w := rng.choice(long))[(at := rng.randint(0, len(w) - 45)) : at + rng.randint(2, 45)])) for k in range(40)]
    items += [(99, "Two words"), (98, ""), (97, None), (0, items[0][1]), (0, "other words of one id"), (0, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    odd = table(spark, [*rows, *odd_rows(), rows[3], rows[3]])
    want = [sorted(map(str, decontaminate.find(d, bench).collect())) for d in (docs, odd)]
    kept = sorted(map(str, decontaminate.clean(odd, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 2000)
    assert [sorted(map(str, decontaminate.find(d, bench).collect())) for d in (docs, odd)] == want and len(want[0]) > 40
    assert sorted(map(str, decontaminate.clean(odd, bench).collect())) == kept
    assert decontaminate.find(table(spark, []), bench).count() == 0


def test_decontamination_of_no_rows(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs, none).count() == 0
    assert decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.find(table(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# -- the pipeline


def test_pipeline(spark, rows, tmp_path):
    every = rows + junk(20)
    docs = table(spark, every, extra=False)
    item = " ".join(words(every[12][1])[:30])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, every).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    judged = rules.judge(docs, labelled(spark, every)).where("kept").select("doc_id").collect()
    kept = [r for r in every if r[0] in {x.doc_id for x in judged}]
    leaders = {i for i, _, c in brute_components(kept) if i == c}
    kept = [r for r in kept if r[0] in leaders]
    digests = {i: (n, gone) for i, n, gone, _ in brute_spans(kept, 50)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) <= leaders
    stage = spark.createDataFrame(kept, docs.schema)
    for name, f in corpus_pipeline.STAGES[2:]:
        before, stage = stage, f(spark, stage, str(tmp_path))
        if name != "byte-level BPE":
            assert stage.columns == before.columns
        if name == "substring dedup":
            after = {r.doc_id: r for r in stage.collect()}
            assert {i: len(words(r.text)) for i, r in after.items()} == {i: n - gone for i, (n, gone) in digests.items()}
            assert all(r.n_chars == len(r.text or "") for r in after.values() if r.text is not None)
            leaks = {i for i, *_ in brute_contained([(r.doc_id, r.text) for r in after.values()], [(1, item)])}
    assert leaks and set(got) == leaders - leaks
    assert {r.doc_id: r.ids_sha256 for r in stage.collect()} == {i: r.ids_sha256 for i, r in got.items()}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def thue_morse(order):
    """Two texts that collide under any polynomial hash modulo 2 ** 64, as letters and as words."""
    x = "a"
    for _ in range(order):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_texts_made_to_collide_are_told_apart(spark):
    letters, said = thue_morse(10), [" ".join(x) for x in thue_morse(11)]
    tail = [f"t{i}" for i in range(30)]
    rows = [(i, " ".join([x, *tail]), "", "", 0) for i, x in enumerate(letters)] + [(10 + i, x, "", "", 0) for i, x in enumerate(said)]
    docs = table(spark, rows)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(docs).collect()), key=str) == brute_spans(rows, 50)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()), key=str) == brute_components(rows)
    got = {r.doc_id: r for r in interpolation.score(docs, F.lit(True), F.lit(False)).collect()}
    count = Counter(x for _, t, *_ in rows for x in words(t))
    n = sum(count.values()) + len(rows)
    for i, t, *_ in rows:
        assert got[i].base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + len(count) + 1 + 1)) for x in words(t)) + math.log10((len(rows) + 1) / (n + len(count) + 1 + 1)))
    bench = spark.createDataFrame([(0, letters[0]), (1, letters[1])], "item_id long, text string")
    alone = table(spark, [(i, x, "", "", 0) for i, x in enumerate(letters)])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(alone, bench).collect()) == [(0, 0), (1, 1)]
    twice = spark.createDataFrame([(0, "\n".join(letters), "", "", 0)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert rules.measure(twice).first().n_dup_lines == 0


def test_base_figures_equal_sql(spark, rows, tmp_path):
    import duckdb

    from textmill.llm import catalog

    table(spark, [r for r in rows if r[0] is not None], extra=False).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    labelled(spark, rows).write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("base_scores", "rule_statistics"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        rel = con.sql(catalog.ORACLE[name])
        assert sorted(got.columns) == sorted(rel.columns)
        at = [rel.columns.index(c) for c in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
