"""The search engine against SQLite's FTS5 and against itself."""

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textmill.functions.snippet import snippet
from textmill.operators import index, legacy, match, rank
from textmill.plans.query import Hints, parse

CHUNK = "chunk_id long, file_id long, ordinal int, filename string, extension string, location string, content string"
FILE = "file_id long, path string, filename string, extension string, modified_time double, size long"


def make(n=60, seed=1):
    rng = random.Random(seed)
    pool = ["alpha", "beta", "Gamma", "délta", "report", "the", "of", "x_y", "42", "客户经理", "Ünïon"]
    files, chunks = [], []
    for i in range(n):
        name = f"{rng.choice(['report', 'alpha beta', 'notes'])}_{i:03d}.pdf"
        files.append((i, f"C:/docs/{name}", name, ".pdf", float(i % 7), 1000 + i))
        for o in range(rng.randint(1, 4)):
            text = " ".join(rng.choices(pool, k=rng.randint(1, 30)))
            chunks.append((i * 10 + o, i, o, name, ".pdf", f"第 {o + 1} 页", text))
    return files, chunks


@pytest.fixture(scope="module")
def data(spark):
    files, chunks = make()
    c = spark.createDataFrame(chunks, CHUNK)
    return files, chunks, spark.createDataFrame(files, FILE), c, index.tokenised(c).cache()


@pytest.fixture(scope="module")
def fts(data):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(filename, content, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, filename, content) VALUES (?, ?, ?)", [(c[0], c[3], c[6]) for c in data[1]])
    return con


@pytest.mark.parametrize("raw", ["alpha", "report", '"alpha beta"', "delta the", '"of the" 42', "x_y", "union report 42", "客户经理 the", "nothing", '"the the"'])
def test_bm25_equals_fts5(data, fts, raw):
    q = parse(raw)
    expression = " AND ".join('"' + t.text.replace('"', '""') + '"' for t in q.terms)
    want = dict(fts.execute("SELECT rowid, bm25(t, 5.0, 1.0) FROM t WHERE t MATCH ?", (expression,)))
    tok = data[4]
    scans = {r.chunk_id: r.score for r in match.scan_scores(tok, q.phrases).collect()}
    posts = index.postings(data[3])
    joins = {r.chunk_id: r.score for r in match.index_scores(posts, index.corpus_stats(tok), q.phrases).collect()}
    assert scans.keys() == want.keys() == joins.keys()
    assert all(scans[k] == pytest.approx(want[k], abs=1e-9) and joins[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_empty_phrase_matches_nothing(data):
    assert match.scan_scores(data[4], parse("alpha !!!").phrases).count() == 0
    assert match.scan_scores(data[4], []).count() == 0


def test_engines_agree(data):
    q = parse("alpha the size:>=1010")
    names = lambda df: sorted((r.file_id, round(r.relevance_score, 9)) for r in df.collect())
    window = names(rank.search_windowed(data[4], data[2], q))
    assert window == names(rank.search_prefiltered(data[4], data[2], q))
    assert {f for f, _ in window} == {r.file_id for r in rank.file_hits(data[4], data[2], q).collect()}
    for most in (8, 32, 500):
        top = rank.search_progressive(data[4], data[2], q, limit=5, multiplier=1, most=most).collect()
        assert len({r.candidates_scanned for r in top}) == 1 and (len(top) == 5 or top[0].exhausted or most == 8)


@pytest.mark.parametrize("sort", rank.SORTS)
def test_pages_have_no_gaps(data, sort):
    found = rank.file_hits(data[4], data[2], parse("the")).cache()
    whole = [r.file_id for r in rank.page(found, sort, 500).orderBy("rank").collect()]
    parts = [r.file_id for at in range(0, len(whole) + 7, 7) for r in rank.page(found, sort, 7, at).orderBy("rank").collect()]
    assert parts == whole and len(set(whole)) == len(whole) > 7


def test_pages_of_the_stored_index_have_no_gaps(data, tmp_path):
    held = index.write(data[3], f"{tmp_path}/p")
    found = rank.file_hits(held, data[2], parse("the"))
    whole = [r.file_id for r in rank.page(found, "relevance", 500).orderBy("rank").collect()]
    parts = [r.file_id for at in range(0, len(whole) + 20, 20) for r in rank.page(found, "relevance", 20, at).orderBy("rank").collect()]
    assert parts == whole and len(whole) > 20
    assert rank.with_total(rank.page(found, "relevance", 20, 20), found).first().total_count == len(whole)


def test_browse_counts_only_where_it_must(data):
    files, q = data[2], parse("size:>=1010")
    for limit, offset in ((10, 0), (100, 0), (100, 20), (10, 500), (25, 25)):
        top, total = rank.browse(files, q, limit=limit, offset=offset)
        assert total == 50 and top.count() == max(0, min(limit, 50 - offset))
    assert rank.browse(files, parse("ext:none"))[1] == 0


def test_unknown_sort():
    with pytest.raises(ValueError, match="unsupported"):
        rank.order_by("size")


def test_boosts(spark):
    rows = [(1, "第 2 页"), (2, "幻灯片 3 · 标题 Risk plan"), (3, "幻灯片 31"), (4, "工作表 My Sheet · 行 1-20"), (5, "行 1-2")]
    df = spark.createDataFrame(rows, "id int, location string").withColumn("filename", F.lit("Risk_Plan.docx")).withColumn("extension", F.lit(".docx"))
    got = lambda c: {r.id: r.b for r in df.select("id", c.alias("b")).where("b <> 0").collect()}
    assert got(rank.page_boost(2)) == {1: -3.0} and got(rank.slide_boost(3)) == {2: -3.0}
    assert got(rank.sheet_boost("my sheet")) == {4: -2.5} and got(rank.sheet_boost("m%")) == {4: -2.5}
    assert got(rank.location_boost("risk plan")) == {2: -1.25} and got(rank.location_boost("plan risk")) == {2: -0.9}
    assert got(rank.location_boost("")) == {}
    one = lambda raw: df.select(rank.filename_boost(raw).alias("b")).first().b
    assert [one(x) for x in ("RISK_PLAN", "risk%pl", "plan", "zz", "risk|")] == [-8.0, -4.0, -2.0, 0.0, 0.0]
    assert [spark.range(1).select(rank.evidence_boost(F.lit(n)).alias("b")).first().b for n in (1, 2, 3, 9)] == [0.0, -0.12, -0.24, -0.24]


def test_hints_on_the_driver():
    one = lambda place, **h: rank.hint_score(place, Hints(**h))
    assert one("第 2 页", page=2) == -3 and one("第 12 页", page=2) == 0 and one("幻灯片 3", slide=3) == -3 and one("幻灯片 3 · 标题 x", slide=3) == 0
    assert one("工作表 My Sheet · 行 1-2", sheet="my sheet", page=1) == -2.5 and one("工作表 My · 行 1-2", sheet="m%") == 0 and one("第 2 页") == 0


def test_file_boosts_do_not_change_the_best_chunk(data):
    q = parse("report")
    best = {r.file_id: r.chunk_id for r in rank.best_chunks(rank.chunk_hits(data[4], q)).collect()}
    assert best == {r.file_id: r.chunk_id for r in rank.file_hits(data[4], data[2], q).collect()}


def test_document_hits(data):
    hits = rank.document_hits(data[4], parse("the"), 3, limit=2)
    assert hits.count() <= 3 and [r.ordinal for r in hits.collect()] == sorted(r.ordinal for r in hits.collect())


def test_snippets(spark):
    text = "x" * 100 + "\nAlpha beta" + "y" * 100
    say = lambda t, terms: spark.createDataFrame([(t,)], "c string").select(snippet("c", terms).alias("s")).first().s
    assert say(text, ["alpha"]) == "… " + "x" * 51 + " [[HIT]]Alpha[[/HIT]] beta" + "y" * 47 + " …"
    assert say("a\nb", ["zz"]) == "a b" and say("Beta alphabet", ["alpha", "alphabet"]) == "Beta [[HIT]]alphabet[[/HIT]]"


def test_cjk(spark):
    rows = [(1, 1, 0, "f", ".txt", "", "客户，户经营"), (2, 2, 0, "f", ".txt", "", "客户经理"), (3, 3, 0, "f", ".txt", "", "客 户 经"), (4, 4, 0, "f", ".txt", "", "客户 经理")]
    tok = index.tokenised(spark.createDataFrame(rows, CHUNK), "cjk")
    found = lambda raw: sorted(r.chunk_id for r in match.scan_scores(tok, parse(raw).phrases).collect())
    assert found("客户经") == [1, 2] and found("客户经理") == [2] and found("客") == [3] and found("经理") == [2, 4]


def test_index_on_disk(data, tmp_path, spark):
    held = index.write(data[3], f"{tmp_path}/i")
    posts = held.postings
    for raw in ('"alpha beta"', "the", "alpha report", '"of the" 42', '"the the" the', "nothing", "alpha !!!"):
        q = parse(raw)
        a = {(r.chunk_id, round(r.score, 9)) for r in match.scores(held, q.phrases).collect()}
        assert a == {(r.chunk_id, round(r.score, 9)) for r in match.scan_scores(data[4], q.phrases).collect()}, raw
        names = lambda df: sorted((r.file_id, round(r.relevance_score, 9), r.rank) for r in df.collect())
        assert names(rank.page(rank.file_hits(held, data[2], q))) == names(rank.page(rank.file_hits(data[4], data[2], q)))
        shown = lambda df: [(r.chunk_id, r.ordinal) for r in df.collect()]
        assert shown(rank.document_hits(held, q, 3)) == shown(rank.document_hits(data[4], q, 3))
    plan = posts.where(F.col("term").isin("alpha"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [alpha])]" in plan or "EqualTo(term,alpha)" in plan


@pytest.mark.parametrize("raw", ["客户经理", "户经 理", "客户经 alpha", "x客户", "户经理 客户经理.", "经理", "客", "的 客", "alpha report", '"alpha beta"', "客a"])
def test_legacy_files_equal_fts5(spark, raw):
    files = make(40)[0]
    rng = random.Random(5)
    pool = ["alpha", "Beta", "客户经理", "客户", "客", "户经理，", "经理", "X客户", "的", "客户客户经理."]
    rows = [(f[0], f[2] if f[0] % 9 else f"客户经理_{f[0]}.pdf", f[4], " \n"[f[0] % 2].join(rng.choices(pool, k=rng.randint(1, 9)) * (1 if f[0] % 5 else 0))) for f in files] + [(99, "empty.txt", 0.0, None)]
    con = sqlite3.connect(":memory:")
    lane, terms = legacy.lane_of(raw)
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(filename, content, tokenize='{dict(trigram='trigram case_sensitive 0', cjk='unicode61', word='unicode61 remove_diacritics 2')[lane]}')")
    pairs = lambda x: " ".join(r if len(r) == 1 else " ".join(r[i : i + 2] for i in range(len(r) - 1)) for r in re.findall("[㐀-䶿一-鿿]+", x))
    con.executemany("INSERT INTO t(rowid, filename, content) VALUES (?, ?, ?)", [(i, *(map(pairs, (n, c or "")) if lane == "cjk" else (n, c or ""))) for i, n, _, c in rows])
    want = dict(con.execute("SELECT rowid, bm25(t, 5.0, 1.0) FROM t WHERE t MATCH ?", (" AND ".join('"' + t.replace('"', '""') + '"' for t in terms),)))
    hits = legacy.search(spark.createDataFrame(rows, "file_id long, filename string, modified_time double, content string"), raw)
    got = {r.file_id: r for r in hits.collect()}
    assert got.keys() == want.keys() and all(got[k].score == pytest.approx(want[k], abs=1e-9) for k in want)
    inside = [r for r in got.values() if lane != "word" and len(terms) == 1 and terms[0] in (dict((i, c) for i, _, _, c in rows)[r.file_id] or "")]
    assert all(f"[[HIT]]{terms[0]}[[/HIT]]" in r.snippet for r in inside)
    assert [r.file_id for r in legacy.page(hits, 3).collect()] == [r.file_id for r in sorted(got.values(), key=lambda r: (r.score, -r.modified_time, r.file_id))[:3]]


def test_legacy_queries(spark):
    found = entry.queries()
    for name in ("legacy_search_file", "legacy_search_trigram", "legacy_search_cjk_short"):
        assert "snippet" in found[name](spark, "/root/testdata/sf0.001").columns
