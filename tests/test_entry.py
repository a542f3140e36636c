"""Every registered query that has SQL gives the same rows as DuckDB on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry
from textmill.functions import scalar

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 130


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def same_as_sql(spark, con, name, folder):
    df = entry.queries()[name](spark, str(folder))
    rel = con.sql(entry.oracle_sql()[name])
    rows = [tuple(r[c] for c in rel.columns) for r in df.collect()]
    assert sorted(rows) == sorted(rel.fetchall())
    return rows


def test_tables_in_parts_are_listed_once(spark, tmp_path):
    for name in TABLES:
        if name in ("documents", "labels"):
            (tmp_path / f"{name}.parquet" / "lang=en").mkdir(parents=True)
            (tmp_path / f"{name}.parquet" / "part-0.parquet").write_bytes(b"x")
            (tmp_path / f"{name}.parquet" / "lang=en" / "part-0.parquet").write_bytes(b"x")
        else:
            (tmp_path / f"{name}.parquet").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"x")
    assert len(same_as_sql(spark, duckdb.connect(), "scan_walk", tmp_path)) == len(TABLES)
    same_as_sql(spark, duckdb.connect(), "scan_walk", f"file://{tmp_path}/")


@pytest.fixture
def capitals(spark, tmp_path):
    """Documents that begin with letters whose capitals are not one letter everywhere."""
    texts = ["straße ﬁn", "ǰ ŉ ΐ ᾳ ǆ և", "ß", "naïve ÿ ſ ა", "weiß nicht\nßß"]
    rows = [(100 * i + 3, t, "de", "web", len(t)) for i, t in enumerate(texts)] + [(i, texts[0], "de", "web", 9) for i in (4, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return con, tmp_path


def test_capitals_in_a_batch_of_documents(spark, capitals):
    assert len(same_as_sql(spark, capitals[0], "sink_batch_writer", capitals[1])) == 6


def test_capitals_of_a_replaced_document(spark, capitals):
    rows = same_as_sql(spark, capitals[0], "sink_replace_document", capitals[1])
    assert {"STRAẞE ﬁN", "ẞ", "WEIẞ NICHT"} <= {content for _, content in rows}


def test_capitals_of_all_characters(spark):
    text = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
    rows = [text[i : i + 9999] for i in range(0, len(text), 9999)]
    want = [duckdb.execute("SELECT upper(?)", [r]).fetchone()[0] for r in rows]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", scalar.upper("t").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == want


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want
