import pytest
from pyspark.sql import functions as F

from textmill.functions import scalar
from textmill.sources import extract, formats, samples, views
from textmill.sources.store import NewerSchema, Store


def test_lines():
    assert list(extract.lines("a\r\nb\rc")) == [(0, "行 1-3", "a\nb\nc")]
    assert list(extract.lines("aaaa\nbb\n\ncc\n", 5)) == [(0, "行 1-1", "aaaa"), (1, "行 2-4", "bb\n\ncc")]
    assert list(extract.lines("")) == [] and list(extract.lines(" \n ")) == []


def test_decode():
    assert extract.decode("客户".encode("gb18030")) == "客户" and extract.decode("﻿é".encode()) == "é"
    assert extract.decode(b"a\xff\xff") == "a"


def test_html_and_xml():
    page = "<title>Doc</title><h1>Head</h1><p>One <i>two</i><br>three</p><style>x</style><div>four</div>"
    assert list(extract.html(page)) == [(0, "网页内容 1 · 标题 Head", "Doc\nHead\nOne two\nthree\nfour")]
    assert [c[1] for c in extract.html("<h2>A</h2><p>aaaaaaaa</p><p>b</p><h2>C</h2>", 5)] == ["网页内容 1 · 标题 A", "网页内容 2 · 标题 C"]
    assert list(extract.xml("<?xml version='1.0' encoding='gb2312'?><a k='v'><x:b>文本</x:b>&own;<c".encode("gb2312")))[0][2].split("\n")[:3] == ["v", "文本", "own"]


def test_docx():
    data = samples.docx([("Heading1", "Intro"), ("", "one"), [["a", "b"], ["", ""], ["c", ""]], ("Heading1", "Next"), ("", " ")])
    assert list(extract.docx(data)) == [(0, "文档块 1-4 · 标题 Intro", "Intro\none\na\tb\nc"), (1, "文档块 5-5 · 标题 Next", "Next")]


def test_xlsx():
    data = samples.xlsx({"S & T": [["a", None, "c", None], [], [1, 2.5]], "Empty": [], "U": [["x"]] * 3})
    assert list(extract.xlsx(data)) == [(0, "工作表 S & T · 行 1-3", "工作表: S & T\na\t\tc\n1\t2.5"), (1, "工作表 U · 行 1-3", "工作表: U\nx\nx\nx")]
    assert [c[1] for c in extract.xlsx(data, 2)][-2:] == ["工作表 U · 行 1-2", "工作表 U · 行 3-3"]


def test_pptx():
    assert list(extract.pptx(samples.pptx([("Risk", "body"), ("", ""), ("", "end")]))) == [(0, "幻灯片 1 · 标题 Risk", "Risk\nbody"), (1, "幻灯片 3", "end")]


def test_a_broken_file_does_not_touch_its_neighbours(spark):
    rows = [("/a/x.docx", b"no zip"), ("/a/y.txt", b"hello"), ("/a/z.pdf", b"%PDF"), ("/a/none", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r for r in extract.extract(files).collect()}
    assert got["/a/x.docx"].error_code == "BadZipFile" and got["/a/y.txt"].content == "hello"
    assert got["/a/z.pdf"].error_code == got["/a/none"].error_code == "AdapterUnavailable"
    more = {".pdf": lambda data: extract.flat(data.decode())}
    assert {r.path: r.location for r in extract.extract(files, more).collect()}["/a/z.pdf"] == "内容块 1"


def test_scan_and_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "sub" / "b.md").write_text("x" * 500)
    found = {r.path.rsplit("/", 1)[-1]: r.size for r in extract.scan(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": 3, "b.md": 500}
    small = extract.read(spark, str(tmp_path), 100)
    assert [r.path.rsplit("/", 1)[-1] for r in small.collect()] == ["a.txt"]
    assert "LessThanOrEqual(length,100)" in small._jdf.queryExecution().toString()


def test_patterns(spark):
    assert formats.normal_patterns([".log", "A*", "a*", " "]) == ["*.log", "A*"]
    for bad in ("*", "*.*", "a/b", "x" * 121, " "):
        with pytest.raises(formats.InvalidPattern):
            formats.normal_pattern(bad)
    assert formats.decode_patterns('[".tmp", "*", 5]') == ["*.tmp", "5"] and formats.decode_patterns("{") == []
    df = spark.createDataFrame([("/d/A.LOG",), ("/d/b[1].txt",), ("/log/c.txt",)], "path string")
    assert [r.path for r in df.where(formats.matches_glob("path", ["*.log", "b[[]?].*"])).collect()] == ["/d/A.LOG", "/d/b[1].txt"]
    assert df.where(formats.matches_glob("path", [])).count() == 0


def test_locations(spark):
    rows = [("pdf", "第 12 页"), ("presentation", "幻灯片 4"), ("spreadsheet", "工作表 客户 数据 · 行 1-20"), ("writer", "文档块 1-4 · 标题 X Y"), ("text", "内容块 1"), ("pdf", "行 1-2")]
    got = [r.s.asDict() for r in spark.createDataFrame(rows, "f string, l string").select(scalar.locator("f", "l").alias("s")).collect()]
    assert [g["kind"] for g in got] == ["page", "slide", "sheet_rows", "writer_block", "generic", "generic"]
    assert got[0]["page"] == 12 and got[1]["title"] is None and got[2]["sheet"] == "客户 数据" and got[2]["row_end"] == 20 and got[3]["title"] == "X Y"


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(scalar.retry_delay(F.lit("FAILED"), F.lit(3))) == 1200.0 and one(scalar.retry_delay(F.lit("TIMEOUT"), F.lit(99))) == 86400.0
    assert one(scalar.retry_delay(F.lit("INDEXED"), F.lit(3))) == 0.0
    assert one(scalar.format_size(F.lit(1536))) == "1.5 KB" and one(scalar.format_size(F.lit(-1))) == "0 B" and one(scalar.format_size(F.lit(3 << 40))) == "3.0 TB"
    assert one(scalar.clean_title(F.lit(" a\n b "))) == "a b" and one(scalar.clean_title(F.lit("x" * 90))) == "x" * 77 + "..."
    assert one(scalar.error_label(F.lit("new"))) == "new"


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.pointer() is None
    one = s.publish({"files": spark.range(3), "chunks": spark.range(5)})
    old = s.read("files")
    two = s.publish({"files": spark.range(4), "chunks": spark.range(5)})
    assert one != two and old.count() == 3 and s.read("files").count() == 4
    assert s.copy_to(f"file://{tmp_path}/other").read("chunks").count() == 5
    at = tmp_path / "store" / "_current.json"
    (tmp_path / "store" / "._current.json.crc").unlink(missing_ok=True)
    at.write_text(at.read_text().replace('"schema_version": 12', '"schema_version": 13'))
    with pytest.raises(NewerSchema):
        s.read("files")


def test_views_tell_large_ids_and_long_files_apart(spark, tmp_path):
    ids = [7, 1_000_002, 1_000_005, 1_000_010, 10_000_020, 10_000_050, 10_000_055]
    rows = [(i, "a\nb", "en", "s") for i in ids] + [(3, "x\n" * 100_002, "en", "s"), (4, "y", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert views.files(spark, str(tmp_path)).select("path").distinct().count() == len(rows)
    assert views.cjk(spark, str(tmp_path)).select("content").distinct().count() == len(rows)
    chunks = views.chunks(spark, str(tmp_path))
    assert chunks.select("chunk_id").distinct().count() == chunks.count() == 2 * len(ids) + 100_003
    names = {r.file_id: r.filename for r in views.files(spark, str(tmp_path)).collect()}
    assert names[7] == "doc_000007.xlsx" and names[1_000_002] == "doc_1000002.xlsx"
