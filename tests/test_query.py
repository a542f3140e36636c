import pytest

from textmill.functions import tokens
from textmill.plans import query
from textmill.plans.query import Filters, Hints, chips, parse, size_bounds, split, without


def texts(raw):
    return [t.text for t in split(raw)]


def test_split():
    assert texts('a "b c" d\\e') == ["a", "b c", "d\\e"]
    assert texts('path:"D:\\x y" "open end') == ["path:D:\\x y", "open end"]
    assert texts(' "" ') == [] and texts("") == []


def test_filters():
    q = parse('report ext:pdf ext:DOCX path:"a b" after:2026-01-01 before:2026-13-01 size:>10KB nope:1')
    assert [t.text for t in q.terms] == ["report", "before:2026-13-01", "nope:1"]
    assert q.filters == Filters(".docx", "a b", 1767225600.0, None, 10241, None)
    assert parse("ext:").terms[0].text == "ext:"
    assert parse("ext:@sheet").filters.extensions() == (".@sheet",)
    assert Filters(extension="@slides").extensions()[0] == ".ppt"


@pytest.mark.parametrize(("raw", "bounds"), [(">1KB", (1025, None)), (">=1.5mb", (1572864, None)), ("<0", (None, 0)), ("<2B", (None, 1)), ("<=3", (None, 3)), ("7", (7, 7)), ("x", None), ("1TB", None)])
def test_sizes(raw, bounds):
    assert size_bounds(raw) == bounds


def test_hints_need_a_term():
    assert parse('x page:2 "slide:3" sheet:"a b"').hints == Hints(2, 3, "a b")
    q = parse("page:2 slide:0")
    assert q.hints == Hints(2) and q.plain == "slide:0"
    assert parse("page:2").plain == "page:2" and parse("page:2").hints == Hints()


def test_text_and_removal():
    assert parse('a "b c"').text == 'a "b c"'
    raw = 'a "b c" ext:pdf size:>=2KB size:<1MB after:2026-01-01 path:"x y"'
    assert without(raw, "size") == 'a "b c" ext:pdf path:"x y" after:2026-01-01'
    assert without(raw, "extension") == 'a "b c" path:"x y" after:2026-01-01 size:>=2048B size:<=1048575B'
    assert without("size:5KB x", "path") == "x size:5120B"


def test_chips():
    assert chips("x ext:pdf size:1KB") == [("extension", "类型 · PDF"), ("size", "大小 · 1 KB")]
    assert chips("size:>=1500 size:<=3MB before:2026-02-01") == [("before", "修改时间 < 2026-02-01"), ("size", "大小 · 1.5 KB ～ 3 MB")]
    assert chips("size:<=12") == [("size", "大小 ≤ 12 B")] and chips("x") == []
    assert query.format_size(5 << 40) == "5120 GB"


def test_lanes_and_phrases():
    assert parse('客户 "经 理"').lane == "cjk" and parse("客户 kyc").lane == "word" and parse("").lane == "word"
    assert parse('客户经理 "经 理"').phrases == [["客户", "户经", "经理"], ["经理"]]
    assert parse("Naïve-Word !!!").phrases == [["naive", "word"], []]
    assert tokens.query_bigrams("的 客户") == ["的", "客户"]
