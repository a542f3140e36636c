"""What is driven from outside: isolated readers, binary and open sheets, watchers, superseded searches, the store."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from textmill.functions import codec
from textmill.operators import lifecycle
from textmill.plans.query import state_label
from textmill.plans.session import Searches
from textmill.sources import extract, formats, isolate, samples
from textmill.sources.store import Store
from textmill.streaming import watch

LIMITS = isolate.Limits(whole=3.0, stall=1.0)


def hangs(data):
    yield (0, "a", "half")
    time.sleep(60)


def dies(data):
    os._exit(3)


def fails(data):
    yield (0, "a", "half")
    raise KeyError("no")


def reads(data):
    yield (0, "x", data.decode())


def test_cascade_takes_the_next_reader():
    begun = time.monotonic()
    assert list(isolate.cascade([hangs, dies, fails, reads], b"text", LIMITS)) == [(0, "x", "text")]
    assert time.monotonic() - begun < 10
    for read, name in ((hangs, "LegacyExtractionTimeout"), (dies, "ParserDied"), (fails, "KeyError")):
        with pytest.raises(Exception) as e:
            list(isolate.cascade([read], b"", LIMITS))
        assert type(e.value).__name__ == name
    assert list(isolate.cascade([fails, reads], b"text")) == [(0, "x", "text")]


def test_a_hanging_file_does_not_hang_its_task(spark):
    files = spark.createDataFrame([("/a/x.doc", b"x"), ("/a/y.txt", b"hello")], "path string, content binary")
    got = {r.path: r for r in extract.extract(files, {".doc": lambda data: iter(lambda: time.sleep(60), 1)}, LIMITS).collect()}
    assert got["/a/x.doc"].error_code == "LegacyExtractionTimeout" and got["/a/y.txt"].content == "hello"


SHEETS = {"S & T": [["a", None, "c", None], [], [1, 2.5, -7, True, 1 << 40]], "Empty": [], "U": [["x"]] * 3}


@pytest.mark.parametrize("kind", ["ods", "xlsb"])
def test_other_sheets_read_as_xlsx(kind):
    rest = {n: [[str(v) if isinstance(v, bool) else v for v in row] for row in rows] for n, rows in SHEETS.items()}
    want = list(extract.xlsx(samples.xlsx(rest)))
    assert list(extract.READERS["." + kind](getattr(samples, kind)(SHEETS))) == want
    assert want[0][2].endswith("1\t2.5\t-7\tTrue\t1099511627776")


def test_ods_repeats_and_dates():
    head = 'xmlns:o="urn:o" xmlns:t="urn:t" xmlns:x="urn:x"'
    row = '<t:table-row t:number-rows-repeated="2"><t:table-cell o:value-type="date" o:date-value="2026-01-02T03:04:05"/><t:table-cell t:number-columns-repeated="2" o:value-type="percentage" o:value="0.5"/></t:table-row>'
    data = samples._pack({"content.xml": f'<o:d {head}><t:table t:name="S"><t:table-row t:number-rows-repeated="4"><t:table-cell/></t:table-row>{row}</t:table></o:d>'})
    assert list(extract.ods(data)) == [(0, "工作表 S · 行 5-6", "工作表: S\n" + "\n".join(["2026-01-02 03:04:05\t0.5\t0.5"] * 2))]


def test_preview():
    rows = [["h" * 300, "b"], ["x" * 2000], [], ["1"] * 60, *([["r"]] * 400)]
    data = samples.xlsx({"S": rows})
    got = extract.preview(data, "工作表 S · 行 2-4")
    assert got[0] == (1, ["h" * 100, "b"]) and got[1] == (2, ["x" * 1000]) and got[2] == (3, []) and got[3] == (4, ["1"] * 50)
    assert [n for n, _ in extract.preview(data, "工作表 S · 行 1-900")] == list(range(1, 201))
    for bad in ("行 1-2", "工作表 S · 行 0-4", "工作表 S · 行 5-4", "工作表 T · 行 1-2"):
        with pytest.raises(ValueError):
            extract.preview(data, bad)


def test_codec(spark):
    assert codec.unpack(codec.pack("é客")) == "é客" and codec.unpack(b"plain") == "plain" and codec.unpack(None) == ""
    for bad in (b"DSZ1garbage", b"\xff\xfe"):
        with pytest.raises(ValueError):
            codec.unpack(bad)
    rows = spark.createDataFrame([(1, bytearray(codec.pack("x"))), (2, bytearray(b"DSZ1no"))], "id int, v binary")
    got = {r.id: r.u for r in rows.select("id", codec.unpacked("v").alias("u")).collect()}
    assert got[1].text == "x" and got[1].error is None and got[2].text is None and got[2].error


def test_state_label():
    assert state_label(" a b ", ".pdf") == "a b  ·  PDF" and state_label("", "@sheet", "modified") == "全部内容  ·  电子表格 · 最近修改"
    assert state_label("x" * 50) == "x" * 43 + "…" and len(state_label("x" * 44)) == 44
    with pytest.raises(ValueError):
        state_label("x", sort="size")


def test_scan_backends(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "sub" / "b.md").write_text("two!")
    os.symlink(tmp_path / "sub", tmp_path / "sub" / "again")
    for backend in ("python", "spark", "auto", None):
        at = str(tmp_path if backend == "python" else tmp_path / "sub") if backend == "python" else str(tmp_path / "a.txt")
        got = {r.path.rsplit("/", 1)[-1]: r.size for r in extract.scan(spark, at, backend=backend).collect()}
        assert got == ({"a.txt": 3, "b.md": 4} if backend == "python" else {"a.txt": 3})
    assert [r.size for r in extract.scan(spark, str(tmp_path), "*.md", "python").collect()] == [4]
    with pytest.raises(ValueError):
        formats.scan_backend("rust")


class Query:
    isActive = True


def test_watcher_restarts_and_resumes():
    now, begun, scans = [0.0], [], []
    w = watch.Watcher(lambda: begun.append(Query()) or begun[-1], lambda: scans.append(now[0]), every=60, clock=lambda: now[0])
    assert w.check() == "nothing"
    now[0] = 60
    assert w.check() == "nothing" and not scans
    begun[-1].isActive = False
    now[0] = 120
    assert w.check() == "restarted" and len(begun) == 2 and scans == [120]
    now[0] = 120 + 180
    assert w.check() == "resumed" and scans == [120, 300] and len(begun) == 2
    assert watch.Watcher(Query, list, every=10).gap == 120 and watch.Watcher(Query, list, every=60).gap == 180


def test_reconcile_every(spark, tmp_path):
    seen = threading.Event()
    query = watch.reconcile_every(spark, seen.set, str(tmp_path / "c"), seconds=0.2)
    assert seen.wait(60) and query.isActive
    query.stop()


def test_a_newer_search_ends_the_older(spark):
    searches, out = Searches(spark), {}
    slow = lambda: spark.range(4).repartition(2).mapInPandas(waits, "id long")

    def waits(parts):
        time.sleep(60)
        yield from parts

    def run(name, page, generation):
        out[name] = searches.ask(page, generation)

    first = threading.Thread(target=run, args=("first", slow, searches.begin()))
    first.start()
    time.sleep(3)
    waiting = searches.begin()
    second = threading.Thread(target=run, args=("second", lambda: spark.range(1), waiting))
    third = searches.begin()
    second.start()
    begun = time.monotonic()
    assert [r.id for r in searches.ask(lambda: spark.range(2), third)] == [0, 1]
    first.join(40)
    second.join(40)
    assert out == {"first": None, "second": None} and time.monotonic() - begun < 40
    with pytest.raises(Exception):
        searches.ask(lambda: spark.range(1).select("nothing"))


def test_store_parts(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/s")
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v string")
    made.publish({"a": rows(range(50), "old"), "b": rows(range(50), "old")})
    before = made.pointer()["tables"]["a"]["parts"]
    made.apply({"a": rows([3, 60], "new"), "b": rows([3], "new")}, rows([3, 7], "").select("id"))
    after = made.pointer()["tables"]["a"]["parts"]
    assert sum(after.get(p) != f for p, f in before.items()) <= 3
    got = {r.id: r.v for r in made.read("a").collect()}
    assert got == {**{i: "old" for i in range(50) if i != 7}, 3: "new", 60: "new"}
    assert made.read("b").count() == 49 and made.read("b").where("id = 3").first().v == "new"
    with pytest.raises(ValueError):
        made.apply({}, rows([1], "").selectExpr("id AS other"))
    moved = made.move(f"file://{tmp_path}/t")
    assert made.place() == moved.base and made.read("a").count() == 50
    made.spark = spark
    assert Store(spark, f"file://{tmp_path}/s").pointer()["version"] == moved.pointer()["version"]


def test_life_cycle_without_rows(spark):
    tables = {"files": "path string, file_id long, extension string, size long", "chunks": "file_id long", "state": "path string, status string, updated_at double, retry_after double, owner string, started_at double", "issues": "path string"}
    none = {name: spark.createDataFrame([], schema) for name, schema in tables.items()}
    settings = spark.createDataFrame([], "key string, value string")
    for after in (lifecycle.purge_root(none, "/a"), lifecycle.disable_formats(none, (".pdf",)), lifecycle.reset(none, settings)[0]):
        assert all(t.count() == 0 for t in after.values())
    health = lifecycle.health(none, settings).first()
    assert (health.indexed_files, health.storage_bytes, health.total_roots, health.issue_count, health.last_reconcile) == (0, 0, 0, 0, None)
    rows = spark.createDataFrame([("/a/x.pdf", 1, ".pdf", 5), ("/ab/y.txt", 2, ".txt", 5), ("/a/z.TXT", 3, ".TXT", 5)], tables["files"])
    issues = spark.createDataFrame([("/a/gone.pdf",), ("/a/odd.zzz",), ("/c/q.txt",)], "path string")
    held = {**none, "files": rows, "chunks": spark.createDataFrame([(1,), (2,), (3,), (9,)], "file_id long"), "issues": issues}
    left = lifecycle.purge_root(held, "/a")
    assert [r.path for r in left["files"].collect()] == ["/ab/y.txt"] and sorted(r.file_id for r in left["chunks"].collect()) == [2, 9] and left["issues"].count() == 1
    left = lifecycle.disable_formats(held, (".txt",))
    assert sorted(r.file_id for r in left["files"].collect()) == [2, 3] and sorted(r.path for r in left["issues"].collect()) == ["/a/odd.zzz", "/c/q.txt"]


def test_markup_by_construction(spark):
    """Random pages of known lines, against the text and labels that they were made of."""
    import random

    rng = random.Random(3)
    for _ in range(300):
        page, lines, heading = "", [], ""
        for _ in range(rng.randint(0, 12)):
            words = [f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 4))]
            kind = rng.choice(["p", "div", "h2", "li", "script", "b"])
            if kind == "h2":
                heading = " ".join(words)
                page += f"<h2 id=x>{' <i>'.join(words)}</i></h2>"
            elif kind == "script":
                page += f"<script>{words[0]}</script><!-- {words[0]} -->"
                continue
            elif kind == "b":
                page += f"<section><b>{words[0]}</b> {' '.join(words[1:])}</section>"
            else:
                page += f"<{kind}>{' '.join(words)}</{kind}>\n"
            lines.append((heading, " ".join(words)))
        target, want, run = rng.choice([10, 40, 1000]), [], []
        for i, line in enumerate(lines):
            run.append(line)
            if sum(len(t) for _, t in run) >= target or i == len(lines) - 1:
                own = [h for h, t in run if h and h == t]
                label = own[-1] if own else run[0][0]
                want.append((len(want), f"网页内容 {len(want) + 1}" + (f" · 标题 {label}" if label else ""), "\n".join(t for _, t in run)))
                run = []
        assert list(extract.html(page, target)) == want, page
    assert list(extract.html("<![x]><p>a")) and list(extract.xml(b"<a><![foo[bar]]>b</a>"))


def test_xml_by_construction():
    import random
    from xml.sax.saxutils import quoteattr

    rng = random.Random(4)
    for _ in range(300):
        said, out, path = [], "<?xml version='1.0'?><r>", ["r"]
        for _ in range(rng.randint(0, 15)):
            word = f"w{rng.randint(0, 99)}"
            move = rng.choice(["open", "text", "close", "empty", "stray"])
            if move == "open":
                path.append(rng.choice("abc"))
                out += f"<n:{path[-1]} k={quoteattr(word)}>"
                said.append((path[-1], word))
            elif move == "text":
                out += f" {word}<!-- c -->"
                said.append((path[-1] if path else "", word))
            elif move == "close" and len(path) > 1:
                out += f"</n:{path.pop()}>"
            elif move == "empty":
                out += f"<e k='{word}'/>"
                said.append(("e", word))
            elif move == "stray":
                out += "</zz>"
        target, want, run, element = rng.choice([3, 10, 1000]), [], [], ""
        for i, item in enumerate(said):
            run.append(item)
            if sum(len(t) for _, t in run) >= target or i == len(said) - 1:
                element = run[-1][0] or element
                want.append((len(want), f"XML 内容 {len(want) + 1} · 元素 {element}", "\n".join(t for _, t in run)))
                run = []
        assert list(extract.xml(out.encode(), target)) == want, out
