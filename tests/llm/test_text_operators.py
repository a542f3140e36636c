"""Operators 2, 4, 6 and 8, against plain versions."""

import base64
import gc
import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textmill.llm import bpe, chat, elias, html, memo
from textmill.llm.words import chunks

from .helpers import corpus, odd_rows, table

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


WILD = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t  　'stl1.,!")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(WILD, max_size=6))
def test_byte_bpe_is_tiktokens(texts):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.coder(RANKS)
    got = coder.encode(texts)
    assert [x.tolist() for x in got] == [own.encode_ordinary(t) for t in texts]
    assert [bpe.byte_table(RANKS).decode(x).decode() for x in got] == texts


def test_byte_bpe_rows(spark, plain):
    rows = corpus() + odd_rows()
    got = bpe.round_trip(table(spark, rows), RANKS, with_ids=True).collect()
    want = sorted(((i, t or "") for i, t, *_ in rows), key=str)
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: str((r.doc_id, bpe.byte_table(RANKS).decode(np.array(r.ids, int)).decode()))), want, strict=True):
        ids = plain.encode_ordinary(t)
        assert (r.doc_id, r.ids, r.n_tokens) == (i, ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_workers_forget_segments_of_an_earlier_stage(spark):
    docs = table(spark, corpus())

    def memories(batches):
        for part in chunks(batches, "text"):
            held = sum(isinstance(x, memo.Memo) for x in gc.get_objects())
            yield pa.RecordBatch.from_pydict({"n": [held] * part.num_rows})

    assert bpe.round_trip(docs, RANKS).count() == docs.count()
    assert {r.n for r in docs.select("text").mapInArrow(memories, "n long").collect()} == {0}


def test_byte_bpe_offsets_and_split_characters(spark):
    texts = [(1, "naïve 漢字 😀", "", "", 0), (2, None, "", "", 0)]
    got = {r.doc_id: r for r in bpe.encode(table(spark, texts), RANKS, offsets=True).collect()}
    assert got[2].ids == [] and got[2].spans == []
    text = texts[0][1]
    covered = {i for s in got[1].spans for i in range(s.begin, s.finish)}
    assert covered == set(range(len(text))) and len(got[1].spans) == len(got[1].ids)
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(table(spark, texts), RANKS), RANKS).collect()}
    assert back[1].text == text and bytes(back[1].bytes) == text.encode() and back[2].text == ""


def test_empty_tables(spark):
    none = table(spark, [])
    assert bpe.round_trip(none, RANKS).count() == 0
    assert elias.written_and_read(none, WORDS).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.main_text(pages).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.read_back(chat.format_chats(turns))).count() == 0


# -- token files


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700).map(sorted))
def test_elias_fano(values):
    made = elias.EliasFano.of(values)
    again, end = elias.EliasFano.read(memoryview(made.to_bytes()), 0)
    assert again.between(0, len(values)).tolist() == values and end == len(made.to_bytes())
    for i in range(0, len(values), 37):
        assert again[i] == values[i]
    if len(values) > 300:
        assert len(made.low) + len(made.high) < len(values) * (3 + max(1, values[-1] // len(values)).bit_length()) / 8 + 16


@settings(max_examples=150, deadline=None)
@given(st.lists(WILD, min_size=1, max_size=6))
def test_word_encoder_is_the_librarys(texts):
    import pyarrow as pa

    made = elias.loaded(WORDS)
    for known in (600_000, 3):
        ids, counts = elias.WordEncoder(made, known).encode(pa.array(texts))
        want = [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]
        assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == want[0]
        assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))


def test_token_files(spark):
    rows = [r for r in corpus() if r[0] is not None]
    made = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in elias.written_and_read(table(spark, rows), WORDS).collect()}
    at = 0
    for i, t, *_ in sorted(rows):
        ids = made.encode(t or "", add_special_tokens=False).ids + [1]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_with_null_and_repeated_ids(spark):
    got = elias.written_and_read(table(spark, odd_rows()), WORDS).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "5", "9", "None", "None"]
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert {r.doc_id for r in got if r.start < spans[1][1]} == {None}


def test_offsets_are_read_by_select_alone(spark, monkeypatch):
    """No call sees more of a sequence than the bytes between two entries of its directory."""
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 400, 5000)
    block = elias.Block(elias.Block.pack([None, *range(10, 15100, 3)][:5000], counts.tolist(), np.zeros(counts.sum(), int), 2))
    seen, plain = [], np.unpackbits
    monkeypatch.setattr(np, "unpackbits", lambda a, **k: seen.append(len(a)) or plain(a, **k))
    got = list(block.documents())
    assert [k for x, _, _ in got for k in x] == [None, *range(10, 15100, 3)][:5000]
    assert np.concatenate([e for _, _, e in got]).tolist() == np.cumsum(counts).tolist()
    assert max(seen) <= elias.SAMPLE * 10 // 8 and len(block.ends.high) > 8 * elias.SAMPLE // 8


def test_rows_of_one_id_are_ordered_by_their_texts(spark):
    rows = [(7, t, "", "", 0) for t in ("b b b", "a", None, "c c")] + [(3, "x", "", "", 0)]
    for n in (1, 3):
        got = sorted((r.start, r.n_tokens) for r in elias.written_and_read(table(spark, rows).repartition(n), WORDS).collect())
        assert [n for _, n in got] == [2, 1, 2, 4, 3]


def test_other_tokenizers_are_refused():
    from tokenizers import models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"The": 0, "the": 1, "?": 2}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    with pytest.raises(ValueError):
        elias.WordEncoder(made)


def thue_morse(order):
    """Two texts that collide under any polynomial hash modulo 2 ** 64."""
    x = "a"
    for _ in range(order):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_texts_made_to_collide_keep_their_own_ids(spark, plain):
    made = Tokenizer.from_file(WORDS)
    texts = [*thue_morse(10), *thue_morse(12), *(" ".join(x) for x in thue_morse(11))]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    for r in bpe.round_trip(table(spark, rows), RANKS, with_ids=True).collect():
        assert r.ids == plain.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in elias.written_and_read(table(spark, rows), WORDS).collect():
        ids = made.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_memo_compares_bytes_on_equal_hashes():
    from textmill.llm.memo import Memo
    from textmill.llm.words import Words

    import pyarrow as pa

    made = elias.loaded(WORDS)
    plain = type(made).from_str(made.to_str())
    memo = Memo(plain)
    for column in (["one two", "three fourteen-letters fourteen_letters"], ["two nine one"], ["zebra"]):
        w = Words(pa.array(column), lower=True)
        ids, edges = memo.ids(w.bytes, w.starts, w.ends, np.full(len(w), 5, np.uint64))
        said = [x for t in column for x in t.split()]
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [plain.encode(x, add_special_tokens=False).ids for x in said]


def test_block_lookup():
    block = elias.Block.pack([None, -4, 3, 70000], [2, 1, 3, 2], np.arange(8), 2)
    assert elias.lookup(block, 3).tolist() == [3, 4, 5] and elias.lookup(block, 4) is None
    assert elias.lookup(block, -4).tolist() == [2]


# -- chats


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>y<|end|>", "<\\|part|>", "a<", "|b", "[", "INST]", "", None, "<<SYS>>\\</SYS>>", "\n", "<\\\\/s>"]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)]) for c in range(14) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", "<|end|>", "assistant"])]
    rows += [(99, 1, None, "x"), (99, None, "assistant", "first"), (99, 1, "user", "tie"), (99, 1, "user", "tie"), (None, 0, "assistant", "nobody")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS rows", "1 AS formatted")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert len(got) == 16
    for c, r in got.items():
        mine = sorted(((t, role or "", text or "") for k, t, role, text in rows if k == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in mine]
        assert r.loss_text == "".join(text for _, role, text in mine if role == "assistant")
        assert r.formatted.count("<|end|>") == r.n_messages == 1 + sum(a[1] != b[1] for a, b in zip(mine, mine[1:], strict=False))
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted


# -- pages

PAGES = {
    "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One  <b>two</b>\nthree.</p><p>Four</p></article><footer>f</footer></body></html>": "A & B One two three. Four",
    "<body><div class='menu'><a>m</a></div><div id=main><h2>T</h2><p>Some long text, with points. And more, indeed.<p>Again, a long line; it goes on.<ul><li>a point in a list</ul></div><div class='comments'><p>A reader's long comment, with points. Yes.</p></div></body>": "T Some long text, with points. And more, indeed. Again, a long line; it goes on. a point in a list",
    "<article><p><b>x<br><p>y</p><aside>s</aside><form>f<input></form></article>": "x y",
    "<article><header><h1>Title</h1><span>by me</span></header><p>Text, text.</p><div class='ad'>buy</div><p hidden>h</p></article>": "Title Text, text.",
    "plain &lt;words&gt;": "plain <words>",
    "<p>half<script>var t='</p>'": "half",
    "<!-- only -->": "",
    "": "",
    None: "",
}


def test_main_text(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "x", 1) for i, h in enumerate(PAGES)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    for i, (h, want) in enumerate(PAGES.items()):
        assert got[i].text == want, h
        assert got[i].n_chars == len(want) and got[i].url == f"u{i}"


def test_main_text_never_fails():
    rng = random.Random(1)
    parts = ["<", "!", "[", "]", ">", "-", "--", "<!--", "<![", "CDATA[", "&", "&#", "&#x", "amp;", "x y.", "<p>", "</p>", "<div ", "class=", "'", '"', "<script", "</script", "/>", "<?", "\0", "<li>", "</ul>", "<td>", "<article>", "</article>", "<style>", "</", "=", "\n", "<svg/>", "é", "<u>", "</b>"]
    for _ in range(8000):
        html.extract("".join(rng.choices(parts, k=rng.randint(1, 14))))
    for page, want in (("<![foo[bar]]><p>x", "x"), ("<![x]>q", "q"), ("<![ ]>q", "q"), ("<p>a<![if !IE]>b<![endif]></p>", "ab")):
        assert html.extract(page) == want


def test_main_text_is_linear_in_depth():
    def took(page):
        t = time.perf_counter()
        html.extract(page)
        return time.perf_counter() - t

    for shape in (lambda n: "<div>words" * n, lambda n: "<p><object>" + "<span>" * n + "<div>x" * n, lambda n: "<u><div>" + "<b><i>" * n + "</u>" * n + "</section>" * n):
        took(shape(500))
        assert took(shape(16000)) < 16 * max(took(shape(2000)), 0.02)


def test_the_threshold_decides():
    """Without the thresholds another text comes out, with an article element and without."""
    for page in ("<article><h1>T</h1>{}<div><a href=c>An author</a></div><div>*</div>{}</article>", "<div><div><a href=/>Home</a> | <a href=/x>About</a></div><div><h1>T</h1>{}</div><div>Login to see more</div></div>"):
        page = page.replace("{}", BODY)
        assert html.extract(page) == " ".join(["T"] + [BODY_TEXT] * (page.count(BODY)))
        assert html.extract(page, deviation=0.0) != html.extract(page)


def test_main_text_of_formulas_and_labels():
    assert html.extract(f"<article>{BODY}<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, <label>says</label> it.</p></article>") == f"{BODY_TEXT} So x=1 holds, says it."


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "<p>Deep, long text. Here it is.</p>"
    assert html.extract(deep) == "Deep, long text. Here it is."
    assert html.extract("<article>" + "<p>word, word.</p>" * 20000 + "</article>") == " ".join(["word, word."] * 20000)


BODY = "<p>A long first line, with points; and more of it. It goes on, and on.</p><p>A second one follows, nearly as long. It has points, too.</p><p>Short one.</p>"
BODY_TEXT = "A long first line, with points; and more of it. It goes on, and on. A second one follows, nearly as long. It has points, too. Short one."


def test_main_text_is_chosen_by_path_scores_inside_an_article():
    promo = "<h2>More</h2><div><ul><li><a href=a>One more story</a></li><li><a href=b>Another story</a></li></ul></div>"
    assert html.extract(f"<article><h1>T</h1><div><a href=c>An author</a></div>{BODY}{promo}</article>") == f"T {BODY_TEXT}"
    assert html.extract(f"<article><h1>T</h1>{BODY}<section><div>*</div></section>{BODY}{BODY}</article>") == f"T {BODY_TEXT} {BODY_TEXT} {BODY_TEXT}"
    assert html.extract(f"<article>{BODY}<h2>List</h2><ul><li>Milk<li>Some <a href=x>old</a> bread</ul></article>") == f"{BODY_TEXT} List Milk Some old bread"
    assert html.extract("<h1>Only this</h1>") == "Only this"


def test_main_text_uses_articles_only_where_they_hold_the_content():
    card = "<article><p>Read next: a card, with a text. It is long enough, too.</p></article>"
    assert html.extract(f"<body><div>{BODY * 3}</div>{card}</body>").startswith(" ".join([BODY_TEXT] * 3))
    parts = [f"<article><h2>Part {i}</h2>{BODY * (i + 1)}</article>" for i in range(3)]
    assert html.extract("<body>" + "".join(parts) + "</body>") == " ".join(" ".join([f"Part {i}"] + [BODY_TEXT] * (i + 1)) for i in range(3))
    small = "<article><h2>Entry</h2><p>A late entry, in short.</p></article>"
    assert html.extract(f"<body><article>{BODY * 9}</article>{small}</body>").endswith("Short one. Entry A late entry, in short.")


def test_main_text_is_not_cut_by_words_in_class_and_id():
    for mark in ("class=no-sidebar", "class=with-ads", "class=widget-container", "class=widget", "id=search"):
        assert html.extract(f"<body><div {mark}><h1>T</h1>{BODY}</div></body>") == f"T {BODY_TEXT}", mark
    page = f"<article><h1>T</h1>{BODY}<h2 id=search-algorithms>On search</h2>{BODY}<section id=social-history><h2>Past</h2>{BODY}</section></article>"
    assert html.extract(page) == f"T {BODY_TEXT} On search {BODY_TEXT} Past {BODY_TEXT}"
    assert html.extract(f"<article><h1>T</h1>{BODY}<div class=widget-container>{BODY}</div></article>") == f"T {BODY_TEXT} {BODY_TEXT}"
    for mark in ("ad", "ad-slot", "cookie-banner", "comments", "related-posts"):
        assert html.extract(f"<article><h1>T</h1>{BODY}<div class={mark}><p>Buy this, now.</p></div>{BODY}</article>") == f"T {BODY_TEXT} {BODY_TEXT}", mark


def test_token_files_with_added_tokens(spark):
    texts = ["plain words.", "one <|endoftext|> two", "<|EndOfText|> x", None, "<|startoftext|>a<|endoftext|><|endoftext|>", "café <|endoftext", "", "x<|endoftext|>"]
    made = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in elias.written_and_read(table(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)]), WORDS).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = made.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)
