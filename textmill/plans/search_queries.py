"""Queries of the search engine: filters, matching, ranking, sorting, paging."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from textmill.functions import snippet, tokens
from textmill.operators import index, legacy, match, rank
from textmill.plans import sql
from textmill.plans.query import Filters, Hints, Query, chips, parse, split, state_label, without
from textmill.plans.registry import Registry
from textmill.sources import views
from textmill.sources.views import CHUNKS_SQL, CJK_SQL, FILES_SQL

R = Registry()

ONE = parse("from")
PHRASE = parse('"of the" and')
THREE = parse("the that from")
FILTERED = parse("from ext:pdf after:2025-03-01 size:>=200KB")
FAMILY = replace(parse("from"), filters=Filters(extension="@sheet"))
NAMED = parse("report from")
HINTED = parse("from page:2 slide:3 sheet:src1")
CJK_ONE = parse("客户经理")
CJK_TWO = parse("的 客户经")
CJK_ACROSS = parse("户客经")
ROUND = "round(relevance_score, 6) AS score"


def _word(spark, d):
    return index.of_tables(spark, d)


def _cjk(spark, d):
    return index.of_tables(spark, d, "cjk")


def _score(df, name="score"):
    return df.select("chunk_id", "file_id", F.round(name, 6).alias("score"))


@R.add("scan_files_table", f"WITH {FILES_SQL} SELECT file_id, path, filename, extension, modified_time, size FROM files")
def scan_files_table(spark, d):
    return views.files(spark, d)


for _name, _text in {
    "parse_ext": "ext:PDF ext:docx",
    "parse_path": "path:src1/en",
    "parse_after": "after:2025-06-01 after:2025-13-01",
    "parse_before": "before:2025-03-01",
    "parse_size": "size:>100KB size:<=1.5MB",
    "filter_extension": "ext:.txt",
    "filter_path": "path:src1_/%/doc",
    "filter_modified": "after:2025-02-01 before:2025-09-01",
    "filter_size": "size:>=1MB size:<2MB",
    "family_filter": "ext:x",
}.items():
    _q = Query(filters=Filters(extension="@slides")) if _name == "family_filter" else parse(_text)

    @R.add(_name, f"WITH {FILES_SQL} SELECT file_id, path, extension, size FROM files WHERE {sql.metadata(_q)}")
    def _filter(spark, d, q=_q):
        return views.files(spark, d).where(rank.metadata(q.filters)).select("file_id", "path", "extension", "size")


@R.add("filter_path_escaped", f"WITH {FILES_SQL} SELECT file_id, path FROM files WHERE contains({sql.lower('path')}, 'doc_0001')")
def filter_path_escaped(spark, d):
    return views.files(spark, d).where(F.contains(tokens.ascii_lower("path"), F.lit("doc_0001"))).select("file_id", "path")


# -- tokens and statistics


@R.add("tok_unicode61", f"{sql.tokenised('word')} SELECT term, count(DISTINCT chunk_id) AS docs, count(*) AS occurrences FROM posts GROUP BY term")
def tok_unicode61(spark, d):
    return _word(spark, d).terms


@R.add("tok_cjk_bigram", f"{sql.tokenised('cjk')} SELECT term, count(DISTINCT chunk_id) AS docs, count(*) AS occurrences FROM posts GROUP BY term")
def tok_cjk_bigram(spark, d):
    return _cjk(spark, d).terms


@R.add("corpus_stats", f"{sql.tokenised('word')} SELECT n_chunks, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, d):
    return _word(spark, d).stats.select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


# -- matching


@R.add("match_phrase", f"{sql.matched(PHRASE)} SELECT p::INTEGER AS p, chunk_id, f FROM found")
def match_phrase(spark, d):
    counted, names = match.phrase_counts(_word(spark, d).postings, PHRASE.phrases)
    each = F.array(*[F.struct(F.lit(p).alias("p"), F.col(n).alias("f")) for p, n in enumerate(names)])
    return counted.select("chunk_id", F.inline(each)).where("f > 0").select("p", "chunk_id", "f")


@R.add("fts_and_phrases", f"{sql.matched(THREE)} SELECT chunk_id, file_id FROM scored")
def fts_and_phrases(spark, d):
    return match.scores(_word(spark, d), THREE.phrases).select("chunk_id", "file_id")


@R.add("match_and", f"{sql.matched(PHRASE)} SELECT chunk_id, file_id FROM scored")
def match_and(spark, d):
    counted, names = match.phrase_counts(_word(spark, d).postings, PHRASE.phrases)
    return counted.where(" AND ".join(f"{n} > 0" for n in names)).select("chunk_id", "file_id")


@R.add("scan_without_index", f"{sql.matched(PHRASE)} SELECT chunk_id, file_id, round(score, 6) AS score FROM scored")
def scan_without_index(spark, d):
    """The same match out of the chunks themselves, for corpora that are searched once."""
    return _score(match.scan_scores(index.tokenised(views.chunks(spark, d)), PHRASE.phrases))


@R.add("bm25", f"{sql.matched(PHRASE)} SELECT chunk_id, file_id, round(score, 6) AS score FROM scored")
def bm25(spark, d):
    return _score(match.scores(_word(spark, d), PHRASE.phrases))


@R.add("join_hits_chunks", f"{sql.matched(ONE)} SELECT chunk_id, file_id, location, round(score, 6) AS score FROM scored")
def join_hits_chunks(spark, d):
    held = _word(spark, d)
    hits = match.scores(held, ONE.phrases, ())
    return hits.join(held.chunks.select("chunk_id", "location"), "chunk_id").select("chunk_id", "file_id", "location", F.round("score", 6).alias("score"))


@R.add("cjk_single_char", f"{sql.matched(parse('的'))} SELECT chunk_id, file_id, round(score, 6) AS score FROM scored")
def cjk_single_char(spark, d):
    return _score(match.scores(_cjk(spark, d), parse("的").phrases))


@R.add("cjk_substring", f"{sql.matched(CJK_ONE)} SELECT chunk_id, file_id, round(score, 6) AS score FROM scored")
def cjk_substring(spark, d):
    return _score(match.scores(_cjk(spark, d), CJK_ONE.phrases))


@R.add("cjk_across_runs", f"{sql.matched(CJK_ACROSS)} SELECT chunk_id, file_id, round(score, 6) AS score FROM scored")
def cjk_across_runs(spark, d):
    """Bigrams of neighbouring runs follow each other: a phrase may match over the gap."""
    return _score(match.scores(_cjk(spark, d), CJK_ACROSS.phrases))


@R.add(
    "match_cjk_candidate_verify",
    f"{sql.tokenised('cjk')} SELECT chunk_id, content FROM tok WHERE list_contains(ct, '客户') AND list_contains(ct, '户经') AND list_contains(ct, '经理') AND contains(content, '客户经理')",
)
def match_cjk_candidate_verify(spark, d):
    """All bigrams somewhere in the chunk, out of the postings, then the substring itself."""
    held, pairs = _cjk(spark, d), tokens.query_bigrams("客户经理")
    all_of = held.postings.where(F.col("term").isin(pairs) & (F.element_at("pos", -1) >= 0)).groupBy("chunk_id").count().where(F.col("count") == len(set(pairs)))
    return held.chunks.join(all_of, "chunk_id", "left_semi").where(F.contains("content", F.lit("客户经理"))).select("chunk_id", "content")


LEGACY = parse("of the and")
_CJK_FILES = f"WITH {FILES_SQL}, {CJK_SQL}"


def _file_hits(hits):
    return hits.select("file_id", "filename", "snippet", F.round("score", 6).alias("score"))


@R.add("legacy_search_file", f"""{sql.matched(LEGACY, sql.whole_files('word'))},
hit AS (SELECT file_id, filename, content, round(score, 6) AS score, instr(lower(content), 'and') - 1 AS a, instr(lower(content), 'the') - 1 AS t, instr(lower(content), 'of') - 1 AS o FROM scored JOIN (SELECT chunk_id, filename, content FROM chunks) USING (chunk_id)),
near AS (SELECT *, list_min(list_filter([a, t, o], lambda x: x >= 0)) AS p FROM hit),
cut AS (SELECT *, greatest(p - 52, 0) AS s, least(p + CASE WHEN p IN (a, t) THEN 3 ELSE 2 END + 52, length(content)) AS e FROM near)
SELECT file_id, filename, score, CASE WHEN p IS NULL THEN replace(content[1:104], chr(10), ' ') ELSE CASE WHEN s > 0 THEN '… ' ELSE '' END ||
  regexp_replace(replace(content[s + 1 : e], chr(10), ' '), '(and|the|of)', '[[HIT]]\\1[[/HIT]]', 'gi') || CASE WHEN e < length(content) THEN ' …' ELSE '' END END AS snippet FROM cut""")
def legacy_search_file(spark, d):
    """Whole files instead of chunks, in the word lane."""
    return _file_hits(legacy.search(views.whole_files(spark, d), LEGACY.plain))


@R.add(
    "legacy_search_trigram",
    f"""{_CJK_FILES},
c AS (SELECT *, greatest(length(filename) - 2, 0) + greatest(length(content) - 2, 0) AS dl, (length(content) - length(replace(content, '户经理', ''))) / 3::DOUBLE AS f FROM chunks),
s AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (WHERE f > 0) AS hits FROM c),
w AS (SELECT *, ln((n - hits + 0.5::DOUBLE) / (hits + 0.5::DOUBLE)) AS raw FROM s)
SELECT file_id, filename, replace(content, '户经理', '[[HIT]]户经理[[/HIT]]') AS snippet,
  round(-(CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)), 6) AS score FROM c, w WHERE f > 0""",
)
def legacy_search_trigram(spark, d):
    """Three CJK characters or more: any substring."""
    return _file_hits(legacy.search(views.cjk(spark, d).select("file_id", "filename", "content"), "户经理"))


@R.add("legacy_search_cjk_short", f"{sql.matched(parse('经理'))} SELECT file_id, filename, replace(content, '经理', '[[HIT]]经理[[/HIT]]') AS snippet, round(score, 6) AS score FROM scored JOIN (SELECT chunk_id, filename, content FROM chunks) USING (chunk_id)")
def legacy_search_cjk_short(spark, d):
    """One or two CJK characters."""
    return _file_hits(legacy.search(views.cjk(spark, d).select("file_id", "filename", "content"), "经理"))


# -- the query language, on queries made of the documents' sources and languages


def _parsed(name, columns, said, twin):
    """A query of what `said` makes of (source, lang), for all pairs; the language is Python, so it runs in Arrow batches."""

    @R.add(name, f"WITH s AS (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) SELECT source, lang, {twin} FROM s")
    def run(spark, d):
        pairs = views.table(spark, d, "documents").select("source", "lang").where("source IS NOT NULL AND lang IS NOT NULL").distinct()

        def each(batches):
            for part in batches:
                yield part.join(pd.DataFrame([said(s, l) for s, l in zip(part["source"], part["lang"], strict=True)], columns=columns, index=part.index, dtype=object))

        return pairs.mapInPandas(each, "source string, lang string, " + ", ".join(f"{c} string" for c in columns))


def _texts(terms) -> str:
    return "|".join(t.text for t in terms)


_parsed("parse_tokens", ["terms"], lambda s, l: [_texts(split(f'{s}  "{l} {s}" x\\y "open {l}'))], r"source || '|' || lang || ' ' || source || '|x\y|open ' || lang AS terms")
_parsed("parse_unknown", ["terms", "extension"], lambda s, l: [_texts((q := parse(f"{s}:{l} ext:{l} colour:red after:2025-02-30")).terms), q.filters.extension], "source || ':' || lang || '|colour:red|after:2025-02-30' AS terms, '.' || lower(lang) AS extension")
_parsed("render_text", ["text"], lambda s, l: [parse(f'"{s} {l}"  {l} ext:PDF').text], """'"' || source || ' ' || lang || '" ' || lang AS text""")
_parsed("chips", ["labels"], lambda s, l: [";".join(f"{k}={v}" for k, v in chips(f"size:>=2KB ext:{l} {s} path:{s}"))], "'extension=类型 · ' || upper(lang) || ';path=路径 · ' || source || ';size=大小 ≥ 2 KB' AS labels")
_parsed("remove_chip", ["path_gone", "size_gone"], lambda s, l: [without(raw := f"size:>=2KB {l} size:<1MB path:{s}", "path"), without(raw, "size")], "lang || ' size:>=2048B size:<=1048575B' AS path_gone, lang || ' path:' || source AS size_gone")
_parsed("parse_structure", ["terms", "page", "sheet"], lambda s, l: [(q := parse(f"{s} page:3 sheet:{l} slide:x")).plain, str(q.hints.page), q.hints.sheet], "source || ' slide:x' AS terms, '3' AS page, lang AS sheet")
_parsed("lane_route", ["alone", "mixed"], lambda s, l: [parse("客户 经理").lane + parse(f'page:2 ext:{l} 客 "户 经"').lane, parse(f"{s} 客户").lane], "'cjkcjk' AS alone, 'word' AS mixed")


_parsed("fn_state_label", ["label", "cut"], lambda s, l: [state_label(f" {s} ", l, "modified"), state_label(s * 20)], "source || '  ·  ' || upper(lang) || ' · 最近修改' AS label, repeat(source, 20)[1:43] || '…' AS cut")


# -- boosts, each over all chunks or files


def _boost(name, column, twin):
    @R.add(name, f"WITH {FILES_SQL}, {CHUNKS_SQL} SELECT chunk_id, location, b AS boost FROM (SELECT *, {twin} AS b FROM chunks) WHERE b < 0")
    def run(spark, d):
        return views.chunks(spark, d).select("chunk_id", "location", column().alias("boost")).where("boost < 0")


def _hinted(**hints):
    return Query(hints=Hints(**hints))


_PLACED = Hints(page=2, slide=4, sheet="Src 1")


@R.add("location_boost_fn", f"WITH {FILES_SQL}, {CHUNKS_SQL}, l AS (SELECT DISTINCT location, replace(location, ' ', '') AS c FROM chunks) SELECT location, CASE WHEN c = '第2页' OR c = '幻灯片4' THEN -3.0::DOUBLE WHEN starts_with(lower(c), '工作表src1·行') THEN -2.5::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM l")
def location_boost_fn(spark, d):
    """The driver's form of the structure boosts, over all labels."""

    def each(batches):
        for part in batches:
            yield part.assign(boost=[rank.hint_score(x, _PLACED) for x in part["location"]])

    return views.chunks(spark, d).select("location").distinct().mapInPandas(each, "location string, boost double")


_boost("boost_page", lambda: rank.page_boost(2), sql.structure_boost(_hinted(page=2)))
_boost("boost_slide", lambda: rank.slide_boost(3), sql.structure_boost(_hinted(slide=3)))
_boost("boost_sheet", lambda: rank.sheet_boost("SRC 1_"), sql.structure_boost(_hinted(sheet="SRC 1_")))
_boost("boost_location_phrase", lambda: rank.phrase_in_location("标题 SRC1"), sql.location_boost(parse('"标题 SRC1"')))
_boost("boost_location_terms", lambda: rank.location_boost("src1 工作表 行"), sql.location_boost(parse("src1 工作表 行")))
_boost("boost_location_any", lambda: rank.location_boost("src 标题 块"), sql.location_boost(parse("src 标题 块")))


@R.add("boost_filename", f"WITH {FILES_SQL} SELECT file_id, filename, {sql.filename_boost(parse('DOC_00'))} AS prefix, {sql.filename_boost(parse('report_000100'))} AS stem, {sql.filename_boost(parse('7.p'))} AS inside FROM files")
def boost_filename(spark, d):
    return views.files(spark, d).select("file_id", "filename", rank.filename_boost("DOC_00").alias("prefix"), rank.filename_boost("report_000100").alias("stem"), rank.filename_boost("7.p").alias("inside"))


@R.add("boost_multi_chunk", f"{sql.file_hits(ONE)} SELECT file_id, hit_count, CASE WHEN hit_count >= 3 THEN -0.24::DOUBLE WHEN hit_count = 2 THEN -0.12::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM winners")
def boost_multi_chunk(spark, d):
    return rank.best_chunks(rank.chunk_hits(_word(spark, d), ONE)).select("file_id", "hit_count", rank.evidence_boost().alias("boost"))


# -- grouping, joins, windows


@R.add("agg_best_chunk", f"{sql.file_hits(HINTED)} SELECT file_id, hit_count, round(w.a, 6) AS chunk_score, w.b AS ordinal, w.c AS chunk_id FROM winners")
def agg_best_chunk(spark, d):
    return rank.best_chunks(rank.chunk_hits(_word(spark, d), HINTED)).select("file_id", "hit_count", F.round("chunk_score", 6).alias("chunk_score"), "ordinal", "chunk_id")


@R.add(
    "join_self_best",
    f"{sql.file_hits(ONE)} SELECT h.file_id, min(h.ordinal) AS ordinal FROM hits AS h JOIN (SELECT file_id, min(chunk_score) AS s FROM hits GROUP BY file_id) AS b ON h.file_id = b.file_id AND h.chunk_score = b.s GROUP BY h.file_id",
)
def join_self_best(spark, d):
    return rank.best_chunks(rank.chunk_hits(_word(spark, d), ONE)).select("file_id", "ordinal")


@R.add("join_winners_files", f"{sql.file_hits(FILTERED)} SELECT file_id, path, chunk_id, {ROUND} FROM file_hits")
def join_winners_files(spark, d):
    return rank.file_hits(_word(spark, d), views.files(spark, d), FILTERED).select("file_id", "path", "chunk_id", F.round("relevance_score", 6).alias("score"))


def _page_sql(q, order, limit, offset=0, extra=""):
    return f"{sql.file_hits(q)} SELECT file_id, path, {ROUND}, row_number() OVER (ORDER BY {sql.ORDER[order]})::INTEGER AS rank{extra} FROM file_hits ORDER BY {sql.ORDER[order]} LIMIT {limit} OFFSET {offset}"


def _page(spark, d, q, sort, limit, offset=0):
    found = rank.file_hits(_word(spark, d), views.files(spark, d), q)
    return rank.page(found, sort, limit, offset).select("file_id", "path", F.round("relevance_score", 6).alias("score"), "rank")


for _name, _q, _sort, _limit, _offset in (
    ("sort_relevance", ONE, "relevance", 100, 0),
    ("sort_modified", ONE, "modified", 100, 0),
    ("sort_filename", ONE, "filename", 100, 0),
    ("page_exact", HINTED, "relevance", 25, 50),
    ("search_combined", FILTERED, "relevance", 100, 0),
    ("search_family", FAMILY, "relevance", 100, 0),
    ("search_filename", NAMED, "relevance", 100, 0),
):

    @R.add(_name, _page_sql(_q, _sort, _limit, _offset))
    def _paged(spark, d, q=_q, sort=_sort, limit=_limit, offset=_offset):
        return _page(spark, d, q, sort, limit, offset)


@R.add("search_cjk", f"{sql.matched(CJK_TWO)} SELECT chunk_id, file_id, round(score, 6) AS score FROM scored")
def search_cjk(spark, d):
    return _score(match.scores(_cjk(spark, d), CJK_TWO.phrases))


@R.add("count_total_over", _page_sql(THREE, "relevance", 10, 0, ", count(*) OVER () AS total_count"))
def count_total_over(spark, d):
    found = rank.file_hits(_word(spark, d), views.files(spark, d), THREE)
    top = rank.with_total(rank.page(found, "relevance", 10), found)
    return top.select("file_id", "path", F.round("relevance_score", 6).alias("score"), "rank", "total_count")


@R.add("win_count_over", _page_sql(FILTERED, "modified", 10, 5, ", count(*) OVER () AS total_count"))
def win_count_over(spark, d):
    """The older engine's total beside each row, also past the first page."""
    found = rank.file_hits(_word(spark, d), views.files(spark, d), FILTERED)
    top = rank.with_total(rank.page(found, "modified", 10, 5), found)
    return top.select("file_id", "path", F.round("relevance_score", 6).alias("score"), "rank", "total_count")


@R.add("count_files", f"{sql.file_hits(FILTERED)} SELECT count(*) AS n FROM file_hits")
def count_files(spark, d):
    hits = match.scores(_word(spark, d), FILTERED.phrases).select("file_id").distinct()
    return views.files(spark, d).where(rank.metadata(FILTERED.filters)).join(hits, "file_id", "left_semi").agg(F.count("*").alias("n"))


@R.add("count_distinct", f"{sql.matched(THREE)} SELECT count(DISTINCT file_id) AS n FROM scored")
def count_distinct(spark, d):
    return match.scores(_word(spark, d), THREE.phrases).agg(F.count_distinct("file_id").alias("n"))


@R.add("win_row_number", f"{sql.window_hits(NAMED)} SELECT file_id, chunk_id, ordinal, {ROUND} FROM file_hits")
def win_row_number(spark, d):
    return rank.search_windowed(_word(spark, d), views.files(spark, d), NAMED).select("file_id", "chunk_id", "ordinal", F.round("relevance_score", 6).alias("score"))


@R.add("search_window_exact", f"{sql.window_hits(FILTERED)} SELECT file_id, path, {ROUND}, row_number() OVER (ORDER BY {sql.ORDER['relevance']})::INTEGER AS rank FROM file_hits ORDER BY {sql.ORDER['relevance']} LIMIT 100")
def search_window_exact(spark, d):
    found = rank.search_windowed(_word(spark, d), views.files(spark, d), FILTERED)
    return rank.page(found).select("file_id", "path", F.round("relevance_score", 6).alias("score"), "rank")


@R.add("search_prefilter", f"{sql.window_hits(FILTERED)} SELECT file_id, path, {ROUND} FROM file_hits")
def search_prefilter(spark, d):
    return rank.search_prefiltered(_word(spark, d), views.files(spark, d), FILTERED).select("file_id", "path", F.round("relevance_score", 6).alias("score"))


@R.add("prefilter_cross_probe", f"{sql.matched(ONE)} SELECT chunk_id, file_id FROM scored WHERE file_id IN (SELECT file_id FROM files WHERE {sql.metadata(FILTERED)})")
def prefilter_cross_probe(spark, d):
    """Postings of the term, of eligible files only."""
    kept = views.files(spark, d).where(rank.metadata(FILTERED.filters)).select("file_id")
    return match.scores(_word(spark, d), ONE.phrases).join(kept, "file_id", "left_semi").select("chunk_id", "file_id")


PROGRESSIVE = dict(limit=20, multiplier=2, most=500)


@R.add("topk_progressive", sql.progressive(NAMED, **PROGRESSIVE))
def topk_progressive(spark, d):
    top = rank.search_progressive(_word(spark, d), views.files(spark, d), NAMED, **PROGRESSIVE)
    return top.select("file_id", "path", F.round("relevance_score", 6).alias("score"), "rank", "candidates_scanned", "exhausted")


@R.add("first_paint", f"{sql.file_hits(ONE)} SELECT file_id, path, {ROUND}, (SELECT count(*) FROM file_hits) > 100 AS has_more FROM file_hits ORDER BY {sql.ORDER['relevance']} LIMIT 100")
def first_paint(spark, d):
    """One row more than the page tells whether there is another; nothing is counted."""
    found = rank.page(rank.file_hits(_word(spark, d), views.files(spark, d), ONE), "relevance", 101)
    more = found.agg((F.count("*") > 100).alias("has_more"))
    return found.where("rank <= 100").crossJoin(F.broadcast(more)).select("file_id", "path", F.round("relevance_score", 6).alias("score"), "has_more")


DOC = 4


@R.add("doc_hits", f"{sql.matched(THREE)} SELECT chunk_id, ordinal, location, md5(content) AS content_md5 FROM scored JOIN (SELECT chunk_id, content FROM chunks) USING (chunk_id) WHERE file_id = {DOC} ORDER BY ordinal LIMIT 4")
def doc_hits(spark, d):
    held = _word(spark, d)
    hits = rank.document_hits(held, THREE, DOC, limit=3, chunks=held.chunks)
    return hits.select("chunk_id", "ordinal", "location", F.md5("content").alias("content_md5"))


@R.add("browse_page", f"WITH {FILES_SQL} SELECT file_id, path, row_number() OVER (ORDER BY {sql.ORDER['browse']})::INTEGER AS rank, count(*) OVER () AS total_count FROM files WHERE extension = '.pdf' ORDER BY {sql.ORDER['browse']} LIMIT 50 OFFSET 20")
def browse_page(spark, d):
    found = views.files(spark, d).where("extension = '.pdf'")
    return rank.with_total(rank.page(found, "relevance", 50, 20, keyword=False), found).select("file_id", "path", "rank", "total_count")


BROWSED = parse("ext:pdf size:>=1MB")


@R.add("browse_total_shortcut", f"WITH {FILES_SQL} SELECT file_id, path, (SELECT count(*) FROM files WHERE {sql.metadata(BROWSED)}) AS total_count FROM files WHERE {sql.metadata(BROWSED)} ORDER BY {sql.ORDER['browse']} LIMIT 100000 OFFSET 3")
def browse_total_shortcut(spark, d):
    """A page that is not full tells the total without a count of its own."""
    top, total = rank.browse(views.files(spark, d), BROWSED, limit=100000, offset=3)
    return top.select("file_id", "path", F.lit(total).alias("total_count"))


@R.add("browse_sort", f"WITH {FILES_SQL} SELECT file_id, path, row_number() OVER (ORDER BY {sql.ORDER['filename']})::INTEGER AS rank FROM files ORDER BY {sql.ORDER['filename']} LIMIT 100")
def browse_sort(spark, d):
    return rank.page(views.files(spark, d), "filename", 100, keyword=False).select("file_id", "path", "rank")


@R.add("join_page_content", f"{sql.file_hits(ONE)}, top AS (SELECT * FROM file_hits ORDER BY {sql.ORDER['relevance']} LIMIT 100) SELECT t.file_id, c.location, md5(c.content) AS content_md5 FROM top AS t JOIN chunks AS c USING (chunk_id)")
def join_page_content(spark, d):
    """Content is read for the page's rows only."""
    held = _word(spark, d)
    page = rank.search(held, views.files(spark, d), held.chunks, ONE)
    return page.select("file_id", "location", F.md5("content").alias("content_md5"))


@R.add("join_filename_content", f"{sql.tokenised('word')} SELECT DISTINCT chunk_id FROM tok WHERE list_contains(ft, 'report') AND list_contains(ct, 'the')")
def join_filename_content(spark, d):
    posts = _word(spark, d).postings
    names = posts.where((F.col("term") == "report") & (F.get("pos", F.lit(0)) < 0)).select("chunk_id")
    return posts.where((F.col("term") == "the") & (F.element_at("pos", -1) >= 0)).select("chunk_id").join(names, "chunk_id", "left_semi")


_SNIPPET_TERM = "from"


@R.add(
    "fn_snippet",
    f"""{sql.tokenised('word')},
cut AS (SELECT chunk_id, content, position('{_SNIPPET_TERM}' IN lower(content)) - 1 AS pos FROM tok),
part AS (SELECT *, greatest(0, pos - 52) AS s, least(length(content), pos + {len(_SNIPPET_TERM)} + 52) AS e FROM cut)
SELECT chunk_id, CASE WHEN pos < 0 THEN replace(content[1:104], chr(10), ' ') ELSE CASE WHEN s > 0 THEN '… ' ELSE '' END ||
  regexp_replace(replace(content[s + 1 : e], chr(10), ' '), '({_SNIPPET_TERM})', '[[HIT]]\\1[[/HIT]]', 'gi') || CASE WHEN e < length(content) THEN ' …' ELSE '' END END AS snippet FROM part""",
)
def fn_snippet(spark, d):
    return views.chunks(spark, d).select("chunk_id", snippet.snippet("content", [_SNIPPET_TERM]).alias("snippet"))
