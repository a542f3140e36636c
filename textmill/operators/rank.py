"""Boosts, file-level grouping, sorting and paging of hits."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.tokens import ascii_lower
from textmill.operators import match
from textmill.operators.index import Stored
from textmill.plans.query import Filters, Hints, Query

SORTS = ("relevance", "modified", "filename")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def metadata(f: Filters) -> Column:
    """The filter over files: extension, path, modified_time and size."""
    tests = []
    if f.extension:
        tests.append(F.col("extension").isin(*f.extensions()))
    if f.path:
        tests.append(contains_pattern(ascii_lower("path"), f.path.casefold()))
    if f.after is not None:
        tests.append(F.col("modified_time") >= F.lit(float(f.after)))
    if f.before is not None:
        tests.append(F.col("modified_time") < F.lit(float(f.before)))
    if f.min_size is not None:
        tests.append(F.col("size") >= max(0, f.min_size))
    if f.max_size is not None:
        tests.append(F.col("size") <= max(0, f.max_size))
    return functools.reduce(operator.and_, tests, F.lit(True))


def _like(c: Column, pattern: str) -> Column:
    """LIKE in which the pattern's own % and _ stay live and a backslash is an ordinary character."""
    return F.call_function("like", c, F.lit(pattern.replace("|", "||")), F.lit("|"))


def contains_pattern(c: Column, text: str) -> Column:
    return _like(c, f"%{text}%")


def filename_boost(raw: str) -> Column:
    """The query is the stem: -8; the name begins with it: -4; it is somewhere in the name: -2."""
    name, low = ascii_lower("filename"), lowered(raw)
    stem = F.substring(name, F.lit(1), F.greatest(F.length("filename") - F.length("extension"), F.lit(0)))
    return F.when(stem == low, -8.0).when(_like(name, low + "%"), -4.0).when(F.instr(name, low) > 0, -2.0).otherwise(0.0)


def compact(c: Column | str = "location") -> Column:
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit(" "), F.lit(""))


def page_boost(page: int | None) -> Column:
    return F.lit(0.0) if page is None else F.when(compact() == f"第{page}页", -3.0).otherwise(0.0)


def slide_boost(slide: int | None) -> Column:
    if slide is None:
        return F.lit(0.0)
    return F.when((compact() == f"幻灯片{slide}") | compact().startswith(f"幻灯片{slide}·标题"), -3.0).otherwise(0.0)


def sheet_boost(sheet: str | None) -> Column:
    if sheet is None:
        return F.lit(0.0)
    return F.when(_like(ascii_lower(compact()), lowered(f"工作表{sheet.replace(' ', '')}·行%")), -2.5).otherwise(0.0)


def structure_boost(h: Hints) -> Column:
    return page_boost(h.page) + slide_boost(h.slide) + sheet_boost(h.sheet)


def hint_score(location: str, h: Hints) -> float:
    """One location's boost for structure hints, on the driver: the exact page or slide, or the sheet whose rows it
    names. Wildcards are not live here, and a slide with a title is another label."""
    place = "".join(location.split())
    sheet = None if h.sheet is None else "工作表" + "".join(h.sheet.split()).casefold() + "·行"
    tests = ((h.page, -3.0, place == f"第{h.page}页"), (h.slide, -3.0, place == f"幻灯片{h.slide}"), (sheet, -2.5, place.casefold().startswith(sheet or " ")))
    return sum((weight for wanted, weight, fits in tests if wanted is not None and fits), 0.0)


def location_terms(plain: str, limit: int = 8) -> list[str]:
    """Distinct terms of the query, at most `limit`."""
    return list({t.casefold(): t for t in reversed(plain.split())}.values())[::-1][:limit]


def semantic() -> Column:
    return compact().startswith("工作表") | (F.instr("location", " · 标题 ") > 0)


def phrase_in_location(plain: str) -> Column:
    """The whole query, without spaces, inside a location that carries a title or a sheet: -1.25."""
    text = lowered("".join(plain.split()))
    return F.when(semantic() & (F.instr(ascii_lower(compact()), text) > 0), -1.25).otherwise(0.0) if text else F.lit(0.0)


def terms_in_location(plain: str) -> Column:
    """Every one of two or more terms inside such a location: -0.9."""
    terms = location_terms(plain)
    if len(terms) < 2:
        return F.lit(0.0)
    every = functools.reduce(operator.and_, [F.instr(ascii_lower(compact()), lowered(t)) > 0 for t in terms])
    return F.when(semantic() & every, -0.9).otherwise(0.0)


def location_boost(plain: str) -> Column:
    whole = phrase_in_location(plain)
    return F.when(whole < 0, whole).otherwise(terms_in_location(plain))


def evidence_boost(hits: Column | str = "hit_count") -> Column:
    n = F.col(hits) if isinstance(hits, str) else hits
    return F.when(n >= 3, -0.24).when(n == 2, -0.12).otherwise(0.0)


def chunk_hits(tok: Stored | DataFrame, q: Query) -> DataFrame:
    """Matching chunks with chunk_score: BM25, structure hints and location."""
    hits = match.scores(tok, q.phrases)
    return hits.withColumn("chunk_score", F.col("score") + structure_boost(q.hints) + location_boost(q.plain)).drop("score")


def best_chunks(hits: DataFrame) -> DataFrame:
    """Per file: the best chunk (score, then ordinal) and the number of hits, in one partial aggregation."""
    best = F.min(F.struct("chunk_score", "ordinal", "chunk_id")).alias("best")
    return hits.groupBy("file_id").agg(best, F.count("*").alias("hit_count")).select("file_id", "hit_count", "best.chunk_score", "best.ordinal", "best.chunk_id")


def best_chunks_window(hits: DataFrame, order: list[Column]) -> DataFrame:
    """Per file the first chunk by a row number."""
    w = Window.partitionBy("file_id").orderBy(*order)
    return hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def file_hits(tok: Stored | DataFrame, files: DataFrame, q: Query) -> DataFrame:
    """Files that match, with relevance_score. Collapsed by file before file metadata is joined."""
    winners = best_chunks(chunk_hits(tok, q))
    joined = winners.join(files.where(metadata(q.filters)), "file_id")
    return joined.withColumn("relevance_score", F.col("chunk_score") + filename_boost(q.plain) + evidence_boost())


def order_by(sort: str, keyword: bool = True) -> list[Column]:
    """Sort keys. Scores are compared to nine decimals, so equal sums in another order of addition tie."""
    if sort not in SORTS:
        raise ValueError(f"unsupported sort mode: {sort}")
    name = [ascii_lower("filename").asc(), F.col("filename").asc(), F.col("modified_time").desc(), F.col("path").asc()]
    if sort == "filename":
        return name
    if not keyword:
        return [F.col("modified_time").desc(), ascii_lower("filename").asc(), F.col("path").asc()]
    if sort == "modified":
        return [F.col("modified_time").desc(), F.round("relevance_score", 9).asc(), F.col("path").asc()]
    return [F.round("relevance_score", 9).asc(), F.col("modified_time").desc(), F.col("path").asc()]


def page(found: DataFrame, sort: str = "relevance", limit: int = 100, offset: int = 0, keyword: bool = True) -> DataFrame:
    """One page with its rank; a limit plus offset that Spark takes from the top of each partition."""
    limit, offset = max(1, int(limit)), max(0, int(offset))
    keys = order_by(sort, keyword)
    top = found.orderBy(*keys).offset(offset).limit(limit)
    # a page's rows, so one partition is right
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*keys)) + offset)


def with_total(top: DataFrame, found: DataFrame) -> DataFrame:
    """total_count beside each row, counted in a plan of its own rather than by a window in one partition."""
    return top.crossJoin(F.broadcast(found.agg(F.count("*").alias("total_count"))))


def search(tok, files: DataFrame, chunks: DataFrame, q: Query, sort: str = "relevance", limit: int = 100, offset: int = 0) -> DataFrame:
    """A ranked page: rank, file columns, best chunk's location and content, score and total."""
    found = file_hits(tok, files, q)
    top = with_total(page(found, sort, limit, offset), found)
    content = chunks.select("chunk_id", "location", "content")
    return F.broadcast(top).join(content, "chunk_id")  # at most a page of rows


def browse(files: DataFrame, q: Query, sort: str = "relevance", limit: int = 100, offset: int = 0) -> tuple[DataFrame, int]:
    """A page of a query without terms, and the total: a page that is not full tells it, and so does an empty
    first one; only then are all files counted."""
    found = files.where(metadata(q.filters))
    top = page(found, sort, limit, offset, keyword=False)
    here, offset = top.count(), max(0, offset)
    if 0 < here < max(1, limit) or not here and not offset:
        return top, offset + here
    return top, found.count()


def search_windowed(tok: Stored | DataFrame, files: DataFrame, q: Query) -> DataFrame:
    """The older engine: metadata first, file name inside the chunk's score, a row number per file, no structure."""
    kept = files.where(metadata(q.filters))
    hits = match.scores(tok, q.phrases, ()).join(kept, "file_id")
    hits = hits.withColumn("relevance_score", F.col("score") + filename_boost(q.plain))
    return best_chunks_window(hits, [F.round("relevance_score", 9), F.col("ordinal")]).drop("score")


def search_prefiltered(tok: Stored | DataFrame, files: DataFrame, q: Query) -> DataFrame:
    """Eligible files first, then the match; corpus figures still come from every chunk."""
    kept = files.where(metadata(q.filters))
    hits = match.scores(tok, q.phrases, ()).join(kept.select("file_id"), "file_id", "left_semi").join(kept, "file_id")
    hits = hits.withColumn("relevance_score", F.col("score") + filename_boost(q.plain))
    return best_chunks_window(hits, [F.round("relevance_score", 9), F.col("ordinal")]).drop("score")


def search_progressive(tok, files: DataFrame, q: Query, limit: int = 100, multiplier: int = 8, most: int = 32_768) -> DataFrame:
    """Top files out of the best chunks, as many as candidates_scanned says: limit * multiplier, doubled until
    `limit` files are among them or all chunks are in (exhausted). Ranks may miss files whose name would
    lift them; an approximation by contract. Chunks are scored once: the best `most` of them, numbered,
    tell at which number the limit-th file comes, and so how far doubling would have gone."""
    scored = match.scores(tok, q.phrases, ()).join(files.where(metadata(q.filters)), "file_id")
    first = min(limit * multiplier, max(limit, most))
    # at most `most` + 1 rows, so one partition is right
    numbered = scored.orderBy("score", "chunk_id").limit(most + 1).withColumn("n", F.row_number().over(Window.orderBy("score", "chunk_id")))
    files_at = numbered.groupBy("file_id").agg(F.min("n").alias("n")).withColumn("files", F.row_number().over(Window.orderBy("n")))
    enough = files_at.agg(F.min(F.when(F.col("files") >= limit, F.col("n"))).alias("enough")).crossJoin(numbered.agg(F.count("*").alias("all")))
    steps = F.greatest(F.lit(0), F.ceil(F.log2(F.least("enough", "all") / F.lit(float(first)))))
    steps = F.when(F.col("enough").isNull(), F.greatest(F.lit(0), F.ceil(F.log2((F.col("all") + 1) / F.lit(float(first)))))).otherwise(steps)
    cut = F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), steps).cast("long"))
    figures = enough.select(cut.alias("cut"), "all").select("cut", F.least("cut", "all").alias("candidates_scanned"), (F.col("all") < F.col("cut")).alias("exhausted"))
    part = numbered.crossJoin(F.broadcast(figures)).where("n <= cut").withColumn("relevance_score", F.col("score") + filename_boost(q.plain))
    best = best_chunks_window(part, [F.round("relevance_score", 9), F.col("ordinal")])
    return page(best.drop("score", "n", "cut"), "relevance", limit)


def document_hits(tok, q: Query, file_id: int, limit: int = 30, offset: int = 0, chunks: DataFrame | None = None) -> DataFrame:
    """Matching chunks of one file in reading order, one more than asked for to tell whether there are more. Only
    the file's own rows are matched: no figure of the corpus takes part. Content comes from `chunks`, if given."""
    limit = max(1, min(50, int(limit)))
    mine = F.col("file_id") == file_id
    if not q.phrases or not all(q.phrases):
        hits = match.scores(tok, q.phrases)
    elif isinstance(tok, Stored):
        counted, names = match.phrase_counts(tok.postings.where(mine), q.phrases, ("location",))
        hits = counted.where(functools.reduce(operator.and_, [F.col(n) > 0 for n in names]))
    else:
        hits = match.scan_scores(tok.where(mine), q.phrases)
    top = hits.select("chunk_id", "file_id", "ordinal", "location").orderBy("ordinal", "chunk_id").offset(max(0, offset)).limit(limit + 1)
    if chunks is None:
        return top
    return F.broadcast(top).join(chunks.where(mine).select("chunk_id", "content"), "chunk_id")  # at most 51 rows
