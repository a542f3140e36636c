"""SQL twins of the search plans, for the side-by-side check."""

from __future__ import annotations

from textmill.functions.tokens import LOWER, UPPER, accent_table
from textmill.plans.query import Query
from textmill.sources.views import CHUNKS_SQL, CJK_SQL, FILES_SQL


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lower(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


def words(c: str) -> str:
    accented, base = accent_table()
    return rf"list_transform(regexp_extract_all(translate(lower({c}), {quote(accented)}, {quote(base)}), '[\p{{L}}\p{{N}}\p{{Co}}][\p{{L}}\p{{N}}\p{{Co}}\p{{Mn}}]*'), lambda w: regexp_replace(w, '\p{{Mn}}', '', 'g'))"


def bigrams(c: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({c}, '[㐀-䶿一-鿿]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: r[i : i + 1]) END))"


def tokenised(lane: str, source: str | None = None) -> str:
    """CTEs files, chunks (or another `source` of them), tok (chunk columns with ft, ct, dl) and stats (n_chunks, avgdl)."""
    make = words if lane == "word" else bigrams
    source = source or (CHUNKS_SQL if lane == "word" else CJK_SQL)
    return f"""WITH {FILES_SQL}, {source},
tok AS MATERIALIZED (SELECT *, len(ft) + len(ct) AS dl FROM (SELECT *, {make('filename')} AS ft, {make('content')} AS ct FROM chunks)),
stats AS (SELECT count(*) AS n_chunks, avg(dl) AS avgdl FROM tok),
posts AS MATERIALIZED (
  SELECT chunk_id, file_id, ordinal, dl, 0 AS col, unnest(range(len(ft))) AS pos, unnest(ft) AS term FROM tok
  UNION ALL SELECT chunk_id, file_id, ordinal, dl, 1, unnest(range(len(ct))), unnest(ct) FROM tok
)"""


def matched(q: Query, source: str | None = None) -> str:
    """Further CTEs up to scored (chunk_id, file_id, ordinal, location, score)."""
    rows = ", ".join(f"({p}, {len(phrase)}, {i}, {quote(t)})" for p, phrase in enumerate(q.phrases) for i, t in enumerate(phrase))
    n = len(q.phrases)
    return f"""{tokenised(q.lane, source)},
q(p, n, i, term) AS (VALUES {rows}),
starts AS (SELECT p, chunk_id, file_id, ordinal, dl, col FROM posts JOIN q USING (term) GROUP BY p, n, chunk_id, file_id, ordinal, dl, col, pos - i HAVING count(*) = n),
found AS (SELECT p, chunk_id, file_id, ordinal, dl, sum(CASE WHEN col = 0 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END) AS f FROM starts GROUP BY ALL),
idf AS (SELECT p, CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END AS idf FROM (SELECT p, ln((any_value(n_chunks) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS raw FROM found, stats GROUP BY p)),
scored AS (
  SELECT s.chunk_id, s.file_id, s.ordinal, c.location, s.score FROM (
    SELECT chunk_id, file_id, ordinal, -sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
    FROM found JOIN idf USING (p), stats GROUP BY chunk_id, file_id, ordinal HAVING count(*) = {n}) AS s JOIN chunks AS c USING (chunk_id)
)"""


def filename_boost(q: Query) -> str:
    low = quote(q.plain.translate(str.maketrans(UPPER, LOWER)))
    name = lower("filename")
    return f"CASE WHEN substr({name}, 1, length(filename) - length(extension)) = {low} THEN -8.0::DOUBLE WHEN {name} LIKE {low} || '%' THEN -4.0::DOUBLE WHEN instr({name}, {low}) > 0 THEN -2.0::DOUBLE ELSE 0.0::DOUBLE END"


def structure_boost(q: Query) -> str:
    c, parts = "replace(location, ' ', '')", []
    if q.hints.page is not None:
        parts.append(f"CASE WHEN {c} = '第{q.hints.page}页' THEN -3.0::DOUBLE ELSE 0 END")
    if q.hints.slide is not None:
        parts.append(f"CASE WHEN {c} = '幻灯片{q.hints.slide}' OR {c} LIKE '幻灯片{q.hints.slide}·标题%' THEN -3.0::DOUBLE ELSE 0 END")
    if q.hints.sheet is not None:
        parts.append(f"CASE WHEN {lower(c)} LIKE {lower(quote('工作表' + q.hints.sheet.replace(' ', '') + '·行%'))} THEN -2.5::DOUBLE ELSE 0 END")
    return " + ".join(parts) or "0.0::DOUBLE"


def location_boost(q: Query) -> str:
    c = lower("replace(location, ' ', '')")
    guard = "(replace(location, ' ', '') LIKE '工作表%' OR instr(location, ' · 标题 ') > 0)"
    text = lower(quote("".join(q.plain.split())))
    seen = list(dict.fromkeys(t.casefold() for t in q.plain.split()))[:8]
    more = f" WHEN {guard} AND " + " AND ".join(f"instr({c}, {lower(quote(t))}) > 0" for t in seen) + " THEN -0.9::DOUBLE" if len(seen) > 1 else ""
    return f"CASE WHEN {guard} AND instr({c}, {text}) > 0 THEN -1.25::DOUBLE{more} ELSE 0.0::DOUBLE END"


def metadata(q: Query) -> str:
    f, tests = q.filters, []
    if f.extension:
        tests.append(f"extension IN ({', '.join(map(quote, f.extensions()))})")
    if f.path:
        tests.append(f"{lower('path')} LIKE {quote('%' + f.path.casefold() + '%')}")
    tests += [f"{c} {op} {v}" for c, op, v in (("modified_time", ">=", f.after), ("modified_time", "<", f.before), ("size", ">=", f.min_size), ("size", "<=", f.max_size)) if v is not None]
    return " AND ".join(tests) or "true"


def file_hits(q: Query) -> str:
    """CTEs up to file_hits (file columns, chunk_id, ordinal, hit_count, chunk_score, relevance_score)."""
    return f"""{matched(q)},
hits AS (SELECT *, score + {structure_boost(q)} + {location_boost(q)} AS chunk_score FROM scored),
winners AS (SELECT file_id, count(*) AS hit_count, min(struct_pack(a := chunk_score, b := ordinal, c := chunk_id)) AS w FROM hits GROUP BY file_id),
file_hits AS (
  SELECT f.*, w.c AS chunk_id, w.b AS ordinal, w.a AS chunk_score, hit_count,
    w.a + {filename_boost(q)} + CASE WHEN hit_count >= 3 THEN -0.24::DOUBLE WHEN hit_count = 2 THEN -0.12::DOUBLE ELSE 0.0::DOUBLE END AS relevance_score
  FROM winners JOIN files AS f USING (file_id) WHERE {metadata(q)}
)"""


ORDER = {
    "relevance": "round(relevance_score, 9), modified_time DESC, path",
    "modified": "modified_time DESC, round(relevance_score, 9), path",
    "filename": f"{lower('filename')}, filename, modified_time DESC, path",
    "browse": f"modified_time DESC, {lower('filename')}, path",
}


def window_hits(q: Query) -> str:
    return f"""{matched(q)},
ranked AS (
  SELECT f.*, chunk_id, ordinal, score + {filename_boost(q)} AS relevance_score FROM scored JOIN files AS f USING (file_id) WHERE {metadata(q)}
),
file_hits AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY round(relevance_score, 9), ordinal) = 1)"""


def progressive(q: Query, limit: int, multiplier: int, most: int) -> str:
    """The top files of the best chunks, whose number doubles until it holds `limit` files, is all or `most`."""
    first = min(limit * multiplier, max(limit, most))
    return f"""{matched(q)},
numbered AS (SELECT f.*, chunk_id, ordinal, score, row_number() OVER (ORDER BY score, chunk_id) AS n FROM scored JOIN files AS f USING (file_id) WHERE {metadata(q)}),
tries AS (SELECT least({most}, {first} * (1 << unnest(range(16)))) AS c),
judged AS (SELECT c, (SELECT count(*) FROM numbered) < c AS exhausted, (SELECT count(DISTINCT file_id) FROM numbered WHERE n <= c) AS files FROM tries),
stop AS (SELECT min(c) AS c FROM judged WHERE exhausted OR files >= {limit} OR c >= {most}),
part AS (SELECT *, score + {filename_boost(q)} AS relevance_score FROM numbered, stop WHERE n <= c),
best AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY round(relevance_score, 9), ordinal) = 1)
SELECT file_id, path, round(relevance_score, 6) AS score, row_number() OVER (ORDER BY {ORDER['relevance']})::INTEGER AS rank,
  least(c, (SELECT count(*) FROM numbered)) AS candidates_scanned, (SELECT count(*) FROM numbered) < c AS exhausted
FROM best ORDER BY {ORDER['relevance']} LIMIT {limit}"""


def folded(rows: str, target: int) -> str:
    """CTE runs (id, c, first, last, body) out of rows (id, i from 1, x, w): pieces gathered until their weights reach the
    target. The text that begins with it needs WITH RECURSIVE."""
    return f"""r AS MATERIALIZED ({rows}),
f AS (
  SELECT id, i, 0 AS c, w::BIGINT AS total FROM r WHERE i = 1
  UNION ALL SELECT r.id, r.i, CASE WHEN f.total >= {target} THEN f.c + 1 ELSE f.c END, CASE WHEN f.total >= {target} THEN r.w ELSE f.total + r.w END FROM f JOIN r ON r.id = f.id AND r.i = f.i + 1
),
runs AS (SELECT id, c, min(i) AS first, max(i) AS last, string_agg(x, chr(10) ORDER BY i) AS body FROM f JOIN r USING (id, i) GROUP BY id, c)"""


#: The white space that Python's strip() takes off, as far as texts have it.
STRIP = r"regexp_replace({}, '^[\s\x0b\x1c-\x1f\x85\xa0\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]+|[\s\x0b\x1c-\x1f\x85\xa0\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]+$', '', 'g')"


def stripped(c: str) -> str:
    return STRIP.format(c)


def whole_files(lane: str) -> str:
    """Whole files as one chunk each, for the file-level search."""
    if lane == "cjk":
        return CJK_SQL
    return "chunks AS (SELECT f.file_id AS chunk_id, f.file_id, 0 AS ordinal, f.filename, f.extension, '' AS location, coalesce(text, '') AS content FROM files AS f JOIN documents AS d ON d.doc_id = f.file_id)"
