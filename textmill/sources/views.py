"""Search tables derived from the driver tables, as DataFrames and as the same rules in SQL.

files: one row per document; chunks: its lines that are not blank, with locations in the grammar of
the file's format; cjk: deterministic CJK chunks with decoys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".pdf", ".docx", ".xlsx", ".pptx", ".txt")
HOUR = 3600
START = 1733011200.0
DIGITS, IDEOGRAPHS = "0123456789", "客户经理信贷业务管办"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _extension(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, EXTENSIONS)), (i % 5 + 1).cast("int"))


def _padded(i: Column) -> Column:
    """Six digits at least; lpad alone would cut longer ids."""
    digits = i.cast("string")
    return F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), "0")


def _chunk_id(i: Column, ordinal: Column) -> Column:
    """A hundred thousand ids for each file; a longer file's further lines have negative ones. Too large a file id fails."""
    return F.when(ordinal < 100000, i * 100000 + ordinal).otherwise(-(i * (1 << 31) + ordinal))


def _with_file(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.when(i % 100 == 0, "report_").otherwise("doc_"), _padded(i), _extension(i))
    out = docs.select(F.col("doc_id").alias("file_id"), "source", "lang", _extension(i).alias("extension"), name.alias("filename"), *[c for c in docs.columns if c == "text"])
    out = out.withColumn("path", F.concat_ws("/", F.lit("/corpus"), "source", "lang", "filename"))
    f = F.col("file_id")
    return out.withColumns({"modified_time": F.lit(START) + HOUR * (f * 37 % 9001), "size": 4096 + f * 2741 % 2200003})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return _with_file(docs).select("file_id", "path", "filename", "extension", "modified_time", "size")


def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with their whole text as content, those without text too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return _with_file(docs).select("file_id", "path", "filename", "extension", "modified_time", "size", F.coalesce("text", F.lit("")).alias("content"))


def location(extension: Column, n: Column, source: Column) -> Column:
    """A chunk's label by its file's format; n counts from 1."""
    return (
        F.when(extension == ".pdf", F.concat(F.lit("第 "), n, F.lit(" 页")))
        .when(extension == ".docx", F.concat(F.lit("文档块 "), n, F.lit("-"), n, F.lit(" · 标题 "), source))
        .when(extension == ".xlsx", F.concat(F.lit("工作表 "), source, F.lit(" · 行 "), n, F.lit("-"), n))
        .when(extension == ".pptx", F.concat(F.lit("幻灯片 "), n, F.lit(" · 标题 "), source))
        .otherwise(F.concat(F.lit("行 "), n, F.lit("-"), n))
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, file_id, ordinal, filename, extension, location, content."""
    docs = _with_file(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    out = docs.select("file_id", "filename", "extension", "source", F.posexplode(lines).alias("ordinal", "content"))
    n = (F.col("ordinal") + 1).cast("string")
    return out.select(_chunk_id(F.col("file_id"), F.col("ordinal")).alias("chunk_id"), "file_id", "ordinal", "filename", "extension", location(F.col("extension"), n, F.col("source")).alias("location"), "content")


def cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CJK chunk per document: its digits as ideographs, and every third with the pairs torn apart."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"))
    word = F.translate(_padded(F.col("file_id")), DIGITS, IDEOGRAPHS)
    torn = F.concat_ws("，", F.substring(word, 1, 2), F.substring(word, 2, 2), F.substring(word, F.lit(3), F.length(word)))
    content = F.when(F.col("file_id") % 3 == 0, torn).otherwise(F.concat(F.lit("的"), F.lit(" "), word, F.lit("客户经理")))
    return docs.select(F.col("file_id").alias("chunk_id"), "file_id", F.lit(0).alias("ordinal"), F.concat(F.lit("doc_"), F.col("file_id").cast("string")).alias("filename"), F.lit(".txt").alias("extension"), F.lit("行 1-1").alias("location"), content.alias("content"))


FILES_SQL = """files AS (
  SELECT doc_id AS file_id, '/corpus/' || source || '/' || lang || '/' || name || ext AS path, name || ext AS filename, ext AS extension,
    1733011200.0::DOUBLE + 3600 * (doc_id * 37 % 9001) AS modified_time, 4096 + doc_id * 2741 % 2200003 AS size, source
  FROM (SELECT doc_id, source, lang, CASE WHEN doc_id % 100 = 0 THEN 'report_' ELSE 'doc_' END || lpad(doc_id::VARCHAR, greatest(6, length(doc_id::VARCHAR))::INTEGER, '0') AS name,
    (['.pdf', '.docx', '.xlsx', '.pptx', '.txt'])[doc_id % 5 + 1] AS ext FROM documents)
)"""

CHUNKS_SQL = """chunks AS (
  SELECT CASE WHEN ordinal < 100000 THEN file_id * 100000 + ordinal ELSE -(file_id * 2147483648 + ordinal) END AS chunk_id, file_id, ordinal, filename, extension,
    CASE extension WHEN '.pdf' THEN '第 ' || n || ' 页' WHEN '.docx' THEN '文档块 ' || n || '-' || n || ' · 标题 ' || source
      WHEN '.xlsx' THEN '工作表 ' || source || ' · 行 ' || n || '-' || n WHEN '.pptx' THEN '幻灯片 ' || n || ' · 标题 ' || source
      ELSE '行 ' || n || '-' || n END AS location, content
  FROM (SELECT *, (ordinal + 1)::VARCHAR AS n FROM (
    SELECT f.file_id, f.filename, f.extension, f.source, unnest(range(len(l))) AS ordinal, unnest(l) AS content
    FROM files AS f JOIN (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0) AS l FROM documents) AS d ON d.doc_id = f.file_id
  ))
)"""

CJK_SQL = """chunks AS (
  SELECT doc_id AS chunk_id, doc_id AS file_id, 0 AS ordinal, 'doc_' || doc_id AS filename, '.txt' AS extension, '行 1-1' AS location,
    CASE WHEN doc_id % 3 = 0 THEN w[1:2] || '，' || w[2:3] || '，' || w[3:] ELSE '的 ' || w || '客户经理' END AS content
  FROM (SELECT doc_id, translate(lpad(doc_id::VARCHAR, greatest(6, length(doc_id::VARCHAR))::INTEGER, '0'), '0123456789', '客户经理信贷业务管办') AS w FROM documents)
)"""
