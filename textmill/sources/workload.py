"""A synthetic office corpus with known selectivities, made by Spark, and twelve queries with exact hit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The corpus's names, words and queries, the first day and the spacing of files, and (in files()
# and expected()) the arithmetic of extensions, departments, days and sizes that gives the known hit counts.
DAY, START = 86400, 1735689600.0
EXTENSIONS = (".pdf", ".docx", ".xlsx", ".pptx")
DEPARTMENTS = ("信贷管理", "客户服务", "风险合规", "综合办公", "产品运营")
FILLER = " 本地办公资料 业务说明 操作规范 风险提示 服务记录 文档归档 "
EVERY = {"common": 4, "medium": 12, "rare": 200, "multi": 20, "phrase": 50, "named": 100}
QUERIES = {
    "common": "业务流程",
    "medium": "身份证有效期",
    "rare": "跨境专项复核",
    "filename only": "专项检查",
    "two terms": "客户经理 信贷政策",
    "phrase": '"customer manager"',
    "term + ext": "业务流程 ext:pdf",
    "term + path": "业务流程 path:信贷管理",
    "term + after": "身份证有效期 after:2026-01-01",
    "term + size": "业务流程 size:>1MB",
    "filter only": "ext:xlsx path:风险合规",
    "combined": "客户经理 信贷政策 ext:pdf path:信贷管理 after:2026-01-01",
}


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def files(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id")
    out = spark.range(n).select(i.alias("file_id"), _pick(EXTENSIONS, i * 7 + F.floor(i / 11)).alias("extension"), _pick(DEPARTMENTS, i * 3 + F.floor(i / 17)).alias("department"))
    f = F.col("file_id")
    stem = F.concat(F.when(f % EVERY["named"] == 0, "专项检查_").otherwise("办公资料_"), F.lpad(f.cast("string"), 6, "0"))
    out = out.withColumn("filename", F.concat(stem, "extension"))
    return out.select("file_id", F.concat_ws("/", F.lit("C:/办公资料"), "department", "filename").alias("path"), "filename", "extension", (F.lit(START) + DAY * (f % 600)).alias("modified_time"), ((64 + f % 2048) * 1024).alias("size"))


def chunks(spark: SparkSession, n: int, each: int = 3, chars: int = 1400) -> DataFrame:
    """`each` chunks a file of about `chars` characters; the marked terms stand in the first, second and last."""
    f, o = F.col("file_id"), F.col("ordinal")
    has = lambda name, text, at: F.when((f % EVERY[name] == 0) & (o == at), text)
    terms = F.concat_ws(" ", F.format_string("文档编号 %d 分块 %d", f, o + 1), has("common", "业务流程", 0), has("multi", "客户经理 信贷政策", 0), has("medium", "身份证有效期", min(1, each - 1)), has("phrase", "customer manager", min(1, each - 1)), has("rare", "跨境专项复核", each - 1))
    content = F.concat(terms, F.repeat(F.lit(FILLER), F.greatest(F.lit(0), F.floor((chars - F.length(terms)) / len(FILLER)).cast("int"))))
    out = files(spark, n).select("file_id", "filename", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("ordinal"))
    return out.select((f * each + o).alias("chunk_id"), "file_id", "ordinal", "filename", F.format_string("块 %d", o + 1).alias("location"), content.alias("content"))


def expected(n: int) -> dict[str, int]:
    """The hit counts of QUERIES over n files, by arithmetic."""

    def count(every: int, ext: str = "", department: str = "", days: int = 0, size: int = 0) -> int:
        return sum(
            (not ext or EXTENSIONS[(7 * i + i // 11) % 4] == ext)
            and (not department or DEPARTMENTS[(3 * i + i // 17) % 5] == department)
            and i % 600 >= days
            and (64 + i % 2048) * 1024 > size
            for i in range(0, n, every)
        )

    e = EVERY
    return {
        "common": count(e["common"]),
        "medium": count(e["medium"]),
        "rare": count(e["rare"]),
        "filename only": count(e["named"]),
        "two terms": count(e["multi"]),
        "phrase": count(e["phrase"]),
        "term + ext": count(e["common"], ".pdf"),
        "term + path": count(e["common"], "", DEPARTMENTS[0]),
        "term + after": count(e["medium"], days=365),
        "term + size": count(e["common"], size=1 << 20),
        "filter only": count(1, ".xlsx", DEPARTMENTS[2]),
        "combined": count(e["multi"], ".pdf", DEPARTMENTS[0], 365),
    }
