"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of error codes.
ERROR_LABELS = {
    "file_too_large": "文件过大",
    "permission_denied": "无访问权限",
    "file_not_found": "文件已不存在",
    "BadZipFile": "Office 文件损坏或格式异常",
    "FileDataError": "文件数据异常",
    "EmptyFileError": "空文件或无法解析",
    "PackageNotFoundError": "Office 文件损坏、加密或格式与扩展名不一致",
    "ParseError": "XML 文件损坏或结构异常",
    "AdapterUnavailable": "缺少可用的本地解析组件",
    "LegacyExtractionTimeout": "兼容格式解析超时",
    "LegacyExtractionError": "兼容格式解析失败",
    "ParserInterrupted": "上次解析被异常中断，已暂停自动重试",
    "ParserCancelled": "解析已跳过",
    "ParserQuarantined": "文件多次异常，已隔离并停止自动重试",
    "os_error": "系统访问错误",
}
ERROR_STATUS = {"LegacyExtractionTimeout": "TIMEOUT", "ParserInterrupted": "INTERRUPTED", "ParserCancelled": "SKIPPED"}
FAILURES = ("FAILED", "TIMEOUT")
MANUAL = ("SKIPPED", "INTERRUPTED", "QUARANTINED")
# The location grammar of each family.
LOCATIONS = {
    "pdf": r"^第\s*(\d+)\s*页$",
    "presentation": r"^幻灯片\s*(\d+)(?:\s*·\s*标题\s+(.+))?$",
    "spreadsheet": r"^工作表\s+(.+?)\s*·\s*行\s+(\d+)-(\d+)$",
    "text": r"^行\s+(\d+)-(\d+)$",
    "writer": r"^文档块\s+(\d+)-(\d+)(?:\s*·\s*标题\s+(.+))?$",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@functools.lru_cache(maxsize=1)
def _capitals() -> tuple[str, str]:
    """Characters that have a capital of one character, and these capitals; ß has ẞ."""
    found = {"ß": "ẞ"}
    for c in map(chr, range(sys.maxunicode + 1)):
        one = next((x for x in (c.upper(), c.title()) if len(x) == 1), c)
        if one != c:
            found[c] = one
    return "".join(found), "".join(found.values())


def upper(c: Column | str) -> Column:
    """Capitals character by character, as SQL has them; Spark's own make SS of ß, and two letters of a ligature."""
    return F.translate(_col(c), *_capitals())


def stem(filename: Column | str, extension: Column | str) -> Column:
    return F.substring(_col(filename), F.lit(1), F.length(_col(filename)) - F.length(_col(extension)))


def compact(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(" "), F.lit(""))


def clean_title(c: Column | str, most: int = 80) -> Column:
    """White space as single spaces; a longer title is cut and ends in three dots."""
    t = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))


def is_heading(style: Column | str) -> Column:
    s = F.trim(_col(style))
    return F.lower(s).startswith("heading") | (F.lower(s) == "title") | s.startswith("标题")


def sheet_row(cells: Column | str) -> Column:
    """Cells joined by tabs: nulls empty, empty cells at the end dropped, those inside kept."""
    filled = F.transform(_col(cells), lambda x: F.coalesce(x.cast("string"), F.lit("")))
    return F.regexp_replace(F.array_join(filled, "\t"), r"\t+$", "")


def locator(family: Column | str, location: Column | str) -> Column:
    """A location label as struct<kind, title, page, slide, sheet, row_start, ... block_end>."""
    fam, loc = _col(family), _col(location)
    ok = {f: (fam == f) & loc.rlike(p) for f, p in LOCATIONS.items()}
    part = lambda f, i: F.nullif(F.regexp_extract(loc, LOCATIONS[f], i), F.lit(""))
    number = lambda f, i: F.when(ok[f], part(f, i).cast("int"))
    kind = F.when(ok["pdf"], "page").when(ok["presentation"], "slide").when(ok["spreadsheet"], "sheet_rows").when(ok["text"], "text_range").when(ok["writer"], "writer_block").otherwise("generic")
    sheet = F.when(ok["spreadsheet"], part("spreadsheet", 1))
    return F.struct(
        kind.alias("kind"),
        F.when(ok["presentation"], part("presentation", 2)).when(ok["writer"], part("writer", 3)).otherwise(sheet).alias("title"),
        number("pdf", 1).alias("page"),
        number("presentation", 1).alias("slide"),
        sheet.alias("sheet"),
        number("spreadsheet", 2).alias("row_start"),
        number("spreadsheet", 3).alias("row_end"),
        number("text", 1).alias("line_start"),
        number("text", 2).alias("line_end"),
        number("writer", 1).alias("block_start"),
        number("writer", 2).alias("block_end"),
    )


def preview_location(extension: Column | str, s: Column, location: Column | str) -> Column:
    """A label written from the typed locator where there is one, else the stored label."""
    ext = F.lower(_col(extension))
    return (
        F.when((ext == ".pdf") & (F.coalesce(s["page"], F.lit(0)) != 0), F.format_string("第 %d 页", s["page"]))
        .when((ext == ".xlsx") & s["sheet"].isNotNull() & (F.coalesce(s["row_start"], F.lit(0)) != 0), F.format_string("工作表 %s · 行 %d-%d", s["sheet"], s["row_start"], s["row_end"]))
        .otherwise(_col(location))
    )


def retry_delay(status: Column | str, failures: Column | str) -> Column:
    """Seconds until a failed file is tried again: 300 or 1800 doubled by each further failure, at most a day."""
    s, n = _col(status), _col(failures)
    base = F.when(s == "TIMEOUT", 1800.0).otherwise(300.0)
    power = F.greatest(F.lit(0), F.least(n - 1, F.lit(8)))
    return F.when(s.isin(*FAILURES), F.least(base * F.pow(F.lit(2.0), power), F.lit(86400.0))).otherwise(0.0)


def status_of_result(extension: Column | str, chunks: Column | str) -> Column:
    return F.when(_col(chunks) > 0, "INDEXED").when(F.lower(F.trim(_col(extension))) == ".pdf", "OCR_REQUIRED").otherwise("NO_TEXT")


def status_of_error(code: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ERROR_STATUS.items() for x in kv]), _col(code)), F.lit("FAILED"))


def error_label(code: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ERROR_LABELS.items() for x in kv]), _col(code)), _col(code))


def format_size(size: Column | str, largest: str = "TB") -> Column:
    """Bytes as `12 B` or one decimal in the largest unit below 1024, up to `largest`."""
    v = F.greatest(_col(size), F.lit(0)).cast("double")
    out = F.when(v < 1024, F.concat(v.cast("long").cast("string"), F.lit(" B")))
    units = ["KB", "MB", "GB", "TB"]
    units = units[: units.index(largest) + 1]
    for i, unit in enumerate(units, 1):
        text = F.concat(F.format_string("%.1f", F.round(v / 1024.0**i, 1)), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == largest else out.when(v < 1024.0 ** (i + 1), text)
    return out


def format_date(at: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    """Epoch seconds as a date in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(_col(at)), F.current_timezone()), pattern)


def decode_states(raw: Column | str) -> Column:
    """A setting's JSON list of search states: entries that name a query or an extension and a known sort."""
    listed = F.from_json(_col(raw), "array<struct<query:string,extension:string,sort_mode:string>>")
    trimmed = F.transform(
        F.filter(listed, lambda x: x.isNotNull()),
        lambda x: F.struct(
            F.trim(F.coalesce(x.query, F.lit(""))).alias("query"),
            F.when(F.trim(x.extension) == "", None).when(F.lower(F.trim(x.extension)).rlike(r"^[.@]"), F.lower(F.trim(x.extension))).otherwise(F.concat(F.lit("."), F.lower(F.trim(x.extension)))).alias("extension"),
            F.coalesce(x.sort_mode, F.lit("relevance")).alias("sort_mode"),
        ),
    )
    return F.coalesce(F.filter(trimmed, lambda x: x.sort_mode.isin("relevance", "modified", "filename") & ((x.query != "") | x.extension.isNotNull())), F.array().cast("array<struct<query:string,extension:string,sort_mode:string>>"))
