"""The registry of document formats, enabled formats, scan filters and adapter choice."""

from __future__ import annotations

import fnmatch
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Each extension with its family and the modes that can read it, best first.
FORMATS: dict[str, tuple[str, tuple[str, ...]]] = {
    ".txt": ("text", ("direct",)),
    ".md": ("text", ("direct",)),
    ".log": ("text", ("direct",)),
    ".csv": ("text", ("direct",)),
    ".tsv": ("text", ("direct", "tika-native",)),
    ".html": ("text", ("direct", "tika-native",)),
    ".htm": ("text", ("direct", "tika-native",)),
    ".xhtml": ("text", ("direct", "tika-native",)),
    ".xml": ("text", ("direct", "tika-native",)),
    ".docx": ("writer", ("direct",)),
    ".doc": ("writer", ("tika-native", "wps-local",)),
    ".dot": ("writer", ("tika-native", "wps-local",)),
    ".rtf": ("writer", ("tika-native", "wps-local",)),
    ".wps": ("writer", ("tika-native", "wps-local",)),
    ".odt": ("writer", ("tika-native",)),
    ".epub": ("writer", ("tika-native",)),
    ".eml": ("writer", ("tika-native",)),
    ".msg": ("writer", ("tika-native",)),
    ".mbox": ("writer", ("tika-native",)),
    ".pst": ("writer", ("tika-native",)),
    ".pages": ("writer", ("tika-native",)),
    ".wpt": ("writer", ("wps-local",)),
    ".xlsx": ("spreadsheet", ("direct",)),
    ".xls": ("spreadsheet", ("calamine", "tika-native", "wps-local",)),
    ".xlsb": ("spreadsheet", ("calamine", "tika-native",)),
    ".ods": ("spreadsheet", ("calamine", "tika-native",)),
    ".numbers": ("spreadsheet", ("tika-native",)),
    ".et": ("spreadsheet", ("tika-native", "wps-local",)),
    ".ett": ("spreadsheet", ("tika-native", "wps-local",)),
    ".etx": ("spreadsheet", ("tika-native", "wps-local",)),
    ".ettx": ("spreadsheet", ("tika-native", "wps-local",)),
    ".xlt": ("spreadsheet", ("tika-native", "wps-local",)),
    ".pptx": ("presentation", ("direct", "tika-native", "wps-local",)),
    ".ppt": ("presentation", ("tika-native", "wps-local",)),
    ".pps": ("presentation", ("tika-native", "wps-local",)),
    ".dps": ("presentation", ("tika-native", "wps-local",)),
    ".odp": ("presentation", ("tika-native",)),
    ".key": ("presentation", ("tika-native",)),
    ".dpt": ("presentation", ("wps-local",)),
    ".pdf": ("pdf", ("direct",)),
}
# The formats that a new index reads, those of the first and third priority lanes, folders that a
# scan does not enter, and the extractor's revision where it is not 1.
DEFAULT_ENABLED = (
    ".csv", ".doc", ".docx", ".dot", ".dps", ".dpt", ".et", ".ett", ".ettx", ".etx",
    ".htm", ".html", ".log", ".md", ".pdf", ".pps", ".ppt", ".pptx", ".rtf", ".tsv",
    ".txt", ".wps", ".wpt", ".xhtml", ".xls", ".xlsb", ".xlsx", ".xlt",
)
MODERN = (
    ".docx", ".xlsx", ".pptx", ".pdf",
)
COMPATIBLE = (
    ".doc", ".dot", ".rtf", ".odt", ".ppt", ".pps", ".odp", ".xls", ".xlsb", ".ods",
    ".wps", ".wpt", ".et", ".ett", ".etx", ".ettx", ".xlt", ".dps", ".dpt",
)
IGNORED_DIRS = (
    ".git", ".svn", ".hg", ".idea", ".mypy_cache", ".pytest_cache", ".tox", ".venv", "__pycache__", "node_modules",
    "venv", "$recycle.bin", "system volume information",
)
REVISIONS = {".docx": 3, ".pptx": 2, ".html": 2, ".htm": 2, ".xhtml": 2, ".xml": 3, ".tsv": 2}
OLE_MAGIC = "D0CF11E0A1B11AE1"
MAX_PATTERNS, MAX_PATTERN = 100, 120


def registry(spark: SparkSession) -> DataFrame:
    """extension, family, modes, preferred: a dimension of fixed size."""
    rows = [(e, f, list(m), m[0]) for e, (f, m) in FORMATS.items()]
    return spark.createDataFrame(rows, "extension string, family string, modes array<string>, preferred string")


def normalise(ext: Column | str) -> Column:
    low = F.lower(F.trim(F.col(ext) if isinstance(ext, str) else ext))
    return F.when(low == "", "").when(low.startswith("."), low).otherwise(F.concat(F.lit("."), low))


def family(ext: Column | str) -> Column:
    pairs = [F.lit(x) for e, (f, _) in FORMATS.items() for x in (e, f)]
    return F.try_element_at(F.create_map(*pairs), normalise(ext))


def decode_enabled(raw: Column | str) -> Column:
    """A JSON list as known extensions, normal and sorted; anything but a list: every known extension."""
    c = F.col(raw) if isinstance(raw, str) else raw
    known = F.array(*map(F.lit, sorted(FORMATS)))
    listed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    return F.coalesce(F.array_sort(F.array_intersect(F.array_distinct(F.transform(listed, normalise)), known)), known)


def revision(ext: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REVISIONS.items() for x in kv]), normalise(ext)), F.lit(1))


def lane(ext: Column | str) -> Column:
    """0 modern office, 1 other formats read directly, 2 office compatibility, 3 the rest."""
    e = normalise(ext)
    direct = [x for x, (_, m) in FORMATS.items() if "direct" in m]
    return F.when(e.isin(*MODERN), 0).when(e.isin(*direct), 1).when(e.isin(*COMPATIBLE), 2).otherwise(3)


def adapter(ext: Column | str, head_hex: Column | str) -> Column:
    """The reader of a file: the first mode, but a .pptx in an OLE container skips the direct one."""
    pairs = [F.lit(x) for e, (_, m) in FORMATS.items() for x in (e, m[0])]
    first = F.try_element_at(F.create_map(*pairs), normalise(ext))
    head = F.col(head_hex) if isinstance(head_hex, str) else head_hex
    return F.when((normalise(ext) == ".pptx") & head.startswith(OLE_MAGIC), FORMATS[".pptx"][1][1]).otherwise(first)


def name_of(path: Column | str) -> Column:
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)


def scannable(path: str = "path", enabled: tuple[str, ...] = DEFAULT_ENABLED) -> Column:
    """An enabled extension, and neither an office lock file nor a temporary one."""
    name = name_of(path)
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*enabled) & ~name.startswith("~$") & ~name.endswith(".tmp")


def in_ignored_dir(path: str = "path") -> Column:
    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, IGNORED_DIRS)))


def under(path: Column, root: Column) -> Column:
    """The path is the root or below it; a sibling that begins alike is not."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def exclude_paths(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files without those under one of `roots` (root); a path has few parents, so each is looked up by equality."""
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    gone = files.select("path", F.explode(parents).alias("root")).join(roots, "root", "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti")


class InvalidPattern(ValueError):
    pass


def normal_pattern(raw: str) -> str:
    pattern = raw.strip()
    if not pattern or len(pattern) > MAX_PATTERN or set("/\\") & set(pattern) or pattern in ("*", "*.*"):
        raise InvalidPattern(pattern)
    return "*" + pattern if pattern.startswith(".") and not set("*?[") & set(pattern) else pattern


def normal_patterns(raws) -> list[str]:
    """Patterns in normal form, the first of each spelling; blanks are skipped, bad ones raise."""
    out = {}
    for raw in raws:
        if raw.strip():
            p = normal_pattern(raw)
            out.setdefault(p.casefold(), p)
    if len(out) > MAX_PATTERNS:
        raise InvalidPattern(f"more than {MAX_PATTERNS} patterns")
    return list(out.values())


def decode_patterns(raw: str | None) -> list[str]:
    """Patterns out of a setting; what does not parse is left out."""
    try:
        listed = json.loads(raw or "[]")
    except ValueError:
        return []
    out: dict[str, str] = {}
    for item in listed if isinstance(listed, list) else []:
        try:
            p = normal_pattern(str(item))
        except InvalidPattern:
            continue
        out.setdefault(p.casefold(), p)
    return list(out.values())[:MAX_PATTERNS]


def matches_glob(path: str, patterns: list[str]) -> Column:
    """The base name matches one of the patterns, whatever the case."""
    found = [re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(p.casefold())) for p in patterns]
    return F.lower(name_of(path)).rlike("(?s)^(?:" + "|".join(found) + r")\z") if found else F.lit(False)


def oversize(files: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(files to read, issue rows of those above the limit)."""
    most = min(4096 << 20, max(1, most))
    issues = files.where(F.col("size") > most).select("path", F.lit("file_too_large").alias("error_code"))
    return files.where(F.col("size") <= most), issues



def scan_backend(name: str | None = None) -> str:
    """The lister that an option names: auto (or nothing) and spark are Spark's parallel listing, python a walk on the
    driver for file systems that Spark does not reach. Anything else is an error."""
    chosen = (name or "").strip().casefold() or "auto"
    if chosen not in ("auto", "spark", "python"):
        raise ValueError("the scan backend must be one of 'auto', 'spark' or 'python'")
    return "spark" if chosen == "auto" else chosen
