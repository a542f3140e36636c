"""The query language: terms, phrases, metadata filters and structure hints, parsed on the driver.

    ext:pdf  path:part  after:2026-01-01  before:2026-02-01  size:>=10KB  page:3  slide:2  sheet:name

A filter that does not parse is an ordinary term; of a repeated filter the last one counts. Dates are
midnights in UTC. Structure hints only work beside at least one term.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from textmill.functions import tokens

# The grammar of a size filter.
UNITS = {"B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3}
SIZE = re.compile(r"(>=|<=|>|<)?\s*(\d+(?:\.\d+)?)\s*(B|KB|MB|GB)?", re.I)

# Family selectors and their extensions.
FAMILIES = {
    "@writer": (".doc", ".docx", ".dot", ".rtf", ".wps", ".wpt", ".odt"),
    "@sheet": (".xls", ".xlsx", ".xlsb", ".xlt", ".et", ".ett", ".etx", ".ettx", ".ods", ".csv", ".tsv"),
    "@slides": (".ppt", ".pptx", ".pps", ".dps", ".dpt", ".odp"),
}


@dataclass(frozen=True)
class Term:
    text: str
    quoted: bool = False


@dataclass(frozen=True)
class Filters:
    extension: str | None = None
    path: str | None = None
    after: float | None = None
    before: float | None = None
    min_size: int | None = None
    max_size: int | None = None

    def extensions(self) -> tuple[str, ...]:
        return FAMILIES.get(self.extension, (self.extension,)) if self.extension else ()

    def any(self) -> bool:
        return self != Filters()


@dataclass(frozen=True)
class Hints:
    page: int | None = None
    slide: int | None = None
    sheet: str | None = None


@dataclass(frozen=True)
class Query:
    terms: tuple[Term, ...] = ()
    filters: Filters = Filters()
    hints: Hints = Hints()

    @property
    def plain(self) -> str:
        return " ".join(t.text for t in self.terms)

    @property
    def text(self) -> str:
        return render(self.terms)

    @property
    def lane(self) -> str:
        """cjk where every term is CJK only, white space apart; else word, for the whole query."""
        compact = ["".join(t.text.split()) for t in self.terms]
        return "cjk" if compact and all(c and all(map(tokens.is_cjk, c)) for c in compact) else "word"

    @property
    def phrases(self) -> list[list[str]]:
        """Every term's tokens in its lane. A term without tokens makes the query match nothing."""
        if self.lane == "cjk":
            return [tokens.query_bigrams("".join(t.text.split())) for t in self.terms]
        return [tokens.query_words(t.text) for t in self.terms]


def split(raw: str) -> list[Term]:
    """Terms between white space outside double quotes; quotes go, backslashes stay, an open quote is closed by the end."""
    out: list[Term] = []
    now, inside, quoted = "", False, False
    for char in [*raw.strip(), None]:
        if char == '"':
            quoted = quoted or not now
            inside = not inside
        elif char is None or char.isspace() and not inside:
            if now:
                out.append(Term(now, quoted))
                now, quoted = "", False
        else:
            now += char
    return out


def render(terms) -> str:
    """Terms as text; those with white space (or that were quoted) get their quotes back."""
    return " ".join('"' + t.text.replace('"', '""') + '"' if t.quoted or any(map(str.isspace, t.text)) else t.text for t in terms)


def midnight(value: str) -> float | None:
    try:
        return datetime.strptime(value, "%Y-%m-%d").replace(tzinfo=UTC).timestamp()
    except ValueError:
        return None


def size_bounds(value: str) -> tuple[int | None, int | None] | None:
    """The (least, most) bytes that a size filter admits, or None where it does not parse."""
    found = SIZE.fullmatch(value.strip())
    if not found:
        return None
    n = int(float(found[2]) * UNITS[(found[3] or "B").upper()])
    return {">": (n + 1, None), ">=": (n, None), "<": (None, max(n - 1, 0)), "<=": (None, n), None: (n, n)}[found[1]]


def _filter(filters: Filters, token: str) -> Filters | None:
    name, colon, value = token.partition(":")
    name, value = name.casefold(), value.strip()
    if not colon or not value:
        return None
    if name == "ext":
        return replace(filters, extension=(value if value.startswith(".") else "." + value).casefold())
    if name == "path":
        return replace(filters, path=value)
    if name in ("after", "before") and (at := midnight(value)) is not None:
        return replace(filters, **{name: at})
    if name == "size" and (bounds := size_bounds(value)) is not None:
        least, most = bounds
        return replace(filters, min_size=filters.min_size if least is None else least, max_size=filters.max_size if most is None else most)
    return None


def _hint(hints: Hints, token: str) -> Hints | None:
    name, colon, value = token.partition(":")
    name, value = name.casefold(), value.strip()
    if colon and name in ("page", "slide") and value.isdigit() and int(value) > 0:
        return replace(hints, **{name: int(value)})
    return replace(hints, sheet=value) if colon and name == "sheet" and value else None


def parse(raw: str, structure: bool = True) -> Query:
    filters, rest = Filters(), []
    for term in split(raw):
        changed = _filter(filters, term.text)
        if changed is None:
            rest.append(term)
        else:
            filters = changed
    hints, terms = Hints(), []
    for term in rest:
        changed = _hint(hints, term.text) if structure else None
        if changed is None:
            terms.append(term)
        else:
            hints = changed
    if not terms:
        return Query(tuple(rest), filters)
    return Query(tuple(terms), filters, hints)


def format_size(size: int) -> str:
    value, unit = float(max(0, size)), "B"
    for larger in ("KB", "MB", "GB"):
        if value < 1024:
            break
        value, unit = value / 1024, larger
    if unit == "B":
        return f"{int(value):,} B"
    return f"{value:.1f}".removesuffix(".0") + f" {unit}"


def format_date(at: float) -> str:
    return datetime.fromtimestamp(at, UTC).strftime("%Y-%m-%d")


def _bounds(f: Filters, one: str, low: str, high: str, both: str, say) -> str | None:
    """The size bounds in words: patterns for an exact size, a lower bound, an upper one, and two of them."""
    least, most = (None if n is None else say(n) for n in (f.min_size, f.max_size))
    pattern = both if least is not None and most is not None else low if least is not None else high
    return (one if f.min_size == f.max_size else pattern).format(least, most)


def _quoted(path: str) -> str:
    return f'"{path}"' if any(map(str.isspace, path)) else path


# Every filter in the order in which chips stand: its key, its fields, its label and its text in a query.
CLAUSES = (
    ("extension", ("extension",), lambda f: f"类型 · {f.extension.lstrip('.').upper()}", lambda f: f"ext:{f.extension.lstrip('.')}"),
    ("path", ("path",), lambda f: f"路径 · {f.path}", lambda f: f"path:{_quoted(f.path)}"),
    ("after", ("after",), lambda f: f"修改时间 ≥ {format_date(f.after)}", lambda f: f"after:{format_date(f.after)}"),
    ("before", ("before",), lambda f: f"修改时间 < {format_date(f.before)}", lambda f: f"before:{format_date(f.before)}"),
    ("size", ("min_size", "max_size"), lambda f: _bounds(f, "大小 · {0}", "大小 ≥ {0}", "大小 ≤ {1}", "大小 · {0} ～ {1}", format_size), lambda f: _bounds(f, "size:{0}B", "size:>={0}B", "size:<={1}B", "size:>={0}B size:<={1}B", str)),
)


def _stated(f: Filters):
    """The clauses that a query's filters state."""
    return (c for c in CLAUSES if any(getattr(f, field) is not None for field in c[1]))


def chips(raw: str) -> list[tuple[str, str]]:
    """(key, label) of each effective filter; both size bounds are one."""
    f = parse(raw).filters
    return [(key, label(f)) for key, _, label, _ in _stated(f)]


def without(raw: str, key: str) -> str:
    """The query in normal form without one filter."""
    q = parse(raw, structure=False)
    terms = render(Term(t.text) for t in q.terms)
    return " ".join(filter(None, [terms, *(text(q.filters) for name, _, _, text in _stated(q.filters) if name != key)]))


# How a search is named in a history.
ALL, FAMILY_NAMES, SORT_NAMES = "全部内容", {"@writer": "文字文档", "@sheet": "电子表格", "@slides": "演示文稿"}, {"modified": "最近修改", "filename": "文件名排序"}


def state_label(query: str, extension: str | None = None, sort: str = "relevance", most: int = 44) -> str:
    """A search in one line: its text, cut to `most` characters, then its format and its order, if not the usual."""
    if sort not in ("relevance", *SORT_NAMES):
        raise ValueError(f"unsupported sort mode: {sort}")
    query = query.strip() or ALL
    short = query if len(query) <= most else query[: most - 1] + "…"
    kind = (extension or "").strip().lower()
    kind = FAMILY_NAMES.get(kind) or kind.lstrip(".").upper()
    details = " · ".join(filter(None, [kind, SORT_NAMES.get(sort)]))
    return f"{short}  ·  {details}" if details else short
