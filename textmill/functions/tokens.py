"""Tokenisers as column expressions; no Python on the executors.

Two lanes: words (case-folded, accents stripped, maximal runs of letters, digits and private-use
characters) and CJK bigrams (overlapping pairs inside each CJK run; a run of one is itself). The
array index of a token is its position.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}\p{Co}]+"
CJK_RUN = "[㐀-䶿一-鿿]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@functools.lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Accented letters and the base letter that their decomposition starts with; final sigma folds too."""
    accented, base = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            accented.append(char)
            base.append(parts[0])
    return "".join(accented) + "ς", "".join(base) + "σ"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only."""
    return F.translate(_col(c), UPPER, LOWER)


def fold(c: Column | str) -> Column:
    """Lower case without the accents of the table."""
    accented, base = accent_table()
    return F.translate(F.lower(_col(c)), accented, base)


def words(c: Column | str) -> Column:
    """Combining marks go before the split: inside a word they are dropped, elsewhere they begin none."""
    return F.regexp_extract_all(F.regexp_replace(fold(c), r"\p{Mn}+", ""), F.lit(WORD), F.lit(0))


def cjk_bigrams(c: Column | str) -> Column:
    runs = F.regexp_extract_all(_col(c), F.lit(CJK_RUN), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, 2))))
    return F.flatten(pairs)


def trigrams(c: Column | str) -> Column:
    low = F.lower(_col(c))
    return F.when(F.length(low) < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, 3)))


LANES = {"word": words, "cjk": cjk_bigrams}


def query_words(text: str) -> list[str]:
    """The word lane's tokens of a query term, on the driver."""
    accented, base = accent_table()
    folded = text.lower().translate(str.maketrans(accented, base))
    out, now = [], ""
    for char in folded:
        kind = unicodedata.category(char)
        if kind[0] in "LN" or kind == "Co":
            now += char
        elif kind == "Mn" and now:
            continue
        elif now:
            out.append(now)
            now = ""
    return [*out, now] if now else out


def is_cjk(char: str) -> bool:
    return "㐀" <= char <= "䶿" or "一" <= char <= "鿿"


def query_bigrams(text: str) -> list[str]:
    out, run = [], ""
    for char in text + " ":
        if is_cjk(char):
            run += char
            continue
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
        run = ""
    return out
