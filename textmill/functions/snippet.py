"""Snippets around the earliest hit of a query's terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 52


def snippet(content: Column | str, terms: list[str], radius: int = RADIUS) -> Column:
    """`radius` code points either side of the earliest hit, newlines as spaces, every term marked;
    without a hit the first 2 * radius code points."""
    c = F.col(content) if isinstance(content, str) else content
    names = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    flat = lambda x: F.replace(x, F.lit("\n"), F.lit(" "))
    start = flat(F.substring(c, 1, 2 * radius))
    if not names:
        return start
    low = F.lower(c)
    places = F.array(*[F.struct(F.when(F.instr(low, t.lower()) > 0, F.instr(low, t.lower()) - 1).alias("at"), F.lit(i).alias("order"), F.lit(len(t)).alias("n")) for i, t in enumerate(names)])
    first = F.array_min(F.filter(places, lambda p: p["at"].isNotNull()))
    begin = F.greatest(first["at"] - radius, F.lit(0))
    end = F.least(first["at"] + first["n"] + radius, F.length(c))
    marked = F.regexp_replace(flat(F.substring(c, begin + 1, end - begin)), "(?iu)(" + "|".join(map(re.escape, names)) + ")", r"[[HIT]]$1[[/HIT]]")
    found = F.concat(F.when(begin > 0, "… ").otherwise(""), marked, F.when(end < F.length(c), " …").otherwise(""))
    return F.when(first.isNull(), start).otherwise(found)
