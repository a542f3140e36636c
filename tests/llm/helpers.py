"""Small tables with the awkward rows that every operator has to stand."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with those that operators use inside.
CLASHING = "k string, t string, block int, doc long, spans string, component int, score string, kept string, ids string"


def words(text):
    return WORD.findall(text or "")


def low_words(text):
    return WORD.findall((text or "").translate(FOLD))


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 7))) for _ in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = make(120)
    texts = []
    for i in range(n):
        body = make(rng.randint(1, 260))
        if i % 5 == 0:
            at = rng.randint(0, len(body))
            body[at:at] = shared[rng.randint(0, 40) : rng.randint(95, 120)]
        texts.append(" ".join(body))
    near = texts[7].split(" ")
    for i in range(8):
        changed = list(near)
        for _ in range(i):
            changed[rng.randrange(len(changed))] = "Edited"
        texts.append(" ".join(changed))
    texts += [texts[3], texts[3], texts[3].upper(), "", None, " \n\t ", "one", "Two words", "a b c d", "a b c d", "x\ry\x0bz\x0c\x1cq\x85r", "naïve 漢字　テスト end", "word " * 300, "\n".join(["same line here", "other", "same line here", ""] * 4)]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        kinds = [c.split(" ") for c in CLASHING.split(", ")]
        df = df.selectExpr("*", *[f"CAST(NULL AS {kind}) AS {name}" for name, kind in kinds])
    return df


def odd_rows():
    """Null ids, and an id that repeats with the same and with another text."""
    long = " ".join(f"w{i}" for i in range(80))
    return [(None, long, None, None, None), (None, None, None, None, None), (5, long, "en", "a", 1), (5, long, "en", "a", 1), (5, "other text " * 30, None, None, None), (9, long, "en", "a", 1)]
