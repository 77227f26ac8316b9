"""Fixture rows that every operator meets: nulls, empty and long texts, ties, repeated rows, other columns."""

import random

WORDS = "the of and river stone letter window garden market silver copper orange yellow table paper winter summer morning evening house".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        k = r.randint(4, 12)
        out.append((" ".join(r.choice(WORDS) + r.choice(["", "s", "ing", "ed"]) for _ in range(k))).capitalize() + r.choice([".", ".", "!", "?", ".\n"]))
        n -= k - 1
    return " ".join(out)


def rows():
    base = prose(1, 120)
    near = base.replace("river", "rivers", 1)
    passage = prose(7, 60)
    out = [
        (10, base), (11, base), (12, near), (13, prose(2, 200)), (14, prose(3, 80) + " " + passage + " " + prose(4, 80)),
        (15, prose(5, 40) + " " + passage + " " + prose(6, 90)), (16, ""), (17, None), (18, "one two"), (19, "One  two"), (20, "x"),
        (21, "   \n\t "), (22, "é" * 60 + " naïve Ünïcode 日本語 " + "\u0000 nul"), (23, "a" * 5000), (24, "a" * 4000),
        (25, prose(8, 4000)), (26, base), (None, base), (None, None), (12, near), (27, "ab" * 40), (28, "ba" * 40),
        (-5, prose(9, 60)), (29, prose(9, 60)),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "s", None if t is None else len(t)) for k, (i, t) in enumerate(out)]


def documents(spark, more=()):
    return spark.createDataFrame(rows() + [(i, t, "en", "s", len(t or "")) for i, t in more], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("chunk", "key", "blob", "content", "bucket", "token", "size", "found", "__x")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
