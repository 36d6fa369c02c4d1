"""Small tables with nulls, empty and long texts, repeated rows and clashing names."""

from __future__ import annotations

import random

CLASHES = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, bucket string, ids string, score string, spans string, keys string, digest string, seed string"


def words(n: int, seed: int, vocabulary: int = 5000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def texts() -> list[str | None]:
    long = words(9000, 1)
    near = words(400, 2)
    parts = near.split(" ")
    parts[200] = "changed"
    passage = words(70, 3)
    return [
        None, "", "   \n", "one", "one two", "Äpfel und Birnen 🍐 in São Paulo", long, long, near, " ".join(parts),
        near, f"{words(30, 4)} {passage} {words(40, 5)}", f"{words(25, 6)} {passage} {words(10, 7)}",
        *[words(20 + i, 100 + i) for i in range(25)], *["same again and again"] * 12, words(60, 8) + "\tTAB\x0bEND",
    ]


def rows(values: list[str | None] | None = None) -> list[tuple]:
    out = [(i, t) for i, t in enumerate(texts() if values is None else values)]
    out += [out[3], out[-1]]  # repeated rows
    return [(i, t, "en", "s", len(t or ""), *["x"] * 9) for i, t in out]


def table(spark, values: list[str | None] | None = None):
    return spark.createDataFrame(rows(values), CLASHES)


def empty(spark):
    return spark.createDataFrame([], CLASHES)


def collected(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
