"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone window garden letter morning paper silver engine market winter ship".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def documents(spark, rows):
    """rows of (doc_id, text), with the other columns of documents."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(seed: int = 5) -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows, near and exact copies, a long text."""
    rng = random.Random(seed)
    base = sentence(rng, 80).split()
    rows: list = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (None, "no id here")]
    rows += [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join(base).upper())]
    for k in range(13, 22):
        edited = list(base)
        for _ in range(k - 12):
            edited[rng.randrange(len(edited))] = "edit" + str(rng.randint(0, 99))
        rows.append((k, " ".join(edited)))
    rows += [(30 + k, sentence(rng, rng.randint(3, 60))) for k in range(20)]
    rows += [(60, "é" * 70), (61, "x" + "é" * 70), (62, "Ünïcode 漢字 text. " * 9), (63, "<|endoftext|> a <|endoftext|>")]
    rows += [(70, sentence(rng, 30000)), (35, rows[15][1])]
    return rows


def empty(spark):
    return spark.createDataFrame([], DOCS)
