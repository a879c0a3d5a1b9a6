"""Small tables with copies, edits, shared passages and odd rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, anchor string, _key string, n_chars long"


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed=1, n=60):
    """(doc_id, text) with copies, near copies, passages in many rows, repeats within a row, and edge cases."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(n)]
    passage = prose(rng, 45)
    rows = []
    for k, w in enumerate(base):
        kind = k % 6
        if kind == 1:
            w = list(base[k - 1])
        elif kind == 2:
            w = list(base[k - 2])
            if w:
                w[rng.randrange(len(w))] = "edited"
        elif kind == 3:
            w = w[:10] + passage + w[10:]
        elif kind == 4:
            w = w + w
        rows.append((k * 3, rng.choice([" ", "\n", "  ", "\t"]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "a " * 300), (1005, "x" * 500), (1006, "ONE"), (1007, "é" * 120)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    """With extra columns whose names an operator might use itself."""
    return spark.createDataFrame([(i, t, "a", "k", None) for i, t in rows], SCHEMA).repartition(parts)
