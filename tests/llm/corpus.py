"""Small documents with copies, near copies, shared passages and the odd cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, rank int, copies int"


def documents(seed: int = 1, n: int = 60):
    rng = random.Random(seed)
    stems = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ar", "en", "il", "os", "um")]
    passage = " ".join(rng.choice(stems) for _ in range(40))
    texts: list[str | None] = []
    for k in range(n):
        words = [rng.choice(stems) + rng.choice(stems) for _ in range(rng.randint(5, 120))]
        if k % 5 == 1:
            words[2:2] = passage.split()
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    texts += [texts[3], texts[3], texts[7].upper(), texts[4] + " tail", texts[8][: len(texts[8]) // 2]]
    near = texts[9].split()
    for k in range(12):
        copy = near * 3
        copy[rng.randrange(len(copy))] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [None, "", "   \t\n", "one", "one two", "One TWO", "é ü", "a a a a a a a a a a a a a a a a a a a a a a a a a a a", "x\x01y \x01 z", " ".join(["pad"] * 400)]
    rows = []
    for k, t in enumerate(texts):
        rows.append((k * 3 + 1, t, ["en", "de", None][k % 3], [None, "a", "b", "Z", "é"][k % 5], len(t or ""), 7, "n", 1, 9))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
