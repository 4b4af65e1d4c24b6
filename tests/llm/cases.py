"""Small tables with the awkward cases: nulls, empty and long texts, repeats, clashing names."""

import random


def texts(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(40)}" for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 5, 30, 200)))) for _ in range(n)]
    near = []
    for t in base[: n // 3]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    odd = [None, "", " \t\n", "A", "a", "É", "é", "x " * 5000, "same text here now", "SAME text here now", "\x85 nbsp\xa0word", "\x00"]
    return base + near + base[: n // 4] + odd + ["copy of one text"] * (n // 2)


def documents(spark, extra="keep_id string, id long, fp long, digest string, group_size int", seed=1, n=120):
    """documents with extra columns whose names an operator might use."""
    rows = [(i * 3 % 1009, t, ("en", "fr", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], None, "x", i, 5, "y", 1)
            for i, t in enumerate(texts(seed, n))]
    rows += [rows[5], rows[5], (None, "no id", None, None, None, "x", 1, 5, "y", 1), (None, "w1", None, None, 3, "x", 1, 5, "y", 1)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def empty(spark):
    return documents(spark).limit(0)
