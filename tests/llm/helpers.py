"""Small document tables and brute-force versions of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("key", "kept", "vertex", "text_key", "low", "tag", "component", "found", "value", "host", "path", "stratum", "n", "_key", "item_id")


def frame(spark, rows, clashing=False):
    """Documents from (doc_id, text) pairs; ``clashing`` adds columns named like the operators' own."""
    full = [(i, t, "en" if (i or 0) % 2 else "fr", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    if clashing:
        df = df.selectExpr("*", *[f"doc_id AS {c}" for c in CLASH])
    return df


ODD = [
    (None, "no id here, but a text of some words"), (None, None), (900, None), (901, ""), (902, " \t\n "), (903, "one"),
    (904, "a b c"), (905, "a b c"), (905, "a b c"), (906, "x " * 6000), (907, "é😀 ſ \x0b\x0c K " * 30), (908, "\n\n\n"), (None, "no id here, but a text of some words"),
]


def documents(n, seed=1, alphabet=60, low=0, high=150):
    """Texts that copy, extend and cut each other."""
    rng = random.Random(seed)
    words = [f"w{i}" if i % 7 else f"é{i}" for i in range(alphabet)]
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            text = rng.choice(out)[1]
        elif out and kind < 0.45:
            parts = rng.choice(out)[1].split(" ")
            for _ in range(rng.randrange(3)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        elif out and kind < 0.7:
            parts = rng.choice(out)[1].split(" ")
            a = rng.randrange(len(parts))
            b = rng.randrange(a, len(parts) + 1)
            text = " ".join([rng.choice(words) for _ in range(rng.randrange(5))] + parts[a:b] + [rng.choice(words) for _ in range(rng.randrange(9))])
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(low, high)))
        out.append((i, text))
    return out


def sortable(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in r))
