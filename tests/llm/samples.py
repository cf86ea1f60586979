"""Small documents with every odd case, and helpers."""

import random

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, rep long, key string, row long, label int, size int, start int, base string, kept string, score double"


def rows(pairs):
    """Rows of SCHEMA with clashing extra columns."""
    return [(i, t, "en", f"s{(i or 0) % 3}" if i is None or i % 11 else None, len(t or ""), 1, 2, "k", 3, 4, 5, 6, "b", "no", 0.5) for i, t in pairs]


def words(rng, n, vocabulary=300):
    return [f"v{rng.randrange(vocabulary)}" for _ in range(n)]


def odd():
    return [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (4, "One"), (5, "a b c d"), (None, "no id here at all"), (None, None), (6, LONG), (7, "é😀 ñ　x y")]


def texts(seed, count, first=10):
    """Documents among which some copy, edit or quote others."""
    rng, out = random.Random(seed), []
    for i in range(count):
        kind = rng.random()
        if out and kind < 0.15:
            t = rng.choice(out)[1]
        elif out and kind < 0.45:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randrange(1, 8)):
                if w:
                    w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            t = " ".join(w)
        elif out and kind < 0.6:
            w = rng.choice(out)[1].split()
            a = rng.randrange(len(w) + 1)
            t = " ".join(words(rng, 15) + w[a : a + rng.randrange(40)] + words(rng, 15))
        else:
            t = " ".join(words(rng, rng.randrange(3, 120)))
        out.append((first + i, t))
    return out


def frame(spark, pairs, parts=3):
    return spark.createDataFrame(rows(pairs), SCHEMA).repartition(parts)
