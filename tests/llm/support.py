"""Small tables with everything that real ones hold."""

import random

ODD = [(1, "The quick brown fox jumps over the lazy dog near the river bank today"), (2, None), (3, ""),
       (4, " \n\t "), (4, " \n\t "), (None, "no id here at all but words enough to count them"),
       (6, "word " * 3000), (7, "é́ 漢字 \x1c <|endoftext|> '' it's  two  spaces\n\nlines\r\n"),
       (8, "x" * 20000), (9, "a\nb\na\nb\na"), (1, "same id, other text")]


def documents(spark, rows=ODD):
    """Extra columns have names that operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), 7, "deal") for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, deal string")


def words(seed, n):
    rng = random.Random(seed)
    parts = ["ka", "lo", "mi", "ter", "ven", "sor", "da", "ru", "pel", "go"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def text(seed, n=80):
    return " ".join(words(seed, n))
