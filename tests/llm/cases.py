"""Rows with everything that text tables bring: nulls, blanks, long texts, ties, repeats and clashing columns."""

import random

#: Names that the operators use inside.
CLASHING = ["id", "c0", "c1", "ids", "size", "range", "found", "bands", "n_words", "language", "pii", "candidates", "single"]


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 6))) for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    base = words(1, 60)
    near = base.split()
    near[30] = "changed"
    return [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "!?"),
        (8, "one two"),
        (9, "One  TWO"),
        (10, words(2, 20_000)),
        (11, "x" * 50_000),
        (12, "Été ÀÉÎ naïve 日本語 ελληνικά Σ <|endoftext|> it's 12 ½"),
        (13, words(3, 200)),
        (13, words(3, 200)),
        (None, words(4, 30)),
        (None, None),
    ]


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(CLASHING)))
    return df
