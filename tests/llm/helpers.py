"""Small corpora with the cases that operators must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, pool: int = 400) -> list[str]:
    return ["".join(chr(97 + (w * 7 + k * 11) % 26) for k in range(3 + w % 5)) for w in (rng.randrange(pool) for _ in range(n))]


def frame(spark, texts, extra: str | None = None):
    """Rows (doc_id, text) with languages and sources, and maybe a column whose name may clash."""
    rows = [(i, t, "en" if i is None or i % 2 else "fr", f"src{(i or 0) % 3}", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn(extra, df["n_chars"]) if extra else df


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
