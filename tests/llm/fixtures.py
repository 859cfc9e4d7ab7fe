"""Small tables with what goes wrong: nulls, empty and blank texts, repeats, ties, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators use for results or inside
    + [T.StructField(c, T.StringType()) for c in ("th", "kid", "spans", "rank", "once", "n", "kept", "bucket", "tos")]
)


def words(rng: random.Random, n: int, vocab: int = 400) -> list[str]:
    return ["".join(rng.choice("abcdeé") for _ in range(2 + rng.randrange(6))) + str(rng.randrange(vocab) % 7) for _ in range(n)]


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [None, "", " \n\t ", "one", "one two three", "One Two\tTHREE", "a b c d", "ß İ Σας Ünï <|endoftext|> naïve", "\U0001f600 emoji nbsp ▁mark  two  spaces ", "x" * 700, "x" * 700]
    common = " ".join(words(rng, 90))
    for _ in range(n):
        w = words(rng, rng.choice([4, 5, 6, 12, 30, 80, 300]))
        base = " ".join(w)
        out.append(base)
        kind = rng.randrange(6)
        if kind == 0:
            out.append(base)
        elif kind == 1:
            for _ in range(1 + len(w) // 60):
                w[rng.randrange(len(w))] = "edited" + str(rng.randrange(99))
            out.append(" ".join(w))
        elif kind == 2:
            out.append(base + "\n" + common)
        elif kind == 3:
            out.append(base + "\n" + base)
        elif kind == 4:
            out.append(" ".join(w[: len(w) * 5 // 6]))
    out.append(" ".join(words(rng, 6000)))
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    if len(data) > 20:
        data += [data[12], data[12], (13, "another text of the same id", "en", "s1", 27), (None, "no id but a text of its own here", "de", None, 32), (None, None, None, None, None)]
    return spark.createDataFrame([(*d, *["clash"] * 9) for d in data], SCHEMA)
