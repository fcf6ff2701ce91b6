"""Small tables for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["the", "and", "Reader", "of", "Ähre", "tion,", "words", "a", "in", "plain."]) + str(rng.randrange(40)) for _ in range(n))


def documents(spark, n=40, seed=1, extra=()):
    """Varied texts: prose, junk, copies, near copies, empty, null, one long."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randrange(5, 120))
        kind = i % 8
        if kind == 1 and rows:
            text = rng.choice(rows)[1]
        elif kind == 2 and rows and rows[-2][1]:
            text = rows[-2][1] + " end"
        elif kind == 3:
            text = " ".join(w + "$$$" for w in text.split())
        elif kind == 4:
            text = "\n".join(["same line of words again here"] * 12)
        elif kind == 5:
            text = rng.choice(["", None, "   \n\t ", "one", "日本 ﬁ 😀\u0000x"])
        rows.append((i * 3 % n if kind != 7 else i, text, "en", f"s{i % 3}" if i % 11 else None, 0))
    rows.append((1000, prose(rng, 6000), "en", "s0", 0))
    rows += list(extra)
    return spark.createDataFrame(rows, SCHEMA)


def write_table(spark, tmp_path, name, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
