"""A table of awkward documents, and the same as other tables."""

import random

rnd = random.Random(11)
WORDS = ["the", "Ont", "hésh", "ing,", "and.", "Über", "la", "wór", "x", "THE", "日本", "é"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


PASSAGE = prose(60, 1)
TEXTS = [
    None,
    "",
    " ",
    "one",
    "two words",
    "three words here",
    "  leading and   double  spaces ",
    "tab\tnew\nline\x0b\x0c\r end",
    prose(120, 2),
    prose(120, 2),  # copy
    prose(120, 2) + " more",  # near copy
    prose(30, 3) + " " + PASSAGE + " " + prose(30, 4),
    prose(30, 5) + " " + PASSAGE + " " + prose(30, 6),
    "ab " * 400,  # repeats itself
    "x" * 1500,
    "é" * 300 + "日本" * 100,
    "\x00\x1c\x85\xa0​ <|endoftext|> </s> ▁ 🙂",
    prose(8000, 7),  # long
    "nul",
]


def documents(spark, extra=True):
    rows = [(i * 3, t, "en", f"s{i % 2}", None if i % 5 == 0 else (len(t) if t is not None else 0)) for i, t in enumerate(TEXTS)]
    rows.append((3 * (len(TEXTS) - 1), "nul", "en", "s1", 3))  # a repeated row
    rows.append((None, "without id", "en", "s1", 3))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'a' AS score", "1 AS n", "2 AS id", "3 AS mark", "4 AS cut", "5 AS component_id") if extra else df


def empty(spark):
    return documents(spark).where("1 = 0")
