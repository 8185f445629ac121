"""Small tables with the awkward cases: nulls, blanks, long texts, repeated rows, extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, id long, ids string, fp long, h string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "o", "ré", "st", "ion", "ß", "el"]) for _ in range(r.randint(1, 4)))
                    + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(words))


def rows():
    texts = [None, "", " ", "\n\n", "word", "Hello  world \n x", "a" * 3000, "中文 ΑΣ İx \U0001f600 don't <|endoftext|>", prose(1, 40),
             prose(1, 40), prose(2, 300), prose(3, 4000), "x y z " * 500, prose(4, 12) + " \n \n " + prose(5, 9)]
    out = [(i, t, "en", 7, "x", 1, None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[8], (None, prose(6, 30), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return table(spark, [])
