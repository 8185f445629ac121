import public_tokenizers as P
from tokenizers import Tokenizer

import helpers
from citeflow.llm import token_counts
from test_tokens import noise

PATH = P.path("byte_bpe_50k.json")


def slow(text, begins):
    """By the library's own character offsets."""
    tok = Tokenizer.from_file(PATH)
    out = [0] * len(begins)
    for a, b in tok.encode(text, add_special_tokens=False).offsets:
        at = next((i for i in range(a, b) if text[i] not in " \t\n\x0b\x0c\r"), a)
        out[max(i for i, x in enumerate(begins) if x <= at)] += 1
    return out


def test_lines_equal_library_offsets(spark):
    texts = [x[1] for x in helpers.rows()] + noise(150, 4)
    docs = [(i, t, *[None] * 6) for i, t in enumerate(texts)]
    got = {}
    for r in sorted(token_counts.count_tokens(helpers.table(spark, docs), PATH, P.PATTERN).collect(), key=lambda r: (r.doc_id, r.section)):
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    for i, t in enumerate(texts):
        t = t or ""
        begins = [0] + [k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t)]
        assert got[i] == list(zip(begins, slow(t, begins)))


def test_given_sections_and_awkward_rows(spark):
    df = spark.createDataFrame([(1, "title word\nbody", [6, 11]), (2, None, [0]), (None, "é x", None)], "doc_id long, text string, at array<long>")
    got = sorted(map(tuple, token_counts.count_tokens(df, PATH, P.PATTERN, begins_col="at").collect()), key=str)
    assert [x[1:4] for x in got if x[0] == 1] == [(-1, 0, 6), (0, 6, 11), (1, 11, 15)]
    assert sum(x[4] for x in got if x[0] == 1) == len(Tokenizer.from_file(PATH).encode("title word\nbody").ids)
    assert [x for x in got if x[0] == 2] == [(2, 0, 0, 0, 0, 0)] and len(got) == 5
    assert token_counts.count_tokens(helpers.empty(spark), PATH, P.PATTERN).count() == 0
