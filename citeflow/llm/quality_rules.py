"""Operator 9: quality rules with risk-controlled thresholds, DataFrame functions only.

Base measures and base rules are fixed. The method adds one cutoff a rule and stratum (a stratum is a band of text
lengths): reject a document if a measure exceeds its cutoff. Cutoffs are chosen on labelled documents so that false
rejection is limited: a cutoff is admitted only if, were its true false-rejection rate above ``alpha / rules``, as few
rejections among the stratum's good documents as were seen would have a probability of ``delta / tests`` at most (exact
binomial tail; ``tests`` = rules x cutoffs x strata, Bonferroni). Of the admitted cutoffs the one with the fewest false rejections
seen is taken, the lowest among equals; a stratum with too few labelled documents admits none and its rules stay off. So, with probability ``1 - delta``, the rules together reject
at most a share ``alpha`` of the good documents of every stratum.

Scale: measures are computed inside each row (sorted arrays of window hashes), without a shuffle. Labels join on the id;
what is gathered is a histogram with rules x cutoffs x strata rows. The cutoffs are one row a stratum, so broadcasting
them is bounded by construction.

Cases: a null or empty text has no words and fails the base rules; a null id gets its measures, and is never labelled;
repeated rows are measured alike and count once each in the calibration; a document labelled twice has its lowest label;
rows of ``labels`` with nulls are ignored; empty tables give empty results; without labels only the base rules act. Other
columns of ``docs`` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.common import cut_lineage

#: The symbols that n_symbols counts, and the white space between words.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
BREAKS = "[\\x20\\x09-\\x0D]+"
WINDOW = 5

#: rule -> (measure as SQL over the base columns, ascending integer cutoffs). Measures are whole numbers per hundred or thousand.
RULES: dict[str, tuple[str, list[int]]] = {
    "symbols": ("(100 * n_symbols) div greatest(n_words, 1)", [1, 2, 3, 5, 8, 10, 15, 20, 30, 40, 50, 75, 100, 150, 200]),
    "duplicate_lines": ("(100 * n_dup_lines) div greatest(n_lines, 1)", [1, 2, 3, 5, 8, 10, 15, 20, 30, 40, 50, 75]),
    "repeated_words": ("(100 * n_repeat_words) div greatest(n_words, 1)", [0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 18]),
    "word_length": ("(100 * word_chars) div greatest(n_words, 1)", [500, 600, 700, 800, 900, 1000, 1200, 1500, 2000, 3000]),
    "capitals": ("(100 * n_capitals) div greatest(word_chars, 1)", [5, 8, 10, 12, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90]),
}
#: Words at which the next stratum begins.
BANDS = [50, 200, 1000]


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words inside windows that occur at least twice."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def starts(s: Column) -> Column:
        same = lambda x, j: F.get(s, j)["h"] == x["h"]
        kept = F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _bind(_bind(placed, starts), covered)).otherwise(F.lit(0).cast("long"))

    return F.when(n >= WINDOW, _bind(hashes, count)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the base measures of every whole text (long columns)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def of(t: Column) -> Column:
        bare = F.translate(t, SPACE, "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
        words = F.filter(F.split(t, BREAKS), lambda w: w != F.lit(""))
        from_words = _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
        from_lines = _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                                     (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
        chars = _bind(bare, lambda b: F.struct(
            F.length(b).cast("long").alias("word_chars"),
            (F.length(b) - F.length(F.translate(b, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.length(b) - F.length(F.translate(b, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals")))
        return F.struct(from_words.alias("w"), from_lines.alias("l"), chars.alias("c"))

    m = docs.select(F.col(id_col).alias("id"), _bind(text, of).alias("m"))
    return m.select("id", "m.w.n_words", "m.c.word_chars", "m.c.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words",
                    "m.l.n_lines", "m.c.n_capitals")


def with_verdicts(measures: DataFrame) -> DataFrame:
    """Add ``base_failed``, ``stratum`` and one ``r_<rule>`` measure a rule."""
    out = measures.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    out = out.withColumn("stratum", sum((F.col("n_words") >= b).cast("int") for b in BANDS))
    return out.withColumns({f"r_{name}": F.expr(sql) for name, (sql, _) in RULES.items()})


def choose_cutoffs(good: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Rows of ``with_verdicts`` of documents labelled good -> one row: rule, stratum and the lowest
    cutoff that is admitted (the bound covers all cutoffs, so the allowed share may be spent)."""
    tests = sum(len(c) for _, c in RULES.values()) * (len(BANDS) + 1)
    rate, limit = alpha / len(RULES), delta / tests
    bins = [F.struct(F.lit(name).alias("rule"), F.array(*[F.lit(c).cast("long") for c in cuts]).alias("cuts"),
                     sum((F.col(f"r_{name}") > c).cast("int") for c in cuts).alias("bin")) for name, (_, cuts) in RULES.items()]
    counted = (good.select("stratum", F.explode(F.array(*bins)).alias("b")).groupBy("stratum", "b.rule", "b.cuts", "b.bin")
               .agg(F.count("*").alias("n")))
    per = counted.groupBy("stratum", "rule", "cuts").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bin", "n")).alias("bins"))
    above = lambda i: F.aggregate(F.filter(F.col("bins"), lambda b: b["bin"] > i), F.lit(0).cast("long"), lambda a, b: a + b["n"])
    each = per.select("stratum", "rule", "n", F.posexplode("cuts").alias("g", "cutoff"), "bins")
    each = each.withColumn("k", above(F.col("g"))).drop("bins")
    odds = rate / (1 - rate)
    step = lambda a, i: F.struct(  # noqa: E731  the next term of the binomial sum, in logarithms
        (a["term"] + F.log((F.col("n") - i) / (i + 1) * F.lit(odds))).alias("term"), (a["total"] + F.exp(a["term"])).alias("total"))
    begin = F.struct((F.col("n") * F.log(F.lit(1 - rate))).alias("term"), F.lit(0.0).alias("total"))
    tail = F.when(F.col("k") < F.col("n"), F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("k")), begin, step)["total"]).otherwise(F.lit(1.0))
    return each.where(tail <= limit).groupBy("rule", "stratum").agg(F.min("cutoff").alias("cutoff"))


def apply_cutoffs(judged: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add ``kept``: the base rules pass and no admitted cutoff of the document's stratum is exceeded."""
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in RULES])
    out = judged.join(F.broadcast(wide), "stratum", "left")  # one row a stratum
    exceeded = F.lit(False)
    for r in RULES:
        exceeded = exceeded | F.coalesce(F.col(f"r_{r}") > F.col(f"c_{r}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~exceeded)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.05,
          delta: float = 0.05) -> DataFrame:
    """One row a row of ``docs``: the id, the measures, base_failed and kept. ``labels``: the id and quality 0/1."""
    judged = cut_lineage(with_verdicts(measure(docs, id_col, text_col)), "measures")
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("id")
    cutoffs = choose_cutoffs(judged.join(good, "id", "left_semi"), alpha, delta)
    return apply_cutoffs(judged, cutoffs).withColumnRenamed("id", id_col)


def oracle_sql(alpha: float = 0.05, delta: float = 0.05) -> str:
    """The same result in DuckDB SQL over ``documents`` and ``labels``."""
    tests = sum(len(c) for _, c in RULES.values()) * (len(BANDS) + 1)
    rate, limit = alpha / len(RULES), delta / tests
    measures = ", ".join(f"{sql.replace(' div ', ' // ')} AS r_{name}" for name, (sql, _) in RULES.items())
    stratum = " + ".join(f"(n_words >= {b})::INT" for b in BANDS)
    grid = " UNION ALL ".join(f"SELECT stratum, '{name}' AS rule, r_{name} AS v, unnest({cuts}) AS cutoff FROM good" for name, (_, cuts) in RULES.items())
    fails = " OR ".join(f"coalesce(r_{r} > (SELECT cutoff FROM chosen c WHERE c.rule = '{r}' AND c.stratum = judged.stratum), false)" for r in RULES)
    space, word = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT row, regexp_extract_all(t, '{word}+') AS w FROM texts),
windows AS (SELECT row, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
  FROM (SELECT row, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW})),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, s) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT row, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM
  (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM twice) GROUP BY row),
lines AS (SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM texts),
base AS (SELECT t.row, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
  (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM texts t JOIN words USING (row) JOIN lines USING (row) LEFT JOIN repeated r USING (row)),
judged AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, {stratum} AS stratum, {measures} FROM base),
good AS (SELECT * FROM judged WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
counted AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS k FROM ({grid}) GROUP BY ALL),
tails AS (SELECT stratum, rule, cutoff, k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate}))) AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM counted WHERE k < n) GROUP BY ALL),
chosen AS (SELECT rule, stratum, min(cutoff) AS cutoff FROM tails WHERE p <= {limit} GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({fails}) AS kept
FROM judged"""
