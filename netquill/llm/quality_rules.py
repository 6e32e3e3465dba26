"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

The rules tighten together: at step i of one fixed sequence a text is rejected if any of its
measures is above that rule's cutoff i, so each step rejects what the one before it does and
more. Cutoffs are not set by hand: for each stratum (language) the texts labelled good are a
holdout, and a step is certified only if an exact binomial test shows that it rejects at most
RISK of the good texts of that stratum. The p-value is P(Binomial(n, risk) <= rejected good
texts). Steps are tested from the most lenient on, stopping at the first that fails, which
needs no correction inside a stratum. Across strata Holm's procedure corrects: a stratum whose
whole sequence passes at its level hands that level on, and the others share CONFIDENCE
alike (closed testing by the first true step of each stratum). So with probability 1 -
CONFIDENCE no stratum loses more than RISK of its good texts. Of the certified steps the one
that rejects the most bad texts, less the share of good ones, is used, the most lenient of
equals; a stratum where no step gains, or with too few labels (22 good ones are the least that
certify anything, in a single stratum), rejects nothing beyond the base rules.

All labelled rows count, at any size; what is gathered is one row for each stratum and
step, which one task looks through: strata are to be few, as languages are. Measures are computed within each row (no shuffle of words), and written once.

Edge cases: a null text has no words and so fails the base rules, like an empty one; a null
language is a stratum of its own; repeated rows each get the same verdict; with no labels, or
an empty table of them, only the base rules reject; a text of one very long line or word is
measured whole; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import col, staged

#: The most that a stratum may lose of its good texts, and the probability that one loses more.
RISK, CONFIDENCE = 0.1, 0.05
MIN_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
#: Rule: (measure as an SQL expression, its cutoff at each step, from lenient to strict).
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [4.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.36, 0.33, 0.3]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.13, 0.12, 0.11, 0.1]),
    "long_words": ("word_chars / greatest(n_words, 1)", [24.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.5, 11.0, 10.5, 10.0]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2]),
}
STEPS = range(len(RULES["symbols"][1]))
#: The first step that rejects a text, as SQL for Spark and DuckDB alike; null if none does.
FIRST_STEP = "CASE " + " ".join(f"WHEN {' OR '.join(f'{m} > {cuts[i]}D' for m, cuts in RULES.values())} THEN {i}" for i in STEPS) + " END"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where body's lambdas use it again and again."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more."""

    def marked(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(order, lambda s: F.array_sort(F.filter(F.transform(s, lambda x, j: F.when(same(s, x, j - 1) | same(s, x, j + 1), x["i"])), lambda i: i.isNotNull())))

    def same(s: Column, x: Column, j: Column) -> Column:
        return F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(starts, first, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    none = F.lit(0).cast("bigint")
    return F.when(F.size(words) < WINDOW, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(marked(h)))))


def measures(text: Column) -> Column:
    """A struct of the counts that the rules use."""
    long = lambda c, name: c.cast("bigint").alias(name)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(long(F.size(w), "n_words"), long(F.char_length(F.array_join(w, "")), "word_chars"), repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), long(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), "n_symbols"), long(F.regexp_count(text, F.lit("[A-Z]")), "n_capitals"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, stratum, the counts and base_failed."""
    rows = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.concat(F.lit("+"), col(stratum_col).cast("string")), F.lit("-")).alias("stratum"), measures(F.coalesce(col(text_col).cast("string"), F.lit(""))).alias("m"))
    rows = rows.select("doc_id", "stratum", "m.w.*", "m.l.*", "m.n_symbols", "m.n_capitals")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series at n + 11 (error below 1e-12) and ten logarithms down."""
    z = n + 11.0
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    for j in range(1, 11):
        series = series - F.log(n + float(j))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed down from k until further terms no longer count; 1 for k over n p."""
    k, n = k.cast("double"), n.cast("double")
    log_top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.floor(20 * F.sqrt(n * p) + 50)).cast("bigint")  # over 20 standard deviations
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        i = k - j + 1
        term = a["term"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    tail = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(terms, F.lit(1))), begin, step, lambda a: a["sum"])).otherwise(F.lit(1.0))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(log_top) * tail)


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE, label_col: str = "quality") -> DataFrame:
    """(stratum, cut_step) for each stratum where a certified step gains."""
    marks = labels.select(col("doc_id").cast("bigint").alias("doc_id"), col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    held = rows.where(~F.col("base_failed")).join(marks, "doc_id").select("stratum", "label", F.expr(FIRST_STEP).alias("first"))
    within = lambda v, i: F.count(F.when((F.col("label") == v) & (F.col("first") <= i), 1))
    counts = [F.count(F.when(F.col("label") == v, 1)).alias(name) for v, name in ((1, "good"), (0, "bad"))]
    table = held.groupBy("stratum").agg(*counts, *[within(v, i).alias(f"step_{i}_{v}") for i in STEPS for v in (1, 0)]).where("good > 0")
    p_of = lambda i: binomial_tail(F.col(f"step_{i}_1"), F.col("good"), risk)
    # One row a stratum from here. Losses grow by step, so the last step has a sequence's greatest p-value.
    every, by_p = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("p_last", "stratum")
    table = table.withColumn("p_last", p_of(STEPS[-1]))
    table = table.withColumn("open", F.count("*").over(every) - F.row_number().over(by_p) + 1)
    table = table.withColumn("whole", F.min((F.col("p_last") <= F.lit(confidence) / F.col("open")).cast("int")).over(by_p.rowsBetween(Window.unboundedPreceding, 0)))
    table = table.withColumn("level", F.when(F.col("whole") == 1, F.lit(1.0)).otherwise(F.lit(confidence) / F.sum(1 - F.col("whole")).over(every)))
    cells = [F.struct(F.lit(i).alias("step"), p_of(i).alias("p"), F.col(f"step_{i}_1").alias("lost"), F.col(f"step_{i}_0").alias("caught")) for i in STEPS]
    flat = table.select("stratum", "good", "bad", "level", F.explode(F.array(*cells)).alias("c")).select("stratum", "good", "bad", "level", "c.*")
    # p-values grow by step, so all steps up to the first failure are those that pass.
    gain = F.col("caught") / F.greatest(F.col("bad"), F.lit(1)) - F.col("lost") / F.col("good")
    return flat.where("p <= level").withColumn("gain", gain).where("gain > 0").groupBy("stratum").agg(F.min_by("step", F.struct(-F.col("gain"), F.col("step"))).alias("cut_step"))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the step that rejects and the stratum's own, for each row of docs."""
    rows = staged(measured(docs, id_col, text_col, stratum_col), "measures")
    first = F.expr(FIRST_STEP)
    return rows.join(cutoffs(rows, labels, risk, confidence), "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(first <= F.col("cut_step"), F.lit(False))).alias("kept"), "n_lines", "n_capitals", first.alias("first_step"), "cut_step"
    )


def rules_sql() -> str:
    """The same for DuckDB, over views documents and labels."""
    first = FIRST_STEP.replace("D ", "::DOUBLE ")
    counts = ", ".join(f"count(*) FILTER (label = {v} AND first_step <= {i}) AS step_{i}_{v}" for i in STEPS for v in (1, 0))
    cells = " UNION ALL ".join(f"SELECT stratum, good, bad, {i} AS step, step_{i}_1 AS lost, step_{i}_0 AS caught FROM counts WHERE good > 0" for i in STEPS)
    return rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce('+' || lang, '-') AS stratum, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT rid, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM words WHERE len(w) >= {WINDOW}),
keyed AS (SELECT rid, i, w[i:i + {WINDOW - 1}] AS k FROM windows),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM keyed) WHERE n > 1),
gaps AS (SELECT rid, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - {WINDOW})) AS g FROM twice),
repeats AS (SELECT rid, sum(g)::BIGINT AS n_repeat_words FROM gaps GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
measures AS (
    SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM docs JOIN words USING (rid) JOIN lines USING (rid) LEFT JOIN repeats USING (rid)),
rows AS (
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed, ({first})::INTEGER AS first_step
    FROM measures),
marks AS (SELECT doc_id, min(quality) AS label FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
counts AS (
    SELECT stratum, count(*) FILTER (label = 1) AS good, count(*) FILTER (label = 0) AS bad, {counts}
    FROM rows JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY stratum),
cells AS ({cells}),
tested AS (
    SELECT *, CASE WHEN lost > good * {RISK!r} THEN 1.0 ELSE list_sum(list_transform(range(0, lost + 1),
        lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({RISK!r}) + (good - i) * ln({1 - RISK!r})))) END AS p
    FROM cells),
opened AS (SELECT stratum, p, count(*) OVER () - row_number() OVER (ORDER BY p, stratum) + 1 AS open FROM tested WHERE step = {STEPS[-1]}),
holm AS (SELECT stratum, min(CASE WHEN p <= {CONFIDENCE!r} / open THEN 1 ELSE 0 END) OVER (ORDER BY p, stratum ROWS UNBOUNDED PRECEDING) AS whole FROM opened),
levels AS (SELECT stratum, CASE WHEN whole = 1 THEN 1.0 ELSE {CONFIDENCE!r} / sum(1 - whole) OVER () END AS level FROM holm),
certified AS (SELECT stratum, step, caught / greatest(bad, 1) - lost / good AS gain FROM tested JOIN levels USING (stratum) WHERE p <= level),
cuts AS (SELECT stratum, arg_max(step, (gain, -step))::INTEGER AS cut_step FROM certified WHERE gain > 0 GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(first_step <= cut_step, false) AS kept, n_lines, n_capitals, first_step, cut_step
FROM rows LEFT JOIN cuts USING (stratum)
"""
