"""Quality rules (7) with risk-controlled thresholds, in DataFrame operations only.

Four rules reject a document whose measure exceeds a cutoff: symbols per word character, share of
repeated lines, share of words in repeated three-word windows, mean word length. Cutoffs are chosen
per size stratum from fixed grids: a cutoff is certified if, on the labelled documents of good
quality, an exact binomial test shows that the rule falsely rejects at most ``RISK`` / 4 of them; the
tests of all strata, rules and cutoffs together err with probability at most ``ERROR`` (Bonferroni).
The strictest certified cutoff applies; a rule without one rejects nothing in that stratum. So with
probability 1 - ERROR at most ``RISK`` of the good documents of each stratum fall to the rules.

Null or empty text: no words, base failure. Labels of null quality are left out; a document with any
label 1 is good. Repeated rows count as often as they stand. Without labels only the base rules act.
An empty table gives no rows. Only doc_id and text are read.
"""

from pyspark.sql import functions as F

from .common import stored, table

RISK, ERROR = 0.02, 0.05
SPACE = r"[ \x09-\x0D]"
STRATA = (200, 800)  # words from which the next size stratum begins

# Rule: measure and its grid of cutoffs.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)",
                (0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.1, 0.15, 0.2, 0.3, 0.4)),
    "long_words": ("word_chars / greatest(n_words, 1)", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
}


def measures(docs):
    """doc_id and the counts the rules are made of, without a shuffle."""
    text = F.coalesce("text", F.lit(""))
    lettered = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^ \x09-\x0D]"))
    words = F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")
    # Each step names what the next one reads several times, so nothing is computed again.
    step = docs.select(
        "doc_id", words.alias("words"), lettered.alias("lines"),
        (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("bigint").alias("n_symbols"),
        (F.char_length(text) - F.size(F.split(text, SPACE, -1)) + 1).cast("bigint")
        .alias("word_chars"))
    word = lambda i: F.get("words", i)
    windows = F.when(F.size("words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    step = step.select(
        "doc_id", "n_symbols", "word_chars", F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("windows"))
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    step = step.select(*kept, F.when(repeats, F.array_sort(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    twice = F.filter("s", lambda x, j: (x["h"] == F.get("s", j + 1)["h"])
                     | ((j > 0) & (x["h"] == F.get("s", F.greatest(j - 1, F.lit(0)))["h"])))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    # Words that the windows cover, each once.
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"),
                              p.alias("last")),
        lambda a: a["n"])
    return step.select(*kept, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum():
    """0 for the shortest documents and so on."""
    return sum((F.col("n_words") >= n).cast("int") for n in STRATA)


def at_most(k, n, chance):
    """Exact P(Binomial(n, chance) <= k), summed in logarithms; k at most about n * chance."""
    odds = F.log(chance / (1 - chance))
    first = n * F.log(1 - chance)
    return F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(
            F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), F.exp(first).alias("sum")),
        lambda a, j: F.struct(
            (a["term"] + F.log((n - j + 1) / j) + odds).alias("term"),
            (a["sum"] + F.exp(a["term"] + F.log((n - j + 1) / j) + odds)).alias("sum")),
        lambda a: F.least(a["sum"], F.lit(1.0)))


def certified(measured, labels, risk=RISK, error=ERROR):
    """(stratum, rule, cutoff, n, k, p_value) of every cutoff, from the labelled good documents."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1")
    known = measured.where(~base_failed()).join(good.select("doc_id"), "doc_id") \
        .withColumn("stratum", stratum())
    sums = [F.count_if(F.expr(f"{expr} > {cut!r}")).alias(f"{rule}_{i}")
            for rule, (expr, cuts) in RULES.items() for i, cut in enumerate(cuts)]
    # One row per stratum, then one per cutoff.
    sums = known.groupBy("stratum").agg(F.count("*").alias("n"), *sums)
    cells = [F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cutoff"),
                      F.col(f"{rule}_{i}").alias("k"))
             for rule, (_, cuts) in RULES.items() for i, cut in enumerate(cuts)]
    rows = sums.select("stratum", "n", F.inline(F.array(*cells)))
    limit = F.lit(risk / len(RULES))
    return rows.withColumn("p_value", F.when(
        F.col("k") <= F.col("n") * limit, at_most(F.col("k"), F.col("n"), limit))
        .otherwise(1.0))


def cutoffs(measured, labels, risk=RISK, error=ERROR):
    """{(stratum, rule): strictest certified cutoff}."""
    tests = (len(STRATA) + 1) * sum(len(cuts) for _, cuts in RULES.values())
    rows = certified(measured, labels, risk, error).where(F.col("p_value") <= error / tests)
    return {(r.stratum, r.rule): r.cutoff for r in
            rows.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff")).collect()}


def verdicts(measured, chosen):
    """The measures with base_failed and kept."""
    over = F.lit(False)
    for (level, rule), cut in sorted(chosen.items()):
        over = over | ((stratum() == level) & F.expr(f"{RULES[rule][0]} > {cut!r}"))
    return measured.withColumn("base_failed", base_failed()) \
        .withColumn("kept", ~F.col("base_failed") & ~over)


def op7_quality_rules(spark, sf_dir):
    """Counts, base failure and verdict of every document."""
    measured = stored(measures(table(spark, sf_dir, "documents")), "measures")
    return verdicts(measured, cutoffs(measured, table(spark, sf_dir, "labels")))
