"""Token counts (2): an exact length histogram whose suffix sums answer every context limit.

Null or empty text: only the end id, length 1. Repeated rows count as often as they stand. An empty
table gives an empty histogram. Only ``text`` is read, so further columns cannot clash.
"""

from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import mapped, stored, table
from .tokens import encoder

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
RUN = 256  # lengths summed by one window; what the runs sum to is one row each


def length_histogram(docs, tokenizer=TOKENIZER, end_id=END_ID):
    """(n_tokens, docs): documents by encoded length, counted in the tasks before the shuffle."""
    def count(batches):
        seen = Counter()
        for (texts,) in batches:
            seen.update(len(x) // 4 for x in encoder(tokenizer, end_id).encode(texts))
        yield list(seen), list(seen.values())

    counted = mapped(docs.select("text"), "n_tokens bigint, docs bigint", count)
    return counted.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram):
    """For each length L that occurs, as a context limit; ``histogram`` is read twice: store it.

    ``docs_longer`` documents exceed it; ``tokens_upto`` are in documents that do not;
    ``truncated_tokens`` remain if every document is cut to L; ``docs_upto`` / ``total_docs`` is the
    share of documents within L, so L is the quantile of that rank.
    """
    run = F.expr(f"n_tokens div {RUN}")
    tokens = F.col("n_tokens") * F.col("docs")
    rows = histogram.withColumn("run", run).withColumn("tokens", tokens)
    # One row per run of lengths: their number is the longest document's length / RUN.
    whole = rows.groupBy("run").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = whole.select(
        "run",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d_before"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t_before"),
        F.sum("d").over(every.orderBy("run")).alias("total_docs"),
        F.sum("t").over(every.orderBy("run")).alias("total_tokens"))
    within = Window.partitionBy("run").orderBy("n_tokens")
    summed = rows.select(
        "*", F.sum("docs").over(within).alias("d"), F.sum("tokens").over(within).alias("t"))
    out = summed.join(whole, "run").select(
        "n_tokens", "docs",
        (F.col("d_before") + F.col("d")).alias("docs_upto"),
        (F.col("t_before") + F.col("t")).alias("tokens_upto"),
        "total_docs", "total_tokens")
    longer = F.col("total_docs") - F.col("docs_upto")
    return out.select(
        "n_tokens", "docs", "docs_upto", longer.alias("docs_longer"), "tokens_upto",
        (F.col("tokens_upto") + F.col("n_tokens") * longer).alias("truncated_tokens"),
        "total_docs", "total_tokens")


def at_limits(sums, limits):
    """(context_limit, docs_longer, truncated_tokens) for any limits, also lengths that don't occur."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit bigint")
    # The caller's list is the small side; each limit takes the longest length within it.
    reach = F.max(F.when(F.col("n_tokens") <= F.col("context_limit"),
                         F.struct("n_tokens", "docs_longer", "tokens_upto"))).alias("r")
    got = sums.join(F.broadcast(asked)).groupBy("context_limit").agg(
        reach, F.max("total_docs").alias("n"))
    longer = F.coalesce("r.docs_longer", "n")
    return got.select(
        "context_limit", longer.alias("docs_longer"),
        (F.coalesce("r.tokens_upto", F.lit(0)) + F.col("context_limit") * longer)
        .alias("truncated_tokens"))


def quantiles(sums, ranks):
    """(rank, n_tokens): the least length that at least that share of documents keeps within."""
    picks = [F.struct(F.lit(float(q)).alias("rank"), F.min(F.when(
        F.col("docs_upto") >= F.ceil(F.lit(float(q)) * F.col("total_docs")), F.col("n_tokens")))
        .alias("n_tokens")) for q in ranks]
    return sums.agg(F.array(*picks).alias("all")).select(F.inline("all"))


def op2_token_counts(spark, sf_dir):
    """Suffix sums over the length histogram of all documents."""
    histogram = length_histogram(table(spark, sf_dir, "documents"))
    return suffix_sums(stored(histogram, "histogram"))
