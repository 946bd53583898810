"""Documents with every awkward case, and extra columns whose names the operators use inside."""

from pyspark.sql import functions as F

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{k % 977}" for k in range(20_000))
CASES = [
    (0, None, "en", None, None),
    (1, "", "en", "s", 0),
    (2, " \n\t \r\n", None, "s", 6),
    (3, LONG, "en", "s", len(LONG)),
    (4, "the same text stands here twice and is a copy of itself", "en", "s", 1),
    (4, "the same text stands here twice and is a copy of itself", "en", "s", 1),
    (None, "a document without an id", "en", None, 1),
    (None, None, None, None, None),
    (7, "!!! 123 ### $$$", "en", "s", 1),
    (8, "日本語 の 文章 です ǅ ß İ", None, "s", 1),
    (9, "don't <|endoftext|>  stop here\x1cnow\n\nit's a 'quote' ", "en", "s", 1),
    (9, "another text under one id", "de", "s", 1),
    (-5, "x", "fr", "s", 1),
    (2**62, "one\nline\none\nline\none\nline", "en", "s", 1),
]
CLASHES = ("row", "part", "score", "rejected", "fp", "node", "class", "rate", "copies", "shard",
           "slot", "key", "lang_pred", "p_toxic", "fold", "length", "piece", "lettered")


def cases(spark):
    docs = spark.createDataFrame(CASES, FIELDS)
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def empty(spark):
    return cases(spark).limit(0)


def frame(spark, texts, lang="en"):
    return spark.createDataFrame(
        [(k, t, lang, "s", len(t or "")) for k, t in enumerate(texts)], FIELDS)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def given(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
