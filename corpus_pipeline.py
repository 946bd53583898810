"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Every stage works on all that the one before kept and returns the columns of documents; the last
returns the packed pieces. Null and empty texts go with the first stage (no letter); repeated rows
meet in the dedup; an empty table passes every stage. Extra columns pass through, whatever their
names.

No stage can be put as SQL (models and tokenizers), so ``ORACLE_SQL`` is None. The tests hold the
dedup against brute-force Jaccard similarity; of the chain of stages they check columns and that
row counts fall.
"""

from pyspark.sql import functions as F

from tremorlake.llm import language, mixing, packing, simhash, toxicity
from tremorlake.llm.common import ready, stored, table

# Words that a worker's encoder knows: the executor still holds the memory of the stages before.
KNOWN_WORDS = 200_000
# What the mix is to hold of well written and of poor documents: shares of the tokens.
MIX = (("good", "quality = 1", 0.88), ("low_quality", "quality = 0", 0.12))


def language_id(spark, docs, sf_dir):
    """Documents whose language is known; models learned from the documents themselves."""
    ready(spark)
    found, (*_, rejected) = language.identify(docs)
    return found.where(~F.col(rejected)).select(*docs.columns)


def toxic(spark, docs, sf_dir):
    """Documents that the chain does not reject as toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found, names = toxicity.judged(docs, model)
    return found.where(~F.col(names[-1])).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class: five-word shingles, similarity 0.8 or more."""
    ready(spark)
    return simhash.one_of_each(docs)


def mix(spark, docs, sf_dir):
    """Documents as often as the fitted rates say."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), MIX)


def pack(spark, docs, sf_dir):
    """Pieces of all documents and their places in sequences."""
    ready(spark)
    return packing.pack(docs, cached=KNOWN_WORDS)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("simhash_dedup", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
