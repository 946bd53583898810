"""Conversation prefix trie (12): composable fingerprints of rebuilt conversations.

A conversation c is rebuilt from the first h(c) turns of its base conversation and its own turns
after its first h(c). No rebuilt text is made: a turn stands for its reference, a SHA-256 digest
stored once with the turn, and the fingerprint of a sequence is an element of a monoid, (length,
sum of x_i * B**i), with product (l, p)(m, q) = (l + m, p + B**l * q), modulo three primes. The
prefix sums of every original conversation then give those of every rebuilt one: those of the base's
head, and the head's times what the conversation's own sums grow by after its head, shifted by the
power that the lengths of the two heads differ by.

Prefixes with one depth and fingerprint are one node of the trie. Equality is verified: all members
of a node must have one reference at that depth and one parent node, so, by induction, they have
the same references all the way; if not, everything is counted again with other multipliers.

Subtree sums need no walk over the levels. The least member of a node is also the least member of
each node of the subtree that it belongs to, so the nodes that conversation c stands for are those
from some depth D(c) down. A sum over the nodes of a subtree is then a sum over its members of what
each stands for, and words below a depth are differences of prefix sums.

Rows are numbered and summed by ranges (``ordered.running``), so one conversation may hold most
turns; nodes are counted in the tasks before they are shuffled, so most conversations may share a
node. The hash over the ids that end at a node is a single sequence by definition: ranges make it
one piece of text each, and one task reads a node's pieces one after another.

Null roles and texts are empty. Turns of one number (null first) go by their reference; repeated
rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. An
empty table gives no rows. Only the four columns of conversations are read.
"""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from .common import mapped, ready, stored, table
from .ordered import running

EVERY, HEADS = 20, 4  # c's base is c - c % EVERY; its head has crc32(c) % HEADS turns
PRIMES = (2**31 - 1, 2**31 - 19, 2**31 - 61)
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", *[f"q{k}" for k in range(len(PRIMES))]]
ABOVE = [f"p{k}" for k in range(len(PRIMES))]
REFERENCE = [f"r{k}" for k in range(4)]  # 240 bits of the digest
MOST_TRIES = 8


def _multipliers(attempt):
    return [int(b) for b in np.random.default_rng(attempt).integers(2**20, 2**31 - 64, len(PRIMES))]


def turns(conversations):
    """conv_id, turn, reference of the stored turn (r0 to r3), words of its text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    return rows.select("conv_id", "turn", "words", *[
        F.expr(f"cast(conv(substr(digest, {15 * k + 1}, 15), 16, 10) as bigint)").alias(r)
        for k, r in enumerate(REFERENCE)])


def _with_terms(placed, multipliers):
    """``placed`` with the terms x * B**pos of each prime."""
    @F.pandas_udf("bigint")
    def power(pos, base, prime):
        exponent, b, m = (s.to_numpy().astype(np.uint64) for s in (pos, base, prime))
        out = np.ones_like(b)
        while exponent.any():
            out = np.where(exponent & np.uint64(1), out * b % m, out)
            b = b * b % m
            exponent = exponent >> np.uint64(1)
        import pandas as pd

        return pd.Series(out.astype(np.int64))

    return placed.withColumns({
        f"t{k}": (F.col(f"r{k}") % m) * power("pos", F.lit(b), F.lit(m)) % m
        for k, (b, m) in enumerate(zip(multipliers, PRIMES))})


def rebuilt(conversations, multipliers):
    """A row per rebuilt conversation and depth: conv_id, KEY, the parent's ABOVE (null at the root),
    REFERENCE and words of the last turn, ``tail`` (words from that turn to the end), ``ends``."""
    ready(conversations.sparkSession)
    primes = range(len(PRIMES))
    placed = running(stored(turns(conversations), "turns"), ["conv_id"], ["turn", *REFERENCE],
                     ["words"], "turns-ranged").select(
        "conv_id", F.col("pos").alias("at"), "pos", "n", "words", *REFERENCE, "words_before",
        "words_all")
    terms = [f"t{k}" for k in primes]
    summed = running(_with_terms(placed, multipliers).drop("pos", "n"), ["conv_id"], ["at"], terms,
                     "terms-ranged")
    own = stored(summed.select(
        "conv_id", "pos", "n", "words", *REFERENCE, "words_before", "words_all", *[
            (F.col(f"t{k}_before") % m).alias(f"before{k}") for k, m in enumerate(PRIMES)], *[
            ((F.col(f"t{k}_before") + F.col(f"t{k}")) % m).alias(f"after{k}")
            for k, m in enumerate(PRIMES)]), "own")

    turn = F.struct("pos", "words", *REFERENCE, "words_before",
                    *[f"{side}{k}" for side in ("before", "after") for k in primes])
    convs = own.groupBy("conv_id").agg(
        F.first("n").alias("n"), F.first("words_all").alias("words_all"),
        F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS - 1, turn))).alias("first"))
    heads = convs.where(f"conv_id % {EVERY} = 0").select(
        F.col("conv_id").alias("base"), F.col("first").alias("base_first"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = convs.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % EVERY, "h": h.cast("int")}).join(
        heads, "base", "left")
    convs = convs.withColumn("head", F.expr("coalesce(slice(base_first, 1, h), array())")) \
        .withColumns({"in_head": F.size("head"), "own_head": F.least("h", "n").cast("int")})

    def at_end(of, size, field):
        return F.when(F.col(size) > 0, F.get(of, F.col(size) - 1)[field]).otherwise(0)

    def through(of, size):
        last = F.get(of, F.col(size) - 1)
        return F.when(F.col(size) > 0, last["words_before"] + last["words"]).otherwise(0)

    # The head's product is known, and what the own sums grow by is shifted by the heads' lengths.
    shifts = [F.get(F.array(*[F.lit(pow(b, -s, m)) for s in range(HEADS)]),
                    F.col("h") - F.col("in_head"))
              for b, m in zip(multipliers, PRIMES)]
    convs = stored(convs.select(
        "conv_id", "h", "in_head", "head", "n",
        through("head", "in_head").alias("head_words"),
        through("first", "own_head").alias("own_words"), "words_all",
        *[at_end("head", "in_head", f"after{k}").alias(f"head{k}") for k in primes],
        *[at_end("first", "own_head", f"after{k}").alias(f"own{k}") for k in primes],
        *[s.alias(f"shift{k}") for k, s in enumerate(shifts)]).withColumns({
            "words_in_all": F.expr("head_words + words_all - own_words"),
            "length": F.expr("in_head + greatest(n - h, 0)")}), "heads")

    none = F.lit(None).cast("bigint")
    root = convs.select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"),
        *[F.lit(0).cast("bigint").alias(f"q{k}") for k in primes], *[none.alias(p) for p in ABOVE],
        *[none.alias(r) for r in REFERENCE], F.lit(0).cast("bigint").alias("words"),
        F.col("words_in_all").alias("tail"), (F.col("length") == 0).alias("ends"))
    head = convs.select("*", F.explode("head").alias("t")).select(
        "conv_id", (F.col("t.pos") + 1).alias("depth"),
        *[F.col(f"t.after{k}").alias(f"q{k}") for k in primes],
        *[F.col(f"t.before{k}").alias(f"p{k}") for k in primes],
        *[f"t.{r}" for r in REFERENCE], "t.words",
        (F.col("words_in_all") - F.col("t.words_before")).alias("tail"),
        (F.col("t.pos") + 1 == F.col("length")).alias("ends"))

    def composed(side, k, m):
        grown = F.pmod(F.col(f"{side}{k}") - F.col(f"own{k}"), F.lit(m))
        return (F.col(f"head{k}") + grown * F.col(f"shift{k}") % m) % m

    rest = own.drop("n", "words_all").join(convs, "conv_id").where("pos >= h").withColumn(
        "depth", F.expr("in_head + pos - h + 1")).select(
        "conv_id", "depth", *[composed("after", k, m).alias(f"q{k}") for k, m in enumerate(PRIMES)],
        *[composed("before", k, m).alias(f"p{k}") for k, m in enumerate(PRIMES)], *REFERENCE,
        "words", F.expr("words_in_all - head_words - words_before + own_words").alias("tail"),
        (F.col("depth") == F.col("length")).alias("ends"))
    return stored(root.unionByName(head).unionByName(rest), "prefixes")


def _nodes(rows):
    """Nodes of the trie, and how many of them hold unequal prefixes."""
    held = [*ABOVE, *REFERENCE]
    nodes = stored(rows.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.max("words").alias("words"), F.min_by("tail", "conv_id").alias("tail"),
        *[F.min(c).alias(c) for c in held], *[F.max(c).alias(f"most_{c}") for c in held]), "nodes")
    unequal = " or ".join(f"{c} != most_{c}" for c in held)
    return nodes.select(*KEY, *ABOVE, "n_convs", "conv_id", "words", "tail"), \
        nodes.where(unequal).count()


def _end_hashes(rows):
    """KEY and the hash of the ids that end there."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.where("ends").select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id") \
        .withColumn("part", F.spark_partition_id()).groupBy(*KEY, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")),
                                 lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        key, state = None, None
        for *keys, _, ids in batches:
            done = []
            for *own, text in zip(*keys, ids):
                if own == key:
                    state.update(b"," + text.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(text.encode())
            if done:
                yield [list(c) for c in zip(*done)]
        if key is not None:
            yield [[k] for k in (*key, state.hexdigest())]

    ordered = pieces.repartition(n, *KEY).sortWithinPartitions(*KEY, "part")
    return mapped(ordered, ", ".join(f"{k} bigint" for k in KEY) + ", ends_sha256 string", run)


def trie(conversations):
    """A row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    for attempt in range(MOST_TRIES):
        rows = rebuilt(conversations, _multipliers(attempt))
        nodes, unequal = _nodes(rows)
        if not unequal:
            break
    else:
        raise RuntimeError("unequal prefixes share a fingerprint under every multiplier")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[
        F.col(p).alias(q) for p, q in zip(ABOVE, KEY[1:])]).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, KEY, "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "trie")
    # What a conversation stands for: nodes from depth ``first``, ``stands`` words, an end or not.
    least = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("first"), F.min_by("tail", "depth").alias("stands"),
        F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    mine = F.expr("case when first is null then 0 when depth > first then tail else stands end")
    sums = rows.select("conv_id", *KEY, "tail").join(least, "conv_id", "left").groupBy(*KEY).agg(
        F.sum(F.col("tail") - mine).alias("saved_tokens"),
        F.sum(F.coalesce("leaf", F.lit(0).cast("bigint"))).alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[
        F.col(q).alias(p) for p, q in zip(ABOVE, KEY[1:])],
        F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums, KEY).join(_end_hashes(rows), KEY, "left") \
        .join(parents, ["depth", *ABOVE], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_conversation_trie(spark, sf_dir):
    """The prefix trie of all rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations"))
