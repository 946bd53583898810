"""Merkle manifest of a dataset (13): lag and lead windows, level by level.

Every document is a leaf. The leaves of a source ascend by doc_id and every ``FAN`` consecutive
nodes become their parent, up to the source's subroot; the subroots, ordered by source, likewise
give the root. A block of FAN**LEVELS consecutive nodes is one window: at level j a node stands on
the row of its first leaf, its siblings are lags and leads of fixed offsets k * FAN**j, masked by
its slot and by the length of its run, and the row of a first child hashes the parent. Blocks of a
source lie in different tasks, whatever share of the rows it has. The first rows of the blocks are
the nodes of the next round, so each round has FAN**LEVELS times fewer rows.

Back down, a block adds the siblings above it to the path of its rows: a proof. ``proofs`` folds a
(possibly changed) leaf along its own path.

Null fields are ``-``. Null doc_ids come first in their source, null sources before all others;
rows of one doc_id go by leaf hash, equal rows by input order (their hashes are the same). A null
doc_id is never tampered with. Empty and very long texts are hashed like any other. An empty table
gives no rows. Only the five columns of documents are read.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import stored, table
from .ordered import running

FAN_BITS, LEVELS = 4, 3
FAN, BLOCK_BITS = 1 << FAN_BITS, FAN_BITS * LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed order of a leaf
TAMPERED = 5  # doc_ids whose CRC-32 this divides
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value):
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(text="text"):
    """Hash of a document; ``text`` may be another column than its own."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in FIELDS[:-1]], _field(F.col(text))), 256)


def leaves(docs):
    """doc_id, source_key (orders as source, null first), leaf, and ``bent``, the leaf after
    tampering."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(*FIELDS).withColumn(
        "bent_text", F.when(changed, F.translate("text", UPPER, LOWER))).select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"),
        leaf_hash().alias("leaf"),
        F.when(changed, leaf_hash("bent_text")).otherwise(leaf_hash()).alias("bent"))


def _nodes_at(level):
    """Nodes of the row's group at a level of the block."""
    return F.expr(f"shiftright(n + {(1 << FAN_BITS * level) - 1}, {FAN_BITS * level})")


def _slot(level):
    return F.expr(f"shiftright(pos, {FAN_BITS * level}) & {FAN - 1}")


def _climbed(nodes):
    """``nodes`` (key, pos, n, h0 and others) with, for each level, ``sibs`` (hashes of the others
    of the run, on first rows, null where nothing is hashed) and the parents ``h1`` to h3."""
    block = Window.partitionBy("key", "block").orderBy("run2", "run1", "pos")
    rows = nodes.withColumns({
        "block": F.shiftright("pos", BLOCK_BITS), "run2": F.shiftright("pos", 2 * FAN_BITS),
        "run1": F.shiftright("pos", FAN_BITS)})
    for level in range(LEVELS):
        step = 1 << FAN_BITS * level
        index, slot, count = F.shiftright("pos", FAN_BITS * level), _slot(level), _nodes_at(level)
        length = F.least(F.lit(FAN), count - (index - slot))
        own = F.col(f"h{level}")
        before = [F.when(slot >= k, F.lag(own, k * step).over(block)) for k in range(FAN - 1, 0, -1)]
        after = [F.when(slot + k < length, F.lead(own, k * step).over(block))
                 for k in range(1, FAN)]
        is_node, is_first = (F.expr(f"pos % {s} = 0") for s in (step, step * FAN))
        rows = rows.withColumns({
            f"sibs{level}": F.when(is_node & (count > 1), F.concat_ws("", *before, *after)),
            f"h{level + 1}": F.when(is_first, F.when(
                count > 1, F.sha2(F.concat_ws("", own, *after), 256)).otherwise(own))})
    return rows


def _rounds(nodes):
    """Node tables from ``nodes`` up to the one with a single node a key."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(stored(_climbed(out[-1]).where(f"pos % {1 << BLOCK_BITS} = 0").select(
            "key", F.shiftright("pos", BLOCK_BITS).alias("pos"), _nodes_at(LEVELS).alias("n"),
            F.col(f"h{LEVELS}").alias("h0")), "nodes"))
    return out


def _descended(rounds, above):
    """The rows of the lowest round with ``path``, their siblings up to the root: an array of (slot,
    sibs). ``above``: key, path of the single node of that key, and columns that go down with it."""
    rows, above = rounds[-1], above.withColumn("pos", F.lit(0).cast("bigint"))
    for k, nodes in enumerate(reversed(rounds)):
        if not k:
            rows = nodes.join(above, ["key", "pos"])
            above = rows
            continue
        climbed = _climbed(nodes)
        for level, run in ((1, "run1"), (2, "run2")):
            # A node's siblings, from its first row to all rows below it; the order is kept.
            below = Window.partitionBy(*["key", "block", "run2", "run1"][:5 - level])
            climbed = climbed.withColumn(f"sibs{level}", F.max(f"sibs{level}").over(below))
        own = F.array_compact(F.array(*[F.when(F.col(f"sibs{j}").isNotNull(), F.struct(
            _slot(j).cast("int").alias("slot"), F.col(f"sibs{j}").alias("sibs")))
            for j in range(LEVELS)]))
        others = [c for c in above.columns if c not in (*nodes.columns, "path")]
        up = above.select("key", F.col("pos").alias("block"), F.col("path").alias("up"), *others)
        rows = climbed.join(up, ["key", "block"]).select(
            *nodes.columns, *others, F.concat(own, "up").alias("path"))
        above = rows if k == len(rounds) - 1 else stored(rows, "paths")
    return rows


def proofs(leaves):
    """doc_id, leaf, bent, subroot, root, path of every leaf of ``leaves`` (see that function)."""
    own = leaves.select(F.col("source_key").alias("key"), "doc_id", F.col("leaf").alias("h0"), "bent")
    placed = stored(running(stored(own, "leaves"), ["key"], ["doc_id", "h0"], name="sources"),
                    "placed")
    lower = _rounds(placed)
    tops = lower[-1].select(F.lit("").alias("key"), F.col("key").alias("source_key"), "h0")
    upper = _rounds(stored(running(tops, ["key"], ["source_key"], name="subroots"), "tops"))
    root = upper[-1].select("key", F.col("h0").alias("root"),
                            F.expr("array()").cast("array<struct<slot:int,sibs:string>>").alias("path"))
    subroots = stored(_descended(upper, root).select(
        F.col("source_key").alias("key"), F.col("h0").alias("subroot"), "root", "path"), "subroots")
    return _descended(lower, subroots).select(
        "doc_id", F.col("h0").alias("leaf"), "bent", "subroot", "root", "path")


def folded(leaf="leaf", path="path"):
    """The root that a leaf and its path give."""
    return F.expr(f"aggregate({path}, {leaf}, (acc, x) -> sha2(concat("
                  "substr(x.sibs, 1, 64 * x.slot), acc, substr(x.sibs, 64 * x.slot + 1)), 256))")


def op13_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and whether it holds after tampering."""
    found = proofs(leaves(table(spark, sf_dir, "documents")))
    siblings = F.array_join(F.transform("path", lambda x: x.sibs), "")
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded("bent").alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
