"""Token-id output (10): documents as entropy-coded blocks of ids, in ascending doc_id order.

The file format is Parquet written by Spark's own committer, so lost tasks leave nothing behind.
A row of ``blocks`` is one independent block: ``payload`` (coded ids, see ``rans``), its place
(``part``, ``block``), the documents in it and how many ids of each. ``table`` holds the shared
frequencies of the coder. A block ends before a document that no longer fits; only a longer
document goes on in the next blocks. Any set of blocks can be decoded in parallel.

Null or empty text: only the end id. Rows of one doc_id keep the order of the input; null ids come
first. An empty table gives files without blocks. Only doc_id and text are read.
"""

import struct
import zlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import workspace
from . import rans
from .common import fresh, mapped, part_number, stored, table
from .tokens import encoder

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
TABLE_BOUND = 1 << 19  # ids a vocabulary may have; bounds the frequency table that tasks get

RAW = "part int, block int, kind string, payload binary, doc_ids array<bigint>, " \
      "doc_ids_count array<bigint>, doc_more array<boolean>"


def _ordered(docs):
    """In ranges of doc_id; the row number splits even a doc_id of very many rows."""
    docs = docs.select("doc_id", "text")
    (row,) = fresh(docs, "row")
    docs = docs.withColumn(row, F.monotonically_increasing_id())
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartitionByRange(n, "doc_id", row).sortWithinPartitions("doc_id", row) \
        .select("doc_id", "text")


def _raw_blocks(docs, tokenizer, end_id):
    """Ids of whole documents as uncoded blocks, and last the id counts of the task."""
    def run(batches):
        import zstandard

        part, number, counts = part_number(), 0, np.zeros(0, np.int64)
        held, rows, total = [], [], 0
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def block():
            nonlocal number, held, rows, total, counts
            data = np.concatenate(held)
            seen = np.bincount(data, minlength=len(counts))
            seen[:len(counts)] += counts
            counts = seen
            if len(seen) <= 1 << 16:
                data = data.astype("<u2")
            out = [[part], [number], ["ids"], [squeeze(data.tobytes())], [[r[0] for r in rows]],
                   [[r[1] for r in rows]], [[r[2] for r in rows]]]
            number, held, rows, total = number + 1, [], [], 0
            return out

        for ids, texts in batches:
            for doc, data in zip(ids, encoder(tokenizer, end_id).encode(texts)):
                own = np.frombuffer(data, "<u4")
                if total and total + len(own) > rans.BLOCK:
                    yield block()
                for at in range(0, len(own), rans.BLOCK):
                    if total >= rans.BLOCK:
                        yield block()
                    piece = own[at:at + rans.BLOCK]
                    held.append(piece)
                    rows.append((doc, len(piece), at + len(piece) < len(own)))
                    total += len(piece)
        if total:
            yield block()
        used = np.flatnonzero(counts)
        yield [[part], [-1], ["counts"], [np.stack([used, counts[used]]).astype("<i8").tobytes()],
               [None], [None], [None]]

    return mapped(_ordered(docs), RAW, run)


def _frequencies(raw):
    """The corpus counts of every id: summed over tasks by id, then at most one row per id."""
    def rows(batches):
        for (payload,) in batches:
            both = [np.frombuffer(p, "<i8").reshape(2, -1) for p in payload]
            both = np.concatenate(both, axis=1) if both else np.zeros((2, 0), np.int64)
            ids, at = np.unique(both[0], return_inverse=True)
            yield [ids, np.bincount(at, both[1], len(ids)).astype(np.int64)]

    counts = raw.where("kind = 'counts'").select("payload")
    return mapped(counts, "id bigint, n bigint", rows).groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs, path, tokenizer=TOKENIZER, end_id=END_ID):
    """Write the documents' ids below ``path``: ``blocks`` and ``table``."""
    import zstandard  # noqa: F401  (needed by the tasks: fail here, not there)

    raw = stored(_raw_blocks(docs, tokenizer, end_id), "ids")
    counts = _frequencies(raw).limit(TABLE_BOUND + 1).collect()
    if len(counts) > TABLE_BOUND:
        raise ValueError("more ids than the shared table may have")
    spark = docs.sparkSession
    spark.createDataFrame([(r.id, r.n) for r in counts], "id bigint, n bigint") \
        .coalesce(1).write.parquet(f"{path}/table")
    shared = rans.Table([r.id for r in counts], [r.n for r in counts])

    def code(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for part, number, payload, docs_, lengths, more in batches:
            for row in zip(part, number, payload, docs_, lengths, more):
                data = unpack(row[2])
                ids = np.frombuffer(data, f"<u{len(data) // sum(row[4])}")
                yield [[row[0]], [row[1]], [len(ids)], [rans.encode(ids, shared)],
                       [row[3]], [row[4]], [row[5]]]

    blocks = mapped(
        raw.where("kind = 'ids'").drop("kind"),
        "part int, block int, n_ids bigint, payload binary, doc_ids array<bigint>, "
        "doc_ids_count array<bigint>, doc_more array<boolean>", code)
    blocks.write.parquet(f"{path}/blocks")
    return path


def _open(spark, path):
    rows = spark.read.parquet(f"{path}/table").collect()
    return spark.read.parquet(f"{path}/blocks"), rans.Table([r.id for r in rows],
                                                            [r.n for r in rows])


def _started(blocks):
    """Blocks with the ids before them; one row per block and per part is summed, no id."""
    own = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = own.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    spans = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0))
                          .alias("inside")).join(parts, "part")
    return spans.select("part", "block", (F.col("before") + F.col("inside")).alias("start"))


def read_pieces(spark, path):
    """(part, block, nth, doc_id, start, n_tokens, more, crc32) of each stretch of ids of one
    document in one block, decoded from the files."""
    blocks, shared = _open(spark, path)

    def read(batches):
        for part, number, payload, docs, lengths, more, start in batches:
            for p, b, data, ids_of, n_of, more_of, at in zip(
                    part, number, payload, docs, lengths, more, start):
                ids, out, here = rans.decode(data, shared), [], 0
                for k, (doc, n, goes_on) in enumerate(zip(ids_of, n_of, more_of)):
                    own = ids[here:here + n].astype("<u4").tobytes()
                    out.append((p, b, k, doc, at + here, n, goes_on, zlib.crc32(own)))
                    here += n
                yield list(map(list, zip(*out)))

    # A block's start is one small row: the payloads themselves stay where the files are.
    placed = blocks.drop("n_ids").join(_started(blocks), ["part", "block"])
    return mapped(
        placed, "part int, block int, nth int, doc_id bigint, start bigint, n_tokens bigint, "
        "more boolean, crc32 bigint", read)


def joined_crc(first, second, length):
    """CRC-32 of two byte strings put together, from their own and the second's length."""
    def times(matrix, vector):
        total = 0
        for row in matrix:
            if vector & 1:
                total ^= row
            vector >>= 1
        return total

    step = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    length *= 8
    while length:
        if length & 1:
            first = times(step, first)
        step = [times(step, row) for row in step]
        length >>= 1
    return first ^ second


def documents(spark, path):
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    pieces = read_pieces(spark, path)
    pieces = stored(pieces, "read")
    lead = F.lag("more").over(Window.partitionBy("part").orderBy("block", "nth"))
    # Only documents longer than a block have several stretches; those are few and each is bounded
    # by its own length, so nothing but the ends of blocks is looked at.
    split = pieces.where("more").select("doc_id", "part").distinct()
    whole = pieces.join(split.select("part").distinct(), "part", "left_anti") \
        .select("doc_id", "start", "n_tokens", F.col("crc32").alias("ids_crc32"))
    parts = pieces.join(split.select("part").distinct(), "part", "left_semi") \
        .withColumn("head", ~F.coalesce(lead, F.lit(False)))
    number = F.sum(F.col("head").cast("int")).over(
        Window.partitionBy("part").orderBy("block", "nth"))
    grouped = parts.withColumn("number", number).groupBy("part", "number").agg(
        F.first("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.struct("start", "n_tokens", "crc32"))).alias("all"))

    def fold(batches):
        for doc, stretches in batches:
            out = []
            for d, rows in zip(doc, stretches):
                total, check = rows[0]["n_tokens"], rows[0]["crc32"]
                for r in rows[1:]:
                    check = joined_crc(check, r["crc32"], 4 * r["n_tokens"])
                    total += r["n_tokens"]
                out.append((d, rows[0]["start"], total, check))
            yield list(map(list, zip(*out))) or [[], [], [], []]

    long = mapped(grouped.select("doc_id", "all"),
                  "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", fold)
    return whole.unionByName(long)


def op10_token_ids(spark, sf_dir):
    """All documents' ids written to files and read back."""
    path = write_ids(table(spark, sf_dir, "documents"), workspace(spark, "llm-token-ids"))
    return documents(spark, path)
