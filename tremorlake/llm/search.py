"""Exact top-k search by inner product (6): vector-approximation files.

Every component is quantised to a cell of its block of vectors. A scan of the cells gives each query
an upper bound of every vector's score; exact vectors are then read in the order of that bound until
the k-th exact score is above all bounds left. Scores found in earlier blocks of a task carry over,
so later blocks read few exact vectors. Queries go to the tasks in groups of bounded size, one pass
over the vectors each.

Vectors that are null, or hold a null or non-finite component, or have no id, take no part. Shorter
vectors count as padded with zeros. A repeated row is a candidate of its own; of equal scores the
smaller id comes first. An empty table gives no rows. Components are exact up to 2**20 in size.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import workspace
from .common import slices, stored, table

QUERY_GROUP = 32_768  # queries sent to every task at once; 16 MB at 64 components
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096
CELLS = 64  # per component


def _matrix(ids, rows, vectors):
    """The vectors of a batch that take part, as integers."""
    keep, out = [], []
    for k, v in enumerate(vectors):
        if v is None or ids[k] is None:
            continue
        x = np.array([np.nan if c is None else c for c in v], np.float64)
        if np.isfinite(x).all():
            keep.append(k)
            out.append(np.floor(256 * x).astype(np.int64))
    width = max(map(len, out), default=0)
    made = np.zeros((len(out), width), np.int64)
    for k, x in enumerate(out):
        made[k, :len(x)] = x
    return (np.array([ids[k] for k in keep], np.int64),
            np.array([rows[k] for k in keep], np.int64), made)


def _wide(x, width):
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries, k):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, q, score, ids):
        """Take in pairs of a query and a scored vector."""
        if not len(q):
            return
        touched = np.unique(q)
        q = np.concatenate([np.repeat(touched, self.k), q])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, -score.astype(np.float64), q)) if abs(score[score > np.iinfo(
            np.int64).min]).max(initial=0) < 2**53 else np.lexsort((ids, ~score, q))
        q, score, ids = q[order], score[order], ids[order]
        start = np.searchsorted(q, touched)
        take = start[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = score[take], ids[take]


def _cells(vectors):
    """Lower and upper edge of the cell of every component: the approximation of a block."""
    low, high = vectors.min(0), vectors.max(0)
    step = np.maximum(1, -(-(high - low + 1) // CELLS))
    code = ((vectors - low) // step).astype(np.uint8)
    edge = low + step * code.astype(np.int64)
    return edge.astype(np.float64), np.minimum(edge + step - 1, high).astype(np.float64)


def scan(queries, own_rows, best, ids, rows, vectors):
    """Search one block of vectors; returns how many exact vectors were read."""
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = _wide(queries, width), _wide(vectors, width)
    low, high = _cells(vectors)
    read = 0
    for a in range(0, len(queries), QUERY_BLOCK):
        own = queries[a:a + QUERY_BLOCK].astype(np.float64)
        bound = np.maximum(own, 0) @ high.T + np.minimum(own, 0) @ low.T
        bound += 1e-9 * np.abs(bound) + 0.5
        bound[own_rows[a:a + QUERY_BLOCK, None] == rows[None, :]] = -np.inf
        wave = min(2 * best.k, len(ids))
        while True:
            # The k-th score found so far: what is bounded below it is out for certain.
            kth = best.score[a:a + QUERY_BLOCK, -1].astype(np.float64)
            bound[bound < kth[:, None]] = -np.inf
            open_q = np.flatnonzero((bound > -np.inf).any(1))
            if not len(open_q):
                break
            top = np.argpartition(-bound[open_q], wave - 1, axis=1)[:, :wave]
            q, x = np.repeat(open_q, wave), top.ravel()
            live = bound[q, x] > -np.inf
            q, x = q[live], x[live]
            bound[q, x] = -np.inf
            score = np.einsum("ij,ij->i", queries[a + q], vectors[x])
            best.offer(a + q, score, ids[x])
            read += len(q)
    return read


def _searched(vectors, group, k):
    """Best k of each query of the group in each task."""
    width = max((len(v) for *_, v in group), default=0)
    queries = np.zeros((len(group), width), np.int64)
    for j, (_, _, v) in enumerate(group):
        queries[j, :len(v)] = v
    own_rows = np.array([r for r, _, _ in group], np.int64)
    names = np.array([i for _, i, _ in group], np.int64)

    def run(batches):
        best = Best(len(names), k)
        held, count = [], 0

        def flush():
            width = max(m.shape[1] for *_, m in held)
            ids, rows, all_ = (np.concatenate([h[0] for h in held]),
                               np.concatenate([h[1] for h in held]),
                               np.concatenate([_wide(h[2], width) for h in held]))
            scan(queries, own_rows, best, ids, rows, all_)

        for batch in slices(batches):
            made = _matrix(*[batch.column(c).to_pylist() for c in ("id", "row", "vector")])
            if len(made[0]):
                held.append(made)
                count += len(made[0])
            if count >= VECTOR_BLOCK:
                flush()
                held, count = [], 0
        if held:
            flush()
        q, at = np.nonzero(best.id != np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_pydict({
            "query_row": own_rows[q], "query_id": names[q], "vec_id": best.id[q, at],
            "score": best.score[q, at]})

    return vectors.mapInArrow(
        run, "query_row bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(vectors, is_query, k=5, id_column="vec_id", vector_column="embedding"):
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the k best others.

    ``is_query``: a condition on the table's columns.
    """
    # Written once: row numbers made again might be others.
    vectors = stored(vectors.select(
        F.col(id_column).alias("id"), F.col(vector_column).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row")), "vectors")
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c)
                      & (F.abs(c) < F.lit(float("inf"))))
    asked = vectors.where(F.col("asks") & F.col("id").isNotNull() & F.col("vector").isNotNull()
                          & F.coalesce(finite, F.lit(False))).select(
        "row", "id", F.transform("vector", lambda c: F.floor(256 * c.cast("double"))).alias("v"))
    fields = "query_id bigint, rank int, vec_id bigint, score bigint"
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    path, last = None, -1
    # Queries by number, a bounded group at a time: its rows are written before the next is read.
    while True:
        group = [(r.row, r.id, r.v) for r in
                 asked.where(F.col("row") > last).orderBy("row").limit(QUERY_GROUP).collect()]
        if not group:
            break
        path = path or workspace(vectors.sparkSession, "llm-found")
        found = _searched(vectors.select("id", "row", "vector"), group, k)
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        last = group[-1][0]
        if len(group) < QUERY_GROUP:
            break
    if not path:
        return vectors.sparkSession.createDataFrame([], fields)
    return vectors.sparkSession.read.schema(fields).parquet(path)


def op6_exact_search(spark, sf_dir):
    """The five best others of every fiftieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"), 5)
