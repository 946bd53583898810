"""Mixing sources to target weights (4): soft memberships and fitted document rates.

A softmax classifier trained on the labelled table gives each document posteriors over the domains.
Nonnegative rates r, one per document, are fitted so that the expected tokens of each domain, sum of
r * tokens * posterior, meet the targets in least squares (each domain's error weighed by its
target), staying near 1 otherwise. At the optimum a document's rate follows from its posteriors and
one number per domain, the part by which the domain misses its target. These few numbers minimize a
convex function, the dual, and are found by Newton's method: a round is one aggregate over the
documents, for several lengths of the step at once, until the optimum is reached.

Tokens are words (runs of non-space). Null or empty text has none: its rate follows from the base
posteriors and moves no total. Without labels every document belongs to all domains alike and every
rate is 1. Repeated rows have equal rates. An empty table gives no rows. A domain without tokens cannot meet its target.
"""

import numpy as np
from pyspark.sql import functions as F

from .common import appended, fresh, mapped, stored, table
from .toxicity import labelled, reader, screen

# Domain: condition on the labels, share of the tokens wanted.
DOMAINS = (("good", "quality = 1 and toxic = 0", 0.85),
           ("low_quality", "quality = 0 and toxic = 0", 0.10),
           ("toxic", "quality = 1 and toxic = 1", 0.04),
           ("toxic_low_quality", "quality = 0 and toxic = 1", 0.01))
SETTLED, NEAR_ONE = 1e-7, 1e-3
LENGTHS = tuple(0.5 ** k for k in range(8))  # of a Newton step, tried at once
STEPS, RIDGE = 150, 1e-4
BLOCK = 16_384  # documents in a stored block


class Softmax:
    """Linear posteriors over domains from the features of ``toxicity.Reader``."""

    def __init__(self, features, domains):
        self.features = features
        self.w = np.zeros((2, len(features), domains))
        self.b = np.zeros(domains)
        self.fitted = False

    def posteriors(self, row, at, rate, n):
        z = np.empty((n, len(self.b)))
        for d in range(len(self.b)):
            z[:, d] = np.bincount(row, self.w[0, at, d] + self.w[1, at, d] * rate, n) + self.b[d]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, row, at, rate, y):
        n, domains = len(y), len(self.b)
        target = np.eye(domains)[y]
        self.b = np.log(np.maximum(target.mean(0), 1e-4))
        seen, seen_b = np.full(self.w.shape, 1e-8), np.full(domains, 1e-8)
        # Sums over the entries of a document or feature are sums of stretches of sorted rows.
        docs, first = np.unique(row, return_index=True)
        order = np.argsort(at, kind="stable")
        places, begin = np.unique(at[order], return_index=True)
        by_place, weight = row[order], rate[order]
        # Written over in every step: fresh arrays of this size cost more than the sums.
        some, other = np.empty(len(row)), np.empty(len(row))
        for _ in range(STEPS):
            z = np.tile(self.b, (n, 1))
            for d in range(domains if len(row) else 0):
                plain, scaled = np.ascontiguousarray(self.w[:, :, d])
                np.take(scaled, at, out=other, mode="clip")
                np.multiply(other, rate, out=other)
                np.take(plain, at, out=some, mode="clip")
                z[docs, d] += np.add.reduceat(np.add(some, other, out=some), first)
            z = np.exp(z - z.max(1, keepdims=True))
            g = z / z.sum(1, keepdims=True) - target
            grad = RIDGE * self.w
            for d in range(domains if len(row) else 0):
                np.take(np.ascontiguousarray(g[:, d]), by_place, out=some, mode="clip")
                grad[0, places, d] += np.add.reduceat(some, begin) / n
                np.multiply(some, weight, out=some)
                grad[1, places, d] += np.add.reduceat(some, begin) / n
            seen += grad ** 2
            self.w -= 0.3 * grad / np.sqrt(seen)
            seen_b += g.mean(0) ** 2
            self.b -= 0.3 * g.mean(0) / np.sqrt(seen_b)
        self.fitted = True
        return self

    def __call__(self, texts):
        """Posteriors and words of texts."""
        row, at, rate, words = reader(self.features).all(texts)
        return self.posteriors(row, at, rate, len(texts)), words.astype(float)


def classifier(docs, labels, domains=DOMAINS):
    """The softmax over domains fitted on a bounded sample of the labelled documents."""
    chain = tuple((name, condition) for name, condition, _ in domains)
    rows = stored(labelled(docs, labels, chain), "labelled")
    features, ys = screen(rows, chain), [f"y{k}" for k in range(len(chain))]

    def read(batches):
        for texts, *found in batches:
            yield [np.argmax(np.array(found), axis=0).tolist(), *reader(features).packed(texts)]

    # Rows of no domain teach nothing.
    some = " or ".join(f"{y} = 1" for y in ys)
    got = mapped(rows.where(some).select("text", *ys), "y int, at binary, rate binary",
                 read).collect()
    got.sort(key=lambda r: (bytes(r["at"]), bytes(r.rate), r.y))
    model = Softmax(features, len(domains))
    if not got:
        return model
    places = [np.frombuffer(r["at"], "<i4") for r in got]
    row = np.repeat(np.arange(len(got)), [len(p) for p in places])
    return model.fit(row, np.concatenate(places).astype(np.int64), np.concatenate(
        [np.frombuffer(r.rate, "<f4") for r in got]).astype(np.float64),
        np.array([r.y for r in got]))


def memberships(docs, model):
    """Blocks of documents: ids, tokens and posteriors as arrays, without texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own, held = shared.value, []

        def block():
            ids, n, p = zip(*held)
            return [[[x for part in ids for x in part]], [np.concatenate(n).tobytes()],
                    [np.concatenate(p).tobytes()]]

        for ids, texts in batches:
            found, n = own(texts)
            held.append((ids, n, found))
            if sum(len(h[0]) for h in held) >= BLOCK:
                yield block()
                held = []
        if held:
            yield block()

    return stored(mapped(docs.select("doc_id", "text"),
                         "doc_ids array<bigint>, tokens binary, posteriors binary", run), "soft")


def _unpacked(tokens, posteriors, domains):
    return (np.frombuffer(tokens, np.float64),
            np.frombuffer(posteriors, np.float64).reshape(-1, domains))


def rates(posteriors, pull):
    """Rates of documents where the domains miss their targets by the parts ``pull``."""
    return np.maximum(0, 1 - posteriors @ pull / NEAR_ONE)


def _summed(blocks, width, function):
    """Sum over all blocks of a vector that ``function`` makes of tokens and posteriors."""
    def run(batches):
        total = np.zeros(width)
        for tokens, posteriors in batches:
            for n, p in zip(tokens, posteriors):
                total += function(n, p)
        yield [list(range(width)), total]

    rows = mapped(blocks.select("tokens", "posteriors"), "k int, v double", run) \
        .groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r.k] = r.v
    return out


def _tried(blocks, pulls):
    """For each vector: the squares of the rates, the tokens and the products of the tokens of
    documents that stay, summed over documents."""
    domains = len(pulls[0])

    def each(n, p):
        n, p = _unpacked(n, p, domains)
        out = []
        for pull in pulls:
            r = rates(p, pull)
            kept = p * np.where(r > 0, n, 0)[:, None]
            out += [[n @ (r * r)], kept.T @ r, (p.T @ kept).ravel()]
        return np.concatenate(out)

    sums = _summed(blocks, len(pulls) * (1 + domains + domains * domains), each)
    return [(own[0], own[1:domains + 1], own[domains + 1:].reshape(domains, domains))
            for own in np.split(sums, len(pulls))]


def fit_rates(blocks, wanted, budget=None):
    """(pull, shares met): the vector that makes every document's rate.

    ``wanted``: share of the tokens per domain; ``budget``: tokens in all, those of the input by
    default.
    """
    wanted = np.asarray(wanted, float)
    pull = np.zeros(len(wanted))
    (now,) = _tried(blocks, [pull])
    budget = budget or now[1].sum()
    if not now[1].sum():
        return pull, pull

    def state(pull, sums):
        """The dual and, as parts of the targets, its slope."""
        squares, met, _ = sums
        return ((wanted * pull * (pull / 2 + 1)).sum() + NEAR_ONE / 2 * squares / budget,
                wanted * (1 + pull) - met / budget)

    height, slope = state(pull, now)
    short = 1.0
    while np.abs(slope / wanted).max() > SETTLED and short > 1e-12:
        move = short * np.linalg.solve(np.diag(wanted) + now[2] / budget / NEAR_ONE, -slope)
        points = [pull + length * move for length in LENGTHS]
        found = [(*state(p, sums), p, sums)
                 for p, sums in zip(points, _tried(blocks, points))]
        best = min(found, key=lambda f: f[0])
        # At the end the dual is flat to the last digit and the slope decides.
        if best[0] < height or np.abs(best[1]).max() < np.abs(slope).max():
            height, slope, pull, now = best
            short = 1.0
        else:
            short *= LENGTHS[-1] / 2
    return pull, now[1] / budget


def fitted(blocks, domains, pull):
    """doc_id, tokens, posteriors and rate of every document."""
    def run(batches):
        for ids, tokens, posteriors in batches:
            for own, n, p in zip(ids, tokens, posteriors):
                n, p = _unpacked(n, p, domains)
                yield [own, n.astype(np.int64), p.tolist(), rates(p, pull)]

    return mapped(blocks, "doc_id bigint, tokens bigint, posteriors array<double>, rate double",
                  run)


def mixed(docs, labels, domains, budget=None):
    """``docs`` repeated or left out by their rates: the whole part of a rate always, the rest by a
    hash of id and text, so that a run gives the same rows again."""
    model = classifier(docs, labels, domains)
    if not model.fitted:
        return docs
    pull, _ = fit_rates(memberships(docs, model), [w for *_, w in domains], budget)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        own = shared.value
        return lambda texts: [rates(own(texts)[0], pull)]

    (rate, copies) = fresh(docs, "rate", "copies")
    out = appended(docs, ["text"], f"`{rate}` double", compute)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("bigint")
    return out.withColumn(copies, F.explode(F.array_repeat(F.lit(0), times.cast("int")))) \
        .drop(rate, copies)


def op4_mixing(spark, sf_dir):
    """Posteriors and rate of every document for the target weights of ``DOMAINS``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier(docs, table(spark, sf_dir, "labels"))
    blocks = memberships(docs, model)
    pull = np.zeros(len(DOMAINS))
    if model.fitted:
        pull, _ = fit_rates(blocks, [w for *_, w in DOMAINS])
    return fitted(blocks, len(DOMAINS), pull).select(
        "doc_id", "tokens", *[F.col("posteriors")[k].alias(f"p_{name}")
                              for k, (name, *_) in enumerate(DOMAINS)], "rate")
