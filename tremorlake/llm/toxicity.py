"""Toxicity (9): a classifier chain of linear models over words and word beginnings.

The categories come in order, and each model also reads the log-odds that the models before it gave;
in training those are out-of-fold, so a later model learns from odds as it will see them. Features
are the words and word beginnings that part the labelled documents of some category best (chi-square,
at most ``FEATURES`` a category): whether a document holds one, and how often per word. Screening
and features are Spark jobs; the driver fits on at most about ``LABELLED`` labelled documents,
chosen by hash, with at most ``FEATURES`` x categories features.

Null or empty text: no feature, so the base rates. Labels with a null are left out; of repeated
labels of a document the larger counts. Without labelled documents of both kinds a category has its
base rate everywhere and rejects nothing. An empty table gives no rows.
"""

import math
import re
from collections import Counter, defaultdict
from itertools import chain as chained

import numpy as np
from pyspark.sql import functions as F

from .common import appended, fresh, kept, mapped, stored, table

LABELLED, FEATURES = 40_000, 512
FOLDS, STEPS, RIDGE = 3, 120, 1e-3
CACHED = 300_000
# Category: condition on the labels. Later ones read the odds of those before.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"),
         ("toxic_low_quality", "toxic = 1 and quality = 0"))

_WORDS = re.compile(r"[^\W\d_]+")
_BEGINNINGS = range(4, 9)
_SHORTEST, _LONGEST = min(_BEGINNINGS), max(_BEGINNINGS)


def _words(chunk):
    """The runs of letters in a chunk; nearly all are the chunk itself, perhaps less its last mark."""
    if chunk.isalpha():
        return (chunk,)
    if chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():
        return (chunk[:-1],)
    return _WORDS.findall(chunk)


def features_of(chunk):
    """The words of a lower-case chunk and their beginnings."""
    out = []
    for word in _words(chunk):
        out.append(word)
        out += [word[:k] + "*" for k in range(_SHORTEST, min(len(word), _LONGEST + 1))]
    return out


def labelled(docs, labels, chain=CHAIN, most=LABELLED):
    """text and a 0/1 column per category, of a bounded sample of the labelled documents."""
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"),
                                          F.max("toxic").alias("toxic"))
    labels = labels.dropna().select("doc_id", *[F.expr(f"int({c})").alias(f"y{k}")
                                                for k, (_, c) in enumerate(chain)])
    n = labels.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    few = labels.where(share < int(1_000_000 * most / max(n, most)))
    # At most about ``most`` rows of a few numbers: bounded by the parameter.
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").withColumn(
        "fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int"))


def screen(rows, chain=CHAIN, most=FEATURES):
    """The features with the largest chi-square of any category."""
    ys = [f"y{k}" for k in range(len(chain))]

    def count(batches):
        seen, known = {}, _Numbers()
        for texts, *labels in batches:
            for text, *y in zip(texts, *labels):
                own = known((text or "").lower().split())
                counts = seen.get(tuple(y))
                if counts is None or len(counts) < len(known.number):
                    counts = np.zeros(2 * len(known.number), np.int64)
                    old = seen.get(tuple(y), counts[:0])
                    counts[:len(old)] = old
                    seen[tuple(y)] = counts
                counts[own] += 1  # once a document, however often a number stands there
            if len(known.number) > 1_000_000:  # a bounded dictionary; the sums go on in Spark
                yield from _columns(seen, known)
                seen, known = {}, _Numbers()
        yield from _columns(seen, known)

    def _columns(seen, known):
        """One block for the documents of the same labels."""
        names = list(known.number)
        for y, counts in seen.items():
            some = np.flatnonzero(counts)
            n = counts[some].tolist()
            yield [[names[k] for k in some], n, *[n if v else [0] * len(n) for v in y]]

    fields = "feature string, n bigint, " + ", ".join(f"{y} bigint" for y in ys)
    sums = mapped(rows.select("text", *ys), fields, count).groupBy("feature").agg(
        F.sum("n").alias("n"), *[F.sum(y).alias(y) for y in ys]).where("n >= 5")
    sums = stored(sums, "features")
    whole = rows.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    chosen = set()
    for y in ys:
        n, n1 = whole.n, whole[y] or 0
        if not 0 < n1 < n:
            continue
        a, b = F.col(y), F.col("n") - F.col(y)
        c, d = n1 - a, (n - n1) - b
        score = (a * d - b * c) ** 2 * n / (F.col("n") * (n - F.col("n")) * float(n1) * (n - n1))
        best = sums.where(F.col("n") < n).orderBy(F.desc(score), "feature").limit(most)
        chosen.update(r.feature for r in best.select("feature").collect())
    return sorted(chosen)


class _Numbers(dict):
    """Numbers of the features of chunks, in the order in which they are met."""

    def __init__(self):
        self.number = {}

    def __missing__(self, chunk):
        if len(self) >= CACHED:
            self.clear()
        number = self.number
        self[chunk] = own = [number.setdefault(f, len(number)) for f in features_of(chunk)]
        return own

    def __call__(self, chunks):
        found = chained.from_iterable(map(self.__getitem__, set(chunks)))
        return np.fromiter(found, np.int64)


class _Places(dict):
    """Places of a chunk's chosen features; most chunks have none."""

    def __init__(self, features):
        place = {f: k for k, f in enumerate(features)}
        self.whole = {f: k for f, k in place.items() if f[-1] != "*"}
        # Every feature of a word begins as the word does: what begins a chosen one, and its place.
        self.begun = {f[:k]: place.get(f[:k] + "*") for f in (g.rstrip("*") for g in features)
                      for k in (len(f) if len(f) < _SHORTEST else _SHORTEST, *_BEGINNINGS)
                      if k <= len(f)}
        self.equal, self.lost = {}, 0

    def __missing__(self, chunk):
        begun, word = self.begun, chunk
        if not chunk.isalpha():
            word = chunk[:-1] if chunk[-1] in ",.;:!?" and chunk[:-1].isalpha() else None
        if word is None:
            found = tuple(set(chained.from_iterable(map(self.of, _WORDS.findall(chunk)))))
        else:
            found = self.of(word) if word[:_SHORTEST] in begun else ()
        if len(self) < CACHED:
            self[chunk] = found
        else:
            self.lost += 1
            if self.lost > 10 * CACHED:  # the texts have changed
                self.lost = 0
                self.clear()
                self.equal.clear()
        return found

    def of(self, word):
        """Places of the features of a word."""
        found, begun = [], self.begun
        if word[:_SHORTEST] not in begun:
            return ()
        if word in self.whole:
            found.append(self.whole[word])
        for k in range(_SHORTEST, min(len(word), _LONGEST + 1)):
            start = word[:k]
            if start not in begun:
                break
            if begun[start] is not None:
                found.append(begun[start])
        own = tuple(set(found))
        return self.equal.setdefault(own, own)  # few and near in memory


class Reader:
    """Places and rates of the chosen features in texts, and their words."""

    def __init__(self, features):
        self.known = _Places(features)

    def __call__(self, text):
        _, at, rate, (words,) = self.all([text])
        return at, rate, int(words)

    def all(self, texts):
        """Row, place and rate of every feature of the texts in turn, and the words of each."""
        found, words, known = [], [], self.known.__getitem__
        for text in texts:
            chunks = (text or "").lower().split()
            found.append(Counter(chained.from_iterable(map(known, chunks))))
            words.append(len(chunks))
        sizes, words = np.array([len(f) for f in found], np.int64), np.array(words, np.int64)
        n = np.fromiter(chained.from_iterable(f.values() for f in found), np.float64, sizes.sum())
        at = np.fromiter(chained.from_iterable(found), np.int64, sizes.sum())
        row = np.repeat(np.arange(len(texts)), sizes)
        return row, at, np.log1p(50 * n / np.maximum(1, words)[row]), words

    def packed(self, texts):
        """Places and rates of each text as bytes of 32-bit numbers."""
        row, at, rate, _ = self.all(texts)
        ends = np.cumsum(np.bincount(row, minlength=len(texts)))[:-1]
        return [[part.tobytes() for part in np.split(values, ends)]
                for values in (at.astype("<i4"), rate.astype("<f4"))]


def reader(features):
    """The worker's reader of these features."""
    return kept(("reader", *features), lambda: Reader(features))


class Linear:
    """Logistic regression over sparse rows and a few dense columns."""

    def __init__(self, width, dense):
        self.w, self.r = np.zeros(width), np.zeros(width)
        self.v, self.b = np.zeros(dense), 0.0

    def odds(self, row, at, rate, dense, n):
        return np.bincount(row, self.w[at] + self.r[at] * rate, n) + dense @ self.v + self.b

    def fit(self, row, at, rate, dense, y):
        n = len(y)
        p = y.mean()
        self.b = math.log(max(p, 1e-6) / max(1 - p, 1e-6))
        if not 0 < p < 1:
            return self
        seen = [np.full(x.shape, 1e-8) for x in (self.w, self.r, self.v)]
        seen_b = 1e-8
        for _ in range(STEPS):  # full gradients, a step size per weight
            g = 1 / (1 + np.exp(-self.odds(row, at, rate, dense, n))) - y
            grads = (np.bincount(at, g[row], len(self.w)) / n + RIDGE / 10 * self.w,
                     np.bincount(at, g[row] * rate, len(self.w)) / n + RIDGE / 10 * self.r,
                     dense.T @ g / n + RIDGE * self.v)
            for x, s, d in zip((self.w, self.r, self.v), seen, grads):
                s += d * d
                x -= 0.5 * d / np.sqrt(s)
            seen_b += g.mean() ** 2
            self.b -= 0.5 * g.mean() / math.sqrt(seen_b)
        return self


class Chain:
    """The models in order and, per category, the probability that rejects."""

    def __init__(self, names, features):
        self.names, self.features = names, features
        self.models, self.cuts = [], []

    def fit(self, fold, row, at, rate, ys):
        n, dense = len(fold), np.zeros((len(fold), 0))
        for y in ys:
            out = np.zeros(n)
            for k in range(FOLDS):
                own = fold[row] != k
                inside = np.flatnonzero(fold != k)
                if not len(inside):
                    continue
                number = np.searchsorted(inside, row[own])
                model = Linear(len(self.features), dense.shape[1]).fit(
                    number, at[own], rate[own], dense[inside], y[inside])
                out[fold == k] = model.odds(row, at, rate, dense, n)[fold == k]
            self.models.append(Linear(len(self.features), dense.shape[1]).fit(
                row, at, rate, dense, y))
            self.cuts.append(_cut(out, y))
            dense = np.column_stack([dense, np.clip(out, -12, 12)])
        return self

    def predict(self, texts, read):
        row, at, rate, _ = read.all(texts)
        dense = np.zeros((len(texts), 0))
        for model in self.models:
            odds = model.odds(row, at, rate, dense, len(texts))
            dense = np.column_stack([dense, np.clip(odds, -12, 12)])
        return dense


def _cut(odds, y):
    """The log-odds from which out-of-fold predictions have the best F1, at least even odds;
    infinite without both kinds."""
    if not 0 < y.sum() < len(y):
        return math.inf
    order = np.argsort(-odds, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    after = odds[order[best + 1]] if best + 1 < len(y) else odds[order[best]] - 1
    return max(0.0, float((odds[order[best]] + after) / 2))


def train(docs, labels, chain=CHAIN):
    """The chain fitted on the labelled documents."""
    rows = stored(labelled(docs, labels, chain), "labelled")
    features = screen(rows, chain)
    ys = [f"y{k}" for k in range(len(chain))]

    def read(batches):
        for texts, folds, *labels in batches:
            yield [folds, *labels, *reader(features).packed(texts)]

    fields = "fold int, " + ", ".join(f"{y} int" for y in ys) + ", at binary, rate binary"
    got = mapped(rows.select("text", "fold", *ys), fields, read).collect()  # bounded by LABELLED
    # A fixed order: the sums of the fit do not depend on how the rows came in.
    got.sort(key=lambda r: (bytes(r["at"]), bytes(r.rate), r.fold, *[r[y] for y in ys]))
    model = Chain([name for name, _ in chain], features)
    places = [np.frombuffer(r["at"], "<i4") for r in got]
    row = np.repeat(np.arange(len(got)), [len(p) for p in places])
    at = np.concatenate(places).astype(np.int64) if got else np.zeros(0, np.int64)
    rate = np.concatenate([np.frombuffer(r.rate, "<f4") for r in got]).astype(np.float64) \
        if got else np.zeros(0)
    fold = np.array([r.fold for r in got], np.int64)
    if not got:
        return None
    return model.fit(fold, row, at, rate, [np.array([r[y] for r in got], float) for y in ys])


def judged(docs, model, chain=CHAIN, rejects="toxic"):
    """``docs`` with a probability per category and whether it is rejected, under new names
    (returned second)."""
    names = fresh(docs, *[f"p_{name}" for name, _ in chain], "rejected")
    fields = ", ".join(f"`{n}` double" for n in names[:-1]) + f", `{names[-1]}` boolean"
    which = [name for name, _ in chain].index(rejects)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute():
        own = shared.value
        if own is None:
            return lambda texts: [*[[0.0] * len(texts)] * len(chain), [False] * len(texts)]

        def run(texts):
            odds = own.predict(texts, reader(own.features))
            return [*(1 / (1 + np.exp(-odds))).T.tolist(),
                    (odds[:, which] >= own.cuts[which]).tolist()]
        return run

    return appended(docs, ["text"], fields, compute), names


def op9_toxicity(spark, sf_dir):
    """Category probabilities of every document and whether it is rejected as toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, names = judged(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", *names[:-1], F.col(names[-1]).alias("toxic"))
