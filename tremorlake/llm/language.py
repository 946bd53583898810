"""Language ID (3): interpolated Kneser-Ney character models, one per language.

Letters become 64 symbols (a-z, 37 classes of other letters, and one for every run of non-letters),
so a 4-gram is a 24-bit key: each order of the model is a sorted array of at most 2**24 keys with a
column of log-probabilities per language, whatever the corpus. Counts are taken over every training
document in the tasks and summed by key. A document goes to the language with the least cross-entropy
per symbol. Documents held back from counting calibrate the rejection: per language and length class,
a cross-entropy above the ``1 - ALPHA`` quantile of known documents by ``SLACK`` bits is rejected.

Null text or text without a letter: ``und``, score 0, rejected. Without any training document every
document is ``und`` with score 0 and none with a letter is rejected. Null languages are not learned;
a null doc_id has remainder 0 (held out). Repeated rows count as often as they stand. An empty table
gives no rows. ``source`` and ``doc_id`` are never inputs, ``lang`` only of training documents.
"""

import numpy as np
from pyspark.sql import functions as F

from .common import appended, fresh, mapped, table

ORDER, SYMBOLS, WIDTH = 4, 64, 6
ALPHA, SLACK = 0.0001, 1.0
SHARP = 20.0  # bits per symbol to odds, for the score
PIECE = 1 << 20  # characters handled at once; a longer text goes on in the next piece

_symbols = None


def symbol_table():
    """Symbol of every code point, made once per process."""
    global _symbols
    if _symbols is None:
        made = np.zeros(0x110000, np.uint8)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                low = c.lower()[0]
                made[point] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 37
        _symbols = made
    return _symbols


def _pieces(texts):
    """(text number, part of the text), in groups of bounded size."""
    group, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text or ""), PIECE):
            group.append((k, text[at:at + PIECE]))
            size += len(group[-1][1])
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def grams(group):
    """Text numbers and 4-gram keys of every symbol; runs of non-letters are one symbol."""
    joined = "".join(t for _, t in group).encode("utf-32-le", "surrogatepass")
    sym = symbol_table()[np.frombuffer(joined, "<u4")]
    sizes = np.array([len(t) for _, t in group])
    of = np.repeat(np.arange(len(group)), sizes)
    first = np.zeros(len(sym), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    keep = sym > 0
    keep[1:] |= sym[:-1] > 0
    keep[first] = sym[first] > 0  # a text begins at a boundary anyway
    sym, of = sym[keep].astype(np.uint32), of[keep]
    key = sym.copy()
    for back in range(1, ORDER):
        before = np.zeros(len(sym), np.uint32)
        before[back:] = np.where(of[back:] == of[:-back], sym[:-back], 0)
        key |= before << np.uint32(WIDTH * back)
    return np.array([k for k, _ in group])[of], key


def gram_counts(docs, lang):
    """(lang, gram, n) over all documents with a language."""
    def run(batches):
        names, sums = {}, None

        def merge(found, counts):
            keys, at = np.unique(found, return_inverse=True)
            return keys, np.bincount(at, counts, len(keys)).astype(np.int64)

        for texts, langs in batches:
            code = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
            for group in _pieces(texts):
                of, key = grams(group)
                keys, counts = np.unique(code[of] << (ORDER * WIDTH) | key, return_counts=True)
                if sums is not None:
                    keys, counts = merge(np.concatenate([sums[0], keys]),
                                         np.concatenate([sums[1], counts]))
                sums = keys, counts
        if sums is not None:
            which = {v: k for k, v in names.items()}
            for at in range(0, len(sums[0]), 1 << 16):
                keys, counts = sums[0][at:at + (1 << 16)], sums[1][at:at + (1 << 16)]
                yield [[which[int(k)] for k in keys >> (ORDER * WIDTH)],
                       keys & ((1 << ORDER * WIDTH) - 1), counts]

    rows = mapped(docs.select("text", lang), "lang string, gram bigint, n bigint", run)
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(counts):
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return once / (once + 2 * twice) if once else 0.5


class Model:
    """Sorted key arrays of the orders, log2-probabilities and back-off weights by language."""

    def __init__(self, counts):
        """``counts``: {language: (sorted 4-gram keys, counts)}."""
        self.langs = sorted(counts)
        self.keys, self.logs, self.contexts, self.backs = [], [], [], []
        by_order = {}
        for lang, (keys, n) in counts.items():
            levels = [(keys, n)]
            for order in range(ORDER - 1, 0, -1):
                # Below the top, a gram counts once for each symbol seen before it.
                own, times = np.unique(levels[0][0] & ((1 << order * WIDTH) - 1),
                                       return_counts=True)
                levels.insert(0, (own, times))
            by_order[lang] = levels
        lower = None
        for order in range(ORDER):
            all_keys = np.unique(np.concatenate([v[order][0] for v in by_order.values()]))
            all_contexts = np.unique(all_keys >> WIDTH)
            prob = np.empty((len(all_keys), len(self.langs)))
            back = np.ones((len(all_contexts), len(self.langs)))
            for j, lang in enumerate(self.langs):
                own, n = by_order[lang][order]
                d = _discount(n)
                contexts, at = np.unique(own >> WIDTH, return_inverse=True)
                total = np.bincount(at, n)
                gamma = d * np.bincount(at) / total
                place = np.searchsorted(all_contexts, contexts)
                back[place, j] = gamma
                context = np.searchsorted(all_contexts, all_keys >> WIDTH)
                if order:
                    suffix = np.searchsorted(self.keys[-1], all_keys & ((1 << order * WIDTH) - 1))
                    under = lower[suffix, j]
                else:
                    under = 1 / SYMBOLS
                prob[:, j] = back[context, j] * under
                prob[np.searchsorted(all_keys, own), j] += np.maximum(n - d, 0) / total[at]
            self.keys.append(all_keys)
            self.contexts.append(all_contexts)
            self.logs.append(np.log2(prob).astype(np.float32))
            self.backs.append(np.log2(back).astype(np.float32))
            lower = prob

    def score(self, key):
        """log2-probability of the last symbol of each key, by language."""
        out = np.empty((len(key), len(self.langs)), np.float32)
        rest, weight = np.arange(len(key)), np.zeros((len(key), len(self.langs)), np.float32)
        for order in range(ORDER - 1, -1, -1):
            own = key[rest] & ((1 << (order + 1) * WIDTH) - 1)
            at = np.searchsorted(self.keys[order], own)
            at[at == len(self.keys[order])] = 0
            hit = self.keys[order][at] == own
            out[rest[hit]] = weight[hit] + self.logs[order][at[hit]]
            rest, weight, own = rest[~hit], weight[~hit], own[~hit]
            if not len(rest):
                return out
            at = np.searchsorted(self.contexts[order], own >> WIDTH)
            at[at == len(self.contexts[order])] = 0
            seen = self.contexts[order][at] == own >> WIDTH
            weight[seen] += self.backs[order][at[seen]]
        out[rest] = weight - np.log2(SYMBOLS)
        return out

    def entropies(self, texts):
        """Cross-entropy per symbol of each text by language, and its symbols."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for group in _pieces(texts):
            of, key = grams(group)
            found = self.score(key)
            for j in range(len(self.langs)):
                total[:, j] -= np.bincount(of, found[:, j], len(texts))
            n += np.bincount(of, minlength=len(texts))
        return total / np.maximum(n, 1)[:, None], n


def _fold(doc_id):
    """The remainder that decides the fold of a document."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def length_class(n):
    return np.searchsorted([32, 128, 512, 2048], n, "right")


def predicted(docs, model, text="text"):
    """``docs`` with lang_pred, score, cross_entropy (null for ``und``), size_class and lettered,
    under names that no column of ``docs`` has (returned second)."""
    shared = docs.sparkSession.sparkContext.broadcast(model) if model.langs else None
    langs = model.langs

    def compute():
        if not langs:
            def none(texts):
                lettered = [any(c.isalpha() for c in t or "") for t in texts]
                return [["und"] * len(texts), [0.0] * len(texts), [None] * len(texts),
                        [0] * len(texts), lettered]
            return none
        own = shared.value

        def run(texts):
            entropy, n = own.entropies(texts)
            lettered = n > 0
            lettered[n == 1] = [any(c.isalpha() for c in texts[k] or "")
                                for k in np.flatnonzero(n == 1)]
            best = entropy.argmin(1)
            least = entropy[np.arange(len(texts)), best]
            odds = 2.0 ** (-SHARP * np.minimum(entropy - least[:, None], 40 / SHARP))
            score = np.where(lettered, 1 / odds.sum(1), 0.0)
            return [[langs[b] if k else "und" for b, k in zip(best, lettered)], score.tolist(),
                    [float(h) if k else None for h, k in zip(least, lettered)],
                    length_class(n).tolist(), lettered.tolist()]
        return run

    names = fresh(docs, "lang_pred", "score", "cross_entropy", "size_class", "lettered")
    kinds = ("string", "double", "double", "int", "boolean")
    fields = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    return appended(docs, [text], fields, compute), names


def learn(docs):
    """The model of all training documents but the calibration fold, and the cutoffs of that fold:
    {(language, length class): cross-entropy}, at most languages x 5."""
    rows = docs.select("doc_id", "text", "lang").where("lang is not null").withColumn(
        "fold", _fold(F.col("doc_id"))).where("fold != 0").select("text", "lang", "fold")
    got = gram_counts(rows.where("fold != 1"), "lang").toPandas()
    counts = {}
    for lang, part in got.groupby("lang"):
        part = part.sort_values("gram")
        counts[lang] = part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
    model = Model(counts) if counts else _no_model()
    if not counts:
        return model, {}
    known, (pred, _, entropy, size, lettered) = predicted(rows.where("fold = 1"), model)
    cuts = known.where(lettered).groupBy(pred, size).agg(
        F.percentile_approx(entropy, 1 - ALPHA, 10_000).alias("cut")).collect()
    return model, {(r[pred], r[size]): r.cut + SLACK for r in cuts}


def _no_model():
    model = Model.__new__(Model)
    model.langs = []
    return model


def identify(docs):
    """``docs`` with the names (lang_pred, score, rejected), learned from its own training fold."""
    model, cuts = learn(docs)
    found, (pred, score, entropy, size, lettered) = predicted(docs, model)
    over = F.lit(False)
    for (lang, own), cut in sorted(cuts.items()):
        over = over | ((F.col(pred) == lang) & (F.col(size) == int(own)) & (F.col(entropy) > cut))
    (rejected,) = fresh(found, "rejected")
    found = found.withColumn(rejected, ~F.col(lettered) | F.coalesce(over, F.lit(False)))
    return found.drop(entropy, size, lettered), (pred, score, rejected)


def op3_language_id(spark, sf_dir):
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found, (pred, score, rejected) = identify(docs)
    return found.select(
        "doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), F.col(pred).alias("lang_pred"),
        F.col(score).alias("score"), F.col(rejected).alias("rejected"))
