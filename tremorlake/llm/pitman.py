"""LM scoring (11): a hierarchical Pitman-Yor model of words, sampled by Gibbs.

Every word is the context of the next (the end of a text is the context of the first word). Each
context is a restaurant, its dishes the words seen there; all share one parent, the restaurant of
single words, whose own base is uniform over the words seen and one for all others. A table of a
context is a customer of the parent. A sweep seats all customers of each restaurant anew, one after
another, given the tables of the rest as the sweep before left them; the probability of a token is
the predictive one, averaged over the sweeps after the first ``BURN``.

How it runs: texts are cut into blocks of about ``BLOCK_TOKENS`` tokens (packed arrays, one row
each). A block sends every distinct word and pair once, with its count, to a bucket of hashes; a
bucket holds all that is known of its words, as dishes (counts and tables of every pair that ends
in them) and as contexts. Pairs of a word that fills a bucket by itself go to the bucket of their
context instead. A sweep exchanges only sums: tables of a context go to its bucket and come back
added up. At the end buckets answer the blocks, which sum their documents. Pairs met once have one
table and need no seating. State is bucketed by its place once and does not move; every exchange is
written to the shared folder, so a lost executor repeats one step.

A word is known by a 64-bit hash of its bytes. Customers of a dish beyond 128 are seated in runs of
a sixty-fourth of those seated, with one probability a run. Only the choice of frequent words looks
at a bounded sample of documents; it places work and changes no result but the random draws.

Null text is empty: one token, the end. A null doc_id counts as empty text in the split: it is
learned from. Repeated rows count as often as they stand and have a row each. Very long texts span
blocks. An empty table gives no rows. Only doc_id and text are read.
"""

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..session import workspace
from .common import part_number, ready, slices, stored, table

FOLDS, HELD = 7, 2
BURN, SAMPLES = 1, 2
STRENGTH = 1.0  # of both levels
BLOCK_TOKENS, BUCKET_BYTES, PIECE = 2 << 20, 16 << 20, 1 << 20
FREQUENT_DOCS, FREQUENT_WORDS = 20_000, 4096  # bounds of what places hot words
END = np.uint64(0)
SEED = 42

BLOCK, STATE, LINK, PART, SELF, ANSWER, ASK = range(7)
ROWS = "at bigint, kind int, dest bigint, src bigint, body binary, sums array<double>"
_ARROW = pa.schema([("at", pa.int64()), ("kind", pa.int32()), ("dest", pa.int64()),
                    ("src", pa.int64()), ("body", pa.binary()), ("sums", pa.list_(pa.float64()))])
SCORES = ("row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
          "base_score double, score double")


def pack(*arrays):
    """Arrays as one compressed value: bytes of equal weight lie together."""
    import zstandard

    head, body = [], []
    for a in arrays:
        a = np.asarray(a)
        if a.dtype.kind in "iub" and a.dtype != np.uint64 and (not len(a) or a.min() >= 0):
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        head.append(f"{a.dtype.str}:{len(a)}")
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(
        ",".join(head).encode() + b"\n" + b"".join(body))


def unpack(value):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(value)
    at = raw.index(b"\n") + 1
    out = []
    for kind, n in (h.split(":") for h in raw[:at - 1].decode().split(",")):
        size, n = np.dtype(kind).itemsize, int(n)
        planes = np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.zeros(0, kind))
        at += size * n
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_powers = {}


def _power(n):
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        base = 0xD6E8FEB86659FD93
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(n + PIECE, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def word_hashes(line):
    """Hash and start of every word of a line that begins and ends with white space."""
    b = np.frombuffer(line, np.uint8)
    space = _SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(b))
    before = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)])
    h = (before[ends - 1] - before[starts - 1]) * down[starts]
    for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(32)
    h[h == END] = 1
    return h, starts


_BREAK = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(texts):
    """(text number, its bytes in lower case, whether they end the text), in bounded groups."""
    group, size = [], 0
    for k, text in enumerate(texts):
        data, at = (text or "").encode().lower(), 0
        while True:
            found = _BREAK.search(data, at + PIECE) if len(data) - at > PIECE else None
            stop = found.start() if found else len(data)
            group.append((k, data[at:stop], stop == len(data)))
            size += stop - at + 1
            if size >= PIECE:
                yield group
                group, size = [], 0
            at = stop
            if stop == len(data):
                break
    if group:
        yield group


def tokens_of(group):
    """Token hashes of the pieces, ends included, and how many each piece has."""
    line = b" " + b" ".join(p for _, p, _ in group) + b" "
    h, starts = word_hashes(line)
    lengths = np.array([len(p) + 1 for _, p, _ in group])
    last = np.array([e for *_, e in group])
    n = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]) + 1))
    out = np.full(len(h) + last.sum(), END)
    out[np.arange(len(h)) + np.repeat(np.cumsum(last) - last, n)] = h
    return out, n + last


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


def _home(words, buckets):
    """Bucket of each hash: a range of hashes, so sorted words lie in the order of their buckets."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pairs(words_of, first, home, hot):
    """Distinct (word, context) of a block's tokens in the order of their buckets, the buckets,
    and the place of each token's pair."""
    d = len(home)
    before = np.concatenate([[first], words_of[:-1]])
    keys, which = np.unique(words_of * d + before, return_inverse=True)
    word, context = keys // d, keys % d
    bucket = np.where(hot[word], home[context], home[word])
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return word[order], context[order], bucket[order], place[which]


def _cutter(buckets, hot_words):
    """Documents to blocks and what the blocks ask of each bucket."""
    hot_words = np.sort(np.array(hot_words, np.uint64))

    def flush(number, parts, docs, carry):
        w = np.concatenate(parts)
        ids, rows, sizes = (np.array(c, np.int64) for c in zip(*docs))
        null = ids == _NULL
        held = np.array([held_out(None if x else int(i)) for i, x in zip(ids, null)])
        words, at = np.unique(np.concatenate([w, [carry]]), return_inverse=True)
        tokens, first = at[:-1], at[-1]
        home, hot = _home(words, buckets), np.isin(words, hot_words)
        learned = np.repeat(~held, sizes).astype(np.float64)
        counts = np.bincount(tokens, learned, len(words)).astype(np.int64)
        word, context, bucket, place = _pairs(tokens, first, home, hot)
        seen = np.bincount(place, learned, len(word)).astype(np.int64)
        yield number, BLOCK, number, 0, pack(
            tokens, [first], np.bincount(home, minlength=buckets), np.flatnonzero(hot), ids, null,
            rows, sizes, held)
        of_word = np.searchsorted(home, np.arange(buckets + 1))
        of_pair = np.searchsorted(bucket, np.arange(buckets + 1))
        for a in range(buckets):
            own, pairs = slice(*of_word[a:a + 2]), slice(*of_pair[a:a + 2])
            if own.start == own.stop and pairs.start == pairs.stop:
                continue
            inside = home[word[pairs]] == a
            local = np.where(inside, word[pairs] - own.start, own.stop - own.start
                             + np.searchsorted(hot_words, words[word[pairs]]))
            contexts, of_context = np.unique(context[pairs], return_inverse=True)
            yield a, ASK, a, number, pack(words[own], counts[own], local, words[contexts],
                                          of_context, seen[pairs])

    def run(batches):
        base, row, number = part_number() << 33, 0, 0
        parts, docs, size, carry = [], [], 0, END

        def sent():
            return _table([(*r, None) for r in flush(
                buckets + base + number, parts, docs, carry)]).to_batches()

        for batch in slices(batches):
            ids, texts = (c.to_pylist() for c in batch.columns)
            for group in _pieces(texts):
                found, counts = tokens_of(group)
                parts.append(found)
                for (k, *_), n in zip(group, counts):
                    doc = base + row + k
                    if docs and docs[-1][1] == doc:
                        docs[-1][2] += n
                    else:
                        docs.append([_NULL if ids[k] is None else ids[k], doc, n])
                size += len(found)
                if size >= BLOCK_TOKENS:
                    yield from sent()
                    carry = parts[-1][-1]
                    parts, docs, size, number = [], [], 0, number + 1
            row += batch.num_rows
        if size:
            yield from sent()

    return run


_NULL = -2**63  # stands for a null id beside its mask


def _table(rows):
    columns = list(zip(*rows)) or [[]] * len(_ARROW)
    return pa.Table.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _read(rows, kind):
    """(src, arrays) of the rows of a kind, by src."""
    got = rows.filter(pc.equal(rows["kind"], kind)).sort_by("src")
    return [(s, unpack(b)) for s, b in zip(got["src"].to_pylist(), got["body"].to_pylist())]


def _sums(at, values, size):
    return np.bincount(at, values, size).astype(np.int64)


def _gatherer(buckets, hot_words):
    """All that blocks asked of a bucket to its state, and first sums to the contexts' buckets."""
    hot_words = np.sort(np.array(hot_words, np.uint64))

    def run(rows):
        if rows["kind"][0].as_py() == BLOCK:
            return rows
        a = rows["at"][0].as_py()
        asked = _read(rows, ASK)
        words = np.unique(np.concatenate([*[x[0] for _, x in asked], hot_words]))
        contexts = np.unique(np.concatenate([x[3] for _, x in asked]))
        counts, keys = np.zeros(len(words), np.int64), []
        for _, (own, n, local, of, at, _) in asked:
            counts += _sums(np.searchsorted(words, own), n, len(words))
            word = np.searchsorted(words, np.concatenate([own, hot_words]))[local]
            keys.append(word * len(contexts) + np.searchsorted(contexts, of)[at])
        dishes, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = _sums(which, np.concatenate([x[5] for _, x in asked]), len(dishes))
        word, context = dishes // len(contexts), dishes % len(contexts)
        once, more = total == 1, total > 1
        ones_word = _sums(word[once], None, len(words))
        ones_context = _sums(context[once], None, len(contexts))
        seated, of_seated = np.unique(context[more], return_inverse=True)
        number = np.cumsum(more) - 1
        out, at = [], 0
        for (block, x), k in zip(asked, keys):
            own, at = which[at:at + len(k)], at + len(k)
            out.append((a, LINK, a, block, pack(
                np.searchsorted(words, x[0]), total[own], number[own[more[own]]]), None))
        out.append((a, STATE, a, 0, pack(
            words, counts, ones_word, contexts[seated], of_seated, word[more], total[more]),
            [counts.sum(), (counts > 0).sum(), once.sum(), (total == 2).sum()]))
        tables = _sums(of_seated, None, len(seated))
        out += _parts(a, buckets, contexts, ones_context, seated, tables, words, ones_word
                      + _sums(word[more], None, len(words)), hot_words)
        return _table(out)

    return run


def _parts(a, buckets, contexts, ones, seated, tables, words, customers, hot_words):
    """Sums for the buckets of contexts (tables) and of hot words (customers)."""
    wants = np.zeros(len(contexts), np.int64)
    wants[seated] = tables
    home, hot = _home(contexts, buckets), _home(hot_words, buckets)
    held = customers[np.searchsorted(words, hot_words)]
    for b in range(buckets):
        own, own_hot = np.flatnonzero(home == b), (hot == b) & (a != b)
        if len(own) or own_hot.any():
            yield (a, PART, b, a, pack(contexts[own], ones[own], wants[own], hot_words[own_hot],
                                       held[own_hot]), None)


def tables(customers, weight, discount, draw):
    """Tables of dishes with that many customers: the next one opens a table with the odds
    ``weight`` to the customers seated less a discount for each table."""
    order = np.argsort(-customers, kind="stable")
    c, w = customers[order], np.broadcast_to(weight, customers.shape)[order]
    t, seated = np.minimum(c, 1).astype(np.float64), 1
    while len(c) and c[0] > seated:
        n = np.searchsorted(-c, -seated, side="left")  # dishes with customers left
        run = max(1, seated >> 6)
        new = w[:n] / (w[:n] + seated - discount * t[:n])
        t[:n] += draw.random(n) < new if run == 1 else draw.binomial(
            np.minimum(run, c[:n] - seated), new)
        seated += run
    out = np.empty_like(t)
    out[order] = t
    return out.astype(np.int64)


def _discount(once, twice):
    return once / (once + 2 * twice) if once and twice else 0.5


def _parent(customers, own_tables, g):
    """Probability of words in the parent restaurant."""
    rest = (STRENGTH + g["d0"] * g["T0"]) / (g["V"] + 1)
    return (customers - g["d0"] * own_tables + rest) / (STRENGTH + g["C0"])


def _adder(buckets, hot_words, g, sweep):
    """Step of the contexts: adds up tables, seats the parent, answers who asked."""
    hot_words = np.sort(np.array(hot_words, np.uint64))

    def run(state, inbox):
        a = state["at"][0].as_py()
        ((_, (words, _, ones_word, _, _, word, _)),) = _read(state, STATE)
        size = len(words)
        mine = _read(inbox, SELF)
        if mine:
            ones, customers, sat, *samples = mine[0][1]
        else:
            ones, sat, samples = np.zeros(size, np.int64), np.zeros(len(word), np.int64), []
            customers = ones_word + _sums(word, None, size)
        asked, total = _read(inbox, PART), np.zeros(size, np.int64)
        ones, customers = ones.astype(np.int64), customers.astype(np.int64)
        for src, (of, first, n, hot, held) in asked:
            at = np.searchsorted(words, of)
            ones += _sums(at, first, size)
            total += _sums(at, n, size)
            customers += _sums(np.searchsorted(words, hot), held, size)
        total += ones
        home = _home(words, buckets) == a
        customers[~home] = 0
        base = (STRENGTH + g["d0"] * g["T0"]) / (g["V"] + 1)
        own = tables(customers, base, g["d0"], np.random.default_rng([SEED, sweep, 0, a]))
        out = []
        for src, (of, _, n, hot, _) in asked:
            at, hot = np.searchsorted(words, of[n > 0]), np.searchsorted(words, hot)
            out.append((a, ANSWER, src, a, pack(total[at], customers[hot], own[hot]), None))
        if sweep > BURN:
            samples = [*samples, total, customers, own]
        out.append((a, SELF, a, a, pack(ones, customers, sat, own, *samples),
                    [customers.sum(), own.sum(), (customers == 1).sum(), (customers == 2).sum()]))
        return _table(out)

    return run


def _seater(buckets, hot_words, g, sweep):
    """Step of the dishes: seats the customers of every pair, sends the tables of its contexts."""
    hot_words = np.sort(np.array(hot_words, np.uint64))

    def run(state, inbox):
        a = state["at"][0].as_py()
        ((_, (words, _, ones_word, contexts, of, word, total)),) = _read(state, STATE)
        ((_, (ones, customers, sat, own, *samples)),) = _read(inbox, SELF)
        customers, own = customers.astype(np.int64), own.astype(np.int64)
        home, hot = _home(contexts, buckets), _home(hot_words, buckets)
        tabled = np.zeros(len(contexts), np.int64)
        for b, (t, c, o) in _read(inbox, ANSWER):
            tabled[home == b] = t
            at = np.searchsorted(words, hot_words[(hot == b) & (a != b)])
            customers[at], own[at] = c, o
        weight = (STRENGTH + g["d1"] * tabled[of]) * _parent(customers, own, g)[word]
        seats = tables(total.astype(np.int64), weight, g["d1"],
                       np.random.default_rng([SEED, sweep, 1, a]))
        now = ones_word + _sums(word, seats, len(words))
        if sweep > BURN:
            sat = sat + seats
        out = list(_parts(a, buckets, contexts, np.zeros(len(contexts), np.int64),
                          np.arange(len(contexts)), _sums(of, seats, len(contexts)), words, now,
                          hot_words))
        out.append((a, SELF, a, a, pack(ones, now, sat, *samples), None))
        return _table(out)

    return run


def _answerer():
    """What a bucket knows of the words and pairs of each block, to the block."""
    def run(state, inbox):
        a = state["at"][0].as_py()
        ((_, (_, counts, *_)),) = _read(state, STATE)
        ((_, (_, _, sat, _, *samples)),) = _read(inbox, SELF)
        return _table([
            (a, ANSWER, block, a, pack(counts[of], seen, sat[more], *[s[of] for s in samples]), None)
            for block, (of, seen, more) in _read(state, LINK)])

    return run


def _scorer(g, runs):
    """Scores of the documents of a block from the buckets' answers."""
    columns = [f.split() for f in SCORES.split(", ")]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in columns])

    def run(block, inbox):
        ((_, (tokens, first, homes, hot_at, ids, null, rows, sizes, held)),) = _read(block, BLOCK)
        answers = [x for _, x in _read(inbox, ANSWER)]
        counts, seen, more, *samples = (
            np.concatenate(c).astype(np.float64) for c in zip(*answers))
        home, hot = np.repeat(np.arange(len(homes)), homes), np.zeros(len(counts), bool)
        hot[hot_at] = True
        word, context, _, place = _pairs(tokens.astype(np.int64), int(first[0]), home, hot)
        n_tables = np.minimum(seen, 1)
        n_tables[seen > 1] = more / SAMPLES
        room = STRENGTH + counts[context]
        p = (seen - g["d1"] * n_tables) / room
        for k, (c0, t0) in enumerate(runs):
            total, customers, own = samples[3 * k:3 * k + 3]
            parent = _parent(customers, own, {**g, "C0": c0, "T0": t0})
            p += (STRENGTH + g["d1"] * total[context]) * parent[word] / room / SAMPLES
        of = np.repeat(np.arange(len(sizes)), sizes)
        plain = np.log10((counts + 1) / (g["N"] + g["V"] + 1))
        known = counts > 0

        def summed(values):
            return np.bincount(of, values, len(sizes))

        return pa.Table.from_arrays([
            pa.array(rows.astype(np.int64)), pa.array(ids.astype(np.int64), mask=null.astype(bool)),
            pa.array(held.astype(bool)), pa.array(sizes.astype(np.int64)),
            pa.array(summed(known[tokens]).astype(np.int64)), pa.array(summed(plain[tokens])),
            pa.array(summed(np.log10(p)[place]))], schema=schema)

    return run


def _frequent(docs, buckets):
    """Words so frequent in a bounded sample that one may fill a bucket: at most
    ``FREQUENT_WORDS``. They only decide where pairs are kept."""
    def run(batches):
        for batch in batches:
            for group in _pieces(batch.column(0).to_pylist()):
                words, n = np.unique(tokens_of(group)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)],
                                                 names=["word", "n"])

    sample = docs.select("text").sample(min(1.0, FREQUENT_DOCS / max(1, docs.count())), SEED)
    found = sample.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS + 1).collect()
    total = sum(r.n for r in found)
    return [r.word & (2**64 - 1) for r in found[:FREQUENT_WORDS]
            if r.n * 4 * buckets > total and r.n > 100]


def _added(rows, kind):
    """Sums over the buckets."""
    got = rows.where(F.col("kind") == kind).agg(
        *[F.sum(F.col("sums")[k]) for k in range(4)]).first()
    return [float(x or 0) for x in got]


def scores(docs):
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # By the size of the texts alone: buckets write to one another, so more of them cost rows.
    buckets = max(1, -(-size // BUCKET_BYTES))
    hot = _frequent(docs, buckets)
    asked = docs.mapInArrow(_cutter(buckets, hot), ROWS).repartition(buckets, "dest")
    name = f"tremorlake_llm_{uuid.uuid4().hex}"
    asked.groupBy("dest").applyInArrow(_gatherer(buckets, hot), ROWS).write.partitionBy("kind") \
        .bucketBy(buckets, "at").option("path", workspace(spark, "llm-pitman")).saveAsTable(name)
    try:
        return _scored(spark.table(name), buckets, hot)
    finally:
        spark.sql(f"DROP TABLE {name}")  # its files stay in the shared folder


def _scored(kept, buckets, hot):
    def step(kinds, inbox, function, schema=ROWS):
        left = kept.where(F.col("kind").isin(*kinds)).select(*_ARROW.names)
        return left.groupBy("at").cogroup(inbox.groupBy("dest")).applyInArrow(function, schema)

    n, v, once, twice = _added(kept, STATE)
    g = {"N": n, "V": v, "d1": _discount(once, twice), "d0": 0.5, "T0": v, "C0": n}
    runs, inbox = [], kept.where(F.col("kind") == PART).select(*_ARROW.names)
    for sweep in range(BURN + SAMPLES + 1):
        if sweep:
            inbox = stored(step([STATE], inbox, _seater(buckets, hot, g, sweep)), "seats")
        inbox = stored(step([STATE], inbox, _adder(buckets, hot, g, sweep)), "sums")
        g["C0"], g["T0"], once, twice = _added(inbox, SELF)
        g["d0"] = _discount(once, twice)
        if sweep > BURN:
            runs.append((g["C0"], g["T0"]))
    inbox = inbox.where(F.col("kind") == SELF)
    answers = step([STATE, LINK], inbox, _answerer())
    found = stored(step([BLOCK], answers, _scorer(g, runs), SCORES), "scores")
    # A very long document has a row for each block it spans.
    return found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        F.sum("base_score").alias("base_score"), F.sum("score").alias("score")).drop("row")


def op11_lm_scoring(spark, sf_dir):
    """Score of every document by the sampled model, next to the plain one of single words."""
    return scores(table(spark, sf_dir, "documents"))
