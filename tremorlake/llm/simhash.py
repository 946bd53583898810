"""SimHash near-dedup (5): fingerprints linked by a generalised pigeonhole.

Equal fingerprints meet first; all later work is on distinct ones. Correlated bits are grouped into
partitions, and each partition i gets a threshold t_i (-1: not probed) with sum t_i = bits - m + 1,
so any two fingerprints within ``bits`` agree within t_i on some partition. A dynamic program picks
the thresholds with the least estimated probes and candidates, from the bit statistics of all
fingerprints. Every fingerprint probes its variants within t_i; candidates are verified.

A bucket in which very many fingerprints would meet lists no pairs: its members go by common
midpoints instead, which is exact: two fingerprints are within 2 bits if and only if they share one
within 1 bit of both (and so on for other limits), and a midpoint has few sharers.

``one_of_each`` links documents by the Jaccard similarity of their shingle sets, 0.8 or more. The
fingerprints of the sets propose first, by the links above; every proposal is decided on the sets.
Similar sets whose fingerprints lie further apart (3 to 14 bits at 0.8, where no pigeonhole is
selective) are found by shared prefixes, among sets of different classes only (``similar_pairs``).

Null or empty text: fingerprint zero, linked like any other. Repeated rows and ids are members of
their fingerprint. An empty table gives no rows. Only doc_id and text are read.
"""

from fractions import Fraction
from itertools import accumulate, combinations
from math import comb

import numpy as np
from pyspark.sql import functions as F

from .common import fresh, mapped, stored, table
from .components import components

WORDS, BITS, SEED = 3, 2, 42
FULL_BUCKET = 64  # members of a bucket that lists pairs; fuller ones go by midpoints
_ALL = (1 << 64) - 1


def fingerprint(text, words=WORDS):
    """64-bit SimHash of the word shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest

    own = (text or "").encode().lower().split()  # ASCII only, both
    if not own:
        return 0
    line = b" ".join(own)
    ends = list(accumulate((len(w) + 1 for w in own), initial=0))
    if len(own) <= words:
        hashes = [xxh64_intdigest(line, SEED)]
    else:
        hashes = [xxh64_intdigest(line[a:b - 1], SEED) for a, b in zip(ends, ends[words:])]
    return _majority(hashes)


def _majority(hashes):
    """The bits that are set in over half of the hashes."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at:at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * set_bits > len(hashes)).astype(np.uint64) << np.arange(
        64, dtype=np.uint64)).sum())


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs, words=WORDS, also=()):
    """doc_id, fp (the fingerprint as a signed long), and the columns ``also``."""
    def run(batches):
        for texts, *rest in batches:
            yield [*rest, [_signed(fingerprint(t, words)) for t in texts]]

    kinds = dict(docs.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *also))
    return mapped(docs.select("text", "doc_id", *also), f"{fields}, fp bigint", run)


def bit_statistics(prints):
    """How often bits i and j (i <= j) are both set, over all fingerprints: at most 2,080 sums."""
    def run(batches):
        total = np.zeros((64, 64), np.int64)
        n = 0
        for (fps,) in batches:
            bits = np.unpackbits(np.array(fps, "<i8").view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(fps)
        i, j = np.triu_indices(64)
        yield [[-1, *i.tolist()], [-1, *j.tolist()], [n, *total[i, j].tolist()]]

    rows = mapped(prints.select("fp"), "i int, j int, n bigint", run) \
        .groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((64, 64))
    n = 0
    for r in rows:
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def grouped_bits(n, both, parts):
    """Bits in ``parts`` groups of near equal size, correlated bits together (greedily)."""
    share = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    close = np.abs((both / max(1, n) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(close, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        own = [max(left, key=lambda b: (close[b, list(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: (close[b, own].sum(), -b)))
            left.discard(own[-1])
        out.append(sorted(own))
    return out


def thresholds(n, both, groups, bits):
    """The cheapest thresholds that sum to ``bits - len(groups) + 1``, and their cost."""
    share = np.diag(both) / max(1, n)
    differ = 2 * share * (1 - share)  # chance that two fingerprints differ in a bit
    need = bits - len(groups) + 1
    best = {0: (0.0, ())}
    for group in groups:
        within = np.zeros(len(group) + 1)  # distribution of the distance on the group
        within[0] = 1
        for b in group:
            within[1:] = within[1:] * (1 - differ[b]) + within[:-1] * differ[b]
            within[0] *= 1 - differ[b]
        reach = np.cumsum(within)
        new = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, bits + 1):
                probes = sum(comb(len(group), k) for k in range(t + 1))
                own = cost + (n * probes + n * n / 2 * reach[t] if t >= 0 else 0)
                if total + t not in new or own < new[total + t][0]:
                    new[total + t] = own, (*chosen, t)
        best = new
    return best[need]


def partitions(n, both, bits=BITS):
    """(mask, threshold) of each probed partition, by the least estimated cost over 1 to bits + 1
    partitions."""
    options = []
    for parts in range(1, bits + 2):
        groups = grouped_bits(n, both, parts)
        cost, chosen = thresholds(n, both, groups, bits)
        options.append((cost, [(sum(1 << b for b in g), t) for g, t in zip(groups, chosen)
                               if t >= 0]))
    return min(options, key=lambda o: (o[0], len(o[1])))[1]


def _variants(mask, flips):
    """All changes of at most ``flips`` bits of the mask, none first."""
    places = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(places, k)]


def links(prints, plan, bits=BITS, full=FULL_BUCKET):
    """(a, b) pairs that connect all distinct fingerprints within ``bits`` of one another.

    Every pair within ``bits`` is joined by a path of links, and every link has a path of such
    pairs; pairs of full buckets are not listed one by one.
    """
    changes = [[_signed(v) for v in _variants(mask, t)] for mask, t in plan]
    masks = [_signed(mask) for mask, _ in plan]

    def probe(batches):
        for (fps,) in batches:
            fps = np.array(fps, np.int64)
            for part, (mask, change) in enumerate(zip(masks, changes)):
                keys = ((fps & mask)[:, None] ^ np.array(change, np.int64)[None, :])
                yield [np.full(keys.size, part), keys.ravel(), np.repeat(fps, len(change)),
                       np.tile(np.arange(len(change)) == 0, len(fps))]

    probes = stored(mapped(prints.select("fp"), "part int, key bigint, fp bigint, own boolean",
                           probe), "probes")
    met = probes.groupBy("part", "key").agg(
        F.count("*").alias("n"), F.count_if("own").alias("owners"))
    met = stored(met.where("owners > 0 and n > 1"), "met")
    listed = probes.join(met.where(f"n <= {full}").select("part", "key"), ["part", "key"])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    pairs = listed.where("own").select("part", "key", F.col("fp").alias("a")).join(
        listed.select("part", "key", F.col("fp").alias("b")), ["part", "key"]) \
        .where((F.col("a") != F.col("b")) & near).select("a", "b")
    crowded = probes.join(met.where(f"n > {full}").select("part", "key"), ["part", "key"],
                          "left_semi").select("fp").distinct()
    return pairs.unionByName(_by_midpoints(crowded, bits))


def _by_midpoints(prints, bits):
    """Links through what lies within half the limit of both ends."""
    half = -(-bits // 2)
    near = np.array([_signed(v) for v in _variants(_ALL, half)], np.int64)

    def run(batches):
        for (fps,) in batches:
            fps = np.array(fps, np.int64)
            for at in range(0, len(fps), 1024):
                own = fps[at:at + 1024]
                keys = own[:, None] ^ near[None, :]
                yield [keys.ravel(), np.repeat(own, len(near))]

    spread = mapped(prints, "key bigint, fp bigint", run)
    if bits % 2:  # an odd limit: the shared key may lie between ends that are one too far apart
        raise ValueError("an even number of bits is needed")
    least = spread.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z"),
                                      F.count("*").alias("n")).where("n > 1")
    two = least.where("n = 2").select("a", F.col("z").alias("b"))
    # At most one member for each of the variants of the key.
    more = spread.join(least.where("n > 2").select("key", "a"), "key").where("fp != a") \
        .select("a", F.col("fp").alias("b"))
    return two.unionByName(more)


def near_duplicates(docs, words=WORDS, bits=BITS, also=()):
    """doc_id, fp, component_id (the smallest doc_id reachable), the columns ``also``."""
    prints = stored(fingerprints(docs, words, also), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    n, both = bit_statistics(distinct)
    linked = components(links(distinct, partitions(n, both, bits), bits))
    linked = linked.select(F.col("node").alias("fp"), "root")
    least = linked.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    classes = distinct.join(linked, "fp", "left").join(least, "root", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id"),
        F.coalesce("root", "fp").alias("class"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "class", *also)


def op5_simhash_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


# Similarity of shingle sets, decided exactly, for limits that 64 bits cannot tell.
WIDE_WORDS, SIMILARITY = 5, 0.8
MAP_BITS = 1024  # of the parity map of a set, at least; four bits a shingle
SAMPLE, SEEN, COMMON = 20_000, 3, 1 << 17  # these only order shingles: any order is exact
CROWD = 4  # pairs for each member that a bucket lists without joining its crowd first
ROUNDS = 12


def shingles(text, words=WIDE_WORDS):
    """The set of word shingles of a text as sorted 64-bit hashes."""
    from xxhash import xxh64_intdigest

    own = (text or "").encode().lower().split()
    line = b" ".join(own)
    ends = list(accumulate((len(w) + 1 for w in own), initial=0))
    if len(own) <= words:
        hashes = {xxh64_intdigest(line, SEED)} if own else set()
    else:
        hashes = {xxh64_intdigest(line[a:b - 1], SEED) for a, b in zip(ends, ends[words:])}
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)))


def _parity(hashes):
    """Whether an odd number of shingles fell on each bit: two sets differ in at least as many
    shingles as their maps in bits. The map grows with the set, so it stays telling."""
    width = max(MAP_BITS.bit_length() - 1, (4 * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _apart(x, y):
    """Bits in which two maps differ. The longer is folded first: its neighbours share a bit of the
    shorter, so their parities add up."""
    x, y = sorted((np.frombuffer(m, np.uint8) for m in (x, y)), key=len)
    if len(y) > len(x):
        fold = len(y) // len(x)
        bits = np.unpackbits(y).reshape(-1, fold)
        y = np.packbits(np.bitwise_xor.reduce(bits, axis=1))
    return int(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(dtype=np.int64))


def _common(docs, words):
    """Shingles that a bounded sample of documents shares, the rarest first."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    def run(batches):
        for (texts,) in batches:
            yield [np.concatenate([shingles(t, words) for t in texts]).view(np.int64)]

    counted = mapped(docs.sample(share, SEED).select("text"), "hash bigint", run) \
        .groupBy("hash").agg(F.count("*").alias("n")).where(f"n >= {SEEN}")
    rows = stored(counted, "common").orderBy(F.desc("n"), "hash").limit(COMMON).collect()
    return np.array([r.hash for r in rows][::-1], np.int64).view(np.uint64)


def _prefix(hashes, common, rank, limit):
    """The shingles of which similar sets share one: the first in the order of all shingles, those
    that are not common by hash, then the common ones."""
    n = len(hashes)
    if not n:
        return hashes
    count = n - -(-limit.numerator * n // limit.denominator) + 1
    if not len(common):
        return hashes[:count]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    place = np.where(common[at] == hashes, rank[at], -1)
    return hashes[np.lexsort((hashes, place))[:count]]


def fingerprint_pairs(distinct, bits=BITS):
    """(a, b) nodes that connect all whose fingerprints are within ``bits``: those of a fingerprint
    with their least, and the least of linked fingerprints. ``distinct``: node, fp."""
    prints = stored(distinct.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    n, both = bit_statistics(prints)
    linked = links(prints, partitions(n, both, bits), bits)
    first, second = (prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
                     for c in "ab")
    near = linked.distinct().join(first, "a").join(second, "b").select(
        F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))
    same = distinct.select("node", "fp").join(prints, "fp").where("node != first").select(
        F.col("first").alias("a"), F.col("node").alias("b"))
    return near.unionByName(same)


def similar_pairs(distinct, sets, similarity=SIMILARITY):
    """(a, b) links that connect all nodes whose shingle sets have that Jaccard similarity.

    ``distinct``: node, n (shingles), fp, map, first (the prefix of the set). ``sets(nodes)``: node
    and shingles of those nodes. Near fingerprints are decided first. Of two similar sets, the
    prefix of the larger and the shorter indexed prefix of the smaller share a shingle for certain,
    so buckets by shingle miss no pair. Members of a bucket that are connected already need no
    comparing: in a bucket crowded by several classes all members are held against one of them,
    another each round; then all pairs of different classes are listed that position, size and map
    do not rule out. Every link is decided on the sets.
    """
    limit = Fraction(similarity).limit_denominator(1000)
    top, both = limit.numerator, limit.numerator + limit.denominator

    maps = distinct.select("node", "n", "map")

    def side(table, name):
        return table.select(*[F.col(c).alias(name if c == "node" else f"{name}_{c}")
                              for c in table.columns])

    def may(batches):
        for a, b, n, m, x, y in batches:
            apart = np.fromiter(map(_apart, x, y), np.int64, len(a))
            # |x| + |y| less the differing ones is twice the overlap at most.
            size = np.array(n, np.int64) + np.array(m, np.int64)
            near = np.flatnonzero(both * (size - apart) >= 2 * top * size)
            yield [[a[k] for k in near], [b[k] for k in near]]

    def decide(batches):
        for a, b, x, y in batches:
            near = []
            for k, (u, v) in enumerate(zip(x, y)):
                u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                overlap = len(u) + len(v) - len(np.union1d(u, v))
                if both * overlap >= top * (len(u) + len(v)):
                    near.append(k)
            yield [[a[k] for k in near], [b[k] for k in near]]

    def verified(pairs):
        listed = pairs.distinct().join(side(maps, "a"), "a").join(side(maps, "b"), "b")
        chosen = stored(mapped(listed.select("a", "b", "a_n", "b_n", "a_map", "b_map"),
                               "a bigint, b bigint", may), "chosen")
        nodes = chosen.select(F.col("a").alias("node")).unionByName(
            chosen.select(F.col("b").alias("node"))).distinct()
        own = stored(sets(nodes), "sets")
        held = chosen.join(side(own, "a"), "a").join(side(own, "b"), "b")
        return stored(mapped(held.select("a", "b", "a_shingles", "b_shingles"),
                             "a bigint, b bigint", decide), "similar")

    def classes(found):
        return stored(components(found).select("node", F.col("root").alias("class")), "classes")

    def probe(batches):
        for nodes, own, ns, firsts in batches:
            sizes = [len(f) // 8 for f in firsts]
            keys = np.frombuffer(b"".join(firsts), np.int64)
            n = np.repeat(np.array(ns, np.int64), sizes)
            at = np.concatenate([np.arange(s) for s in sizes])
            yield [keys, np.repeat(np.array(nodes, np.int64), sizes),
                   np.repeat(np.array(own, np.int64), sizes), n, at,
                   at <= n - -(-2 * top * n // both)]

    def classed(rows, linked):
        return rows.join(linked, "node", "left").withColumn("class", F.coalesce("class", "node"))

    found, before = verified(fingerprint_pairs(distinct.where("n > 0"))), None
    probes = mapped(
        classed(distinct.select("node", "n", "first"), classes(found)).select(
            "node", "class", "n", "first"),
        "key bigint, node bigint, class bigint, n bigint, at bigint, indexed boolean", probe)
    met = probes.groupBy("key").agg(F.count_if("indexed").alias("own"), F.min("class").alias("c"),
                                    F.max("class").alias("d")) \
        .where("own > 0 and c < d").select("key")
    shared = stored(probes.join(stored(met, "met"), "key", "left_semi"), "shared")

    def opened(rows, turn):
        """Crowded buckets: pairs across classes, and one member (``a``) and its class."""
        # Two steps, both summed ahead of the exchange.
        chance = F.when(F.col("indexed"), F.xxhash64("node", F.lit(turn)))
        count = rows.groupBy("key", "class").agg(
            F.count("*").alias("p"), F.count_if("indexed").alias("i"),
            F.min(chance).alias("c"), F.min_by("node", chance).alias("a"))
        state = count.groupBy("key").agg(
            F.sum("p").alias("members"), F.min_by("a", "c").alias("a"),
            F.min_by("class", "c").alias("own"),
            (F.sum("p") * F.sum("i") - F.sum(F.col("p") * F.col("i"))).alias("across"))
        return stored(state.where(f"across > {CROWD} * members").withColumn(
            "across", F.col("across").cast("double")), "open")

    # Buckets that are not crowded list their pairs; the crowded ones are joined first.
    state = opened(shared, 0)
    live = stored(shared.join(state.select("key"), "key", "left_semi"), "live")
    easy = shared.join(state.select("key"), "key", "left_anti")
    linked = None
    for turn in range(1, ROUNDS + 1):
        across, = state.agg(F.sum("across")).first()
        if not across or before is not None and across > 0.9 * before:
            break
        before = across
        new = verified(live.join(state, "key").where("class != own").select(
            F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")))
        found = found.unionByName(new)
        linked = classes(found)
        live = stored(classed(live.drop("class"), linked), "live")
        state = opened(live, turn)
    live = easy.unionByName(live.select(easy.columns))
    left, right = (rows.select("key", *[F.col(c).alias(name if c == "node" else f"{name}_{c}")
                                        for c in ("node", "n", "at", "class")])
                   for rows, name in ((live.where("indexed"), "a"), (live, "b")))
    # The first shingle two similar sets share passes; a smaller set is indexed for a larger one.
    near = F.expr(f"{both} * least(a_n - a_at, b_n - b_at) >= {top} * (a_n + b_n)")
    pairs = left.join(right, "key").where(
        F.expr("a_class != b_class and a_n <= b_n") & near) \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if linked is not None:  # what the crowds have joined needs no comparing in other buckets
        for c in "ab":
            own = linked.select(F.col("node").alias(c), F.col("class").alias(f"{c}_class"))
            pairs = pairs.join(own, c, "left")
        pairs = pairs.where("coalesce(a_class, a) != coalesce(b_class, b)").select("a", "b")
    return found.unionByName(verified(pairs))


def one_of_each(docs, words=WIDE_WORDS, similarity=SIMILARITY):
    """``docs`` without all but one document of each class of similar documents: the smallest
    doc_id stays, then the first row (null ids last)."""
    (row,) = fresh(docs, "row")
    # Written once: numbers made again might be others.
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    limit = Fraction(similarity).limit_denominator(1000)
    common = _common(numbered, words)
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order))

    def run(batches):
        from xxhash import xxh3_128_digest

        sorted_common, rank = shared.value
        for texts, ids, rows in batches:
            own = [shingles(t, words) for t in texts]
            yield [ids, rows, [xxh3_128_digest(s.tobytes()) for s in own], [len(s) for s in own],
                   [_signed(_majority(s)) for s in own], [_parity(s) for s in own],
                   [_prefix(s, sorted_common, rank, limit).tobytes() for s in own]]

    prints = mapped(numbered.select("text", "doc_id", row),
                    "doc_id bigint, row bigint, same binary, n bigint, fp bigint, map binary, "
                    "first binary", run)
    # Equal sets meet in the map-side aggregate, however many there are.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    distinct = stored(prints.groupBy("same").agg(
        least.alias("least"), F.min("row").alias("node"), F.first("n").alias("n"),
        F.first("fp").alias("fp"), F.first("map").alias("map"),
        F.first("first").alias("first")), "wide")

    def sets(nodes):
        def run(batches):
            for rows, texts in batches:
                yield [rows, [shingles(t, words).tobytes() for t in texts]]

        texts = numbered.select(F.col(row).alias("node"), "text").join(nodes, "node", "left_semi")
        return mapped(texts, "node bigint, shingles binary", run)

    linked = components(similar_pairs(distinct, sets, similarity))
    # Of a linked class the least survives; an unlinked set is its own class.
    classes = distinct.select("node", "least").join(linked, "node", "left")
    kept = classes.groupBy(F.coalesce("root", "node").alias("class")).agg(
        F.min("least").alias("least")).select(F.col("least.row").alias(row))
    # A bit for each row that stays, 64 to a word: so few bytes that the texts can stay in place.
    block, word = fresh(numbered, "block", "word")
    bit, of = F.expr(f"shiftleft(1L, cast(`{row}` % 64 as int))"), F.expr(f"`{row}` div 64")
    words = stored(kept.groupBy(of.alias(block)).agg(F.bit_or(bit).alias(word)), "kept")
    return numbered.withColumn(block, of).join(words, block) \
        .where(F.col(word).bitwiseAND(bit) != 0).select(*docs.columns)
