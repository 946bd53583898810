"""Best-fit packing (1): a configuration linear program over the length histogram.

Documents are encoded, cut into pieces of at most ``capacity`` tokens, and counted by length: at
most ``capacity`` numbers, whatever the corpus. On those the driver solves the covering program
"cover every length as often as it occurs by configurations that fit a sequence" by multiplicative
weights; the pricing step is a knapsack dynamic program whose one table prices the best
configuration around every length. Every round's prices give a lower bound of the program; those
of the best bound price the rounding: optimal configurations of the fractional solution are taken
down to whole times, then what is left is priced again and again, and each length, longest first,
gets the configuration that is worth most around it. Best fit only places what no configuration of
nearly the best worth holds. The plan says how many sequences take each configuration; pieces find
their place by their rank among equal lengths, which per-task counts and their prefix sums give
without a global sort.

Null or empty text: one piece, the end id. Repeated rows and ids are packed as often as they stand.
An empty table gives no rows. Extra columns are not read.
"""

from collections import defaultdict
from typing import NamedTuple

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import mapped, part_number, stored, table
from .tokens import crc, encoder

TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 1, 4096
ROUNDS, SEEDS, RATE, NEAR = 40, 96, 0.05, 0.05
GAP = 0.03  # share of the tokens that the fractional solution may leave uncovered
SLACKS = 1e-9, 0.0005, 0.002, 0.01  # how far below the best worth a configuration may be, in turn
STALL = 0.05  # share of the remaining sequences that a sweep has to place to be repeated


class Plan(NamedTuple):
    sequences: dict  # configuration -> how many sequences take it
    bound: float  # no packing has fewer sequences
    best_fit: int  # sequences that best fit placed


def pieces(docs, tokenizer=TOKENIZER, end_id=END_ID, capacity=CAPACITY, cached=None):
    """One row per piece: doc_id, piece, start, length, ids_crc32, and its place among the equal
    lengths of its task (``part``, ``nth``). ``cached``: chunks that a worker's encoder knows."""
    def cut(batches):
        nth, part = defaultdict(int), part_number()
        for ids, texts in batches:
            rows = []
            for doc, data in zip(ids, encoder(tokenizer, end_id, cached).encode(texts)):
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at:at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, k, k * capacity, n, crc(own), part, nth[n]))
                    nth[n] += 1
            yield list(map(list, zip(*rows)))

    return mapped(
        docs.select("doc_id", "text"),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, "
        "nth bigint", cut)


def _priced(values, lengths, capacity):
    """Knapsack over sizes 0..capacity with any number of copies: best value, last length taken."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for size in range(1, capacity + 1):
        best[size], last[size] = best[size - 1], 0
        if k := fits[size]:
            gain = best[size - lengths[:k]] + values[:k]
            j = gain.argmax()
            if gain[j] > best[size]:
                best[size], last[size] = gain[j], lengths[j]
    return best, last


def _around(seed, last, capacity):
    """The best configuration that holds ``seed``: lengths, longest first."""
    taken, room = [seed], capacity - seed
    while room > 0:
        if last[room]:
            taken.append(int(last[room]))
            room -= int(last[room])
        else:
            room -= 1
    return tuple(sorted(taken, reverse=True))


def _fractional(left, capacity, rounds, seeds, rate):
    """Multiplicative weights: how often to use which configuration, prices under which no
    configuration is worth more than 1, and what the pieces are worth at these prices."""
    lengths = np.flatnonzero(left)
    n = left[lengths].astype(float)
    place = {int(v): k for k, v in enumerate(lengths)}
    weight, used = np.ones(len(lengths)), defaultdict(float)
    mass, total, bound, chosen = np.cumsum(n * lengths), np.zeros(len(lengths)), 0.0, None
    for step in range(1, rounds + 1):
        price = weight * lengths
        best, last = _priced(price, lengths, capacity)
        worth = (n * price).sum() / best[capacity]
        if worth > bound * (1 + 1e-9):
            bound, chosen = worth, np.zeros(capacity + 1)
            chosen[lengths] = price / best[capacity]
        # Seeds spread over the mass of the histogram, each round at other points.
        at = (np.arange(seeds) + (step * 0.618034) % 1) * mass[-1] / seeds
        drawn, shares = np.unique(np.searchsorted(mass, at), return_counts=True)
        near = best[capacity - lengths[drawn]] + price[drawn] >= (1 - NEAR) * best[capacity]
        drawn, shares = drawn[near], shares[near] * seeds / max(1, shares[near].sum())
        covered = np.zeros(len(lengths))
        for seed, share in zip(drawn, shares):
            config = _around(int(lengths[seed]), last, capacity)
            own, copies = np.unique([place[v] for v in config], return_counts=True)
            times = share * mass[-1] / seeds / sum(config)
            used[config] += times
            covered[own] += times * copies
        total += covered
        if (np.maximum(0, n - total / step) * lengths).sum() < GAP * mass[-1]:
            break
        weight *= np.exp(np.clip(rate * (1 - covered / n), -1, 1))
        weight /= np.average(weight, weights=n * lengths)
    return {config: times / step for config, times in used.items()}, chosen, bound


def _commit(config, times, left, plan):
    """Use a configuration as often as wanted and as what is left allows."""
    own, copies = np.unique(config, return_counts=True)
    times = int(min(times, (left[own] // copies).min()))
    if times > 0:
        left[own] -= times * copies
        plan[config] += times


def _worth_most(seed, left, price, best, capacity):
    """The configuration worth most around ``seed`` among the pieces left; of equals, the one with
    the longer lengths. Its worth counts what is left only."""
    lengths, left = np.flatnonzero(left), left.copy()
    config, room, worth = [seed], capacity - seed, price[seed]
    left[seed] -= 1
    while room:
        fitting = lengths[:np.searchsorted(lengths, room, "right")]
        fitting = fitting[left[fitting] > 0]
        if not len(fitting):
            break
        gain = price[fitting] + best[room - fitting]
        taken = int(fitting[np.flatnonzero(gain >= gain.max() * (1 - 1e-9))[-1]])
        left[taken] -= 1
        config.append(taken)
        room -= taken
        worth += price[taken]
    return tuple(sorted(config, reverse=True)), worth


def _sweep(left, price, slack, capacity, plan):
    """Every length, longest first, while its best configuration is worth ``1 - slack`` or more."""
    lengths, before = np.flatnonzero(left), sum(plan.values())
    best, _ = _priced(price[lengths], lengths, capacity)
    for seed in map(int, lengths[::-1]):
        while left[seed]:
            config, worth = _worth_most(seed, left, price, best, capacity)
            if worth < 1 - slack:
                break
            _commit(config, left[seed], left, plan)
    return sum(plan.values()) - before


def _best_fit(left, capacity, plan):
    """Largest first into the fullest sequence that has room, equal sequences at once."""
    open_at = defaultdict(lambda: defaultdict(int))  # room -> configuration -> how many
    rooms = np.zeros(capacity + 1, np.int64)
    for length in np.flatnonzero(left)[::-1]:
        length, n = int(length), int(left[length])
        while n:
            found = np.flatnonzero(rooms[length:])
            if not len(found):
                fit = capacity // length
                for copies, times in ((fit, n // fit), (n % fit, 1)):
                    if copies and times:
                        room = capacity - copies * length
                        open_at[room][(length,) * copies] += times
                        rooms[room] += times
                n = 0
                break
            room = length + int(found[0])
            config, many = next(iter(open_at[room].items()))
            fit = room // length
            copies = min(fit, n)
            times = min(many, n // copies)
            open_at[room][config] -= times
            if not open_at[room][config]:
                del open_at[room][config]
            rooms[room] -= times
            new = room - copies * length
            open_at[new][config + (length,) * copies] += times
            rooms[new] += times
            n -= times * copies
    for configs in open_at.values():
        for config, times in configs.items():
            plan[config] += times


def _sequences(left, capacity):
    return float((left * np.arange(capacity + 1)).sum()) / capacity


def plan_sequences(histogram, capacity=CAPACITY, rounds=ROUNDS, seeds=SEEDS, rate=RATE):
    """A ``Plan`` that covers each length of ``{length: pieces}`` exactly.

    The program is solved again for what is left until a solution places less than half of it. No
    plan has more sequences than best fit alone: should rounding ever lose to it, best fit's is it.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    whole, plan, bound, full = left.copy(), defaultdict(int), 0.0, int(left[capacity])
    if full:
        plan[(capacity,)], left[capacity] = full, 0
    if left.any():  # no sequence holds more pieces than fit of the shortest
        bound = left.sum() / (capacity // np.flatnonzero(left)[0])
    while left.any():
        before, size = sum(plan.values()), _sequences(left, capacity)
        used, price, worth = _fractional(left, capacity, rounds, seeds, rate)
        if before == full:
            bound = max(bound, worth)
        for config, times in sorted(used.items(), key=lambda x: (-x[1], x[0])):
            if price[list(config)].sum() >= 1 - SLACKS[1]:
                _commit(config, int(times), left, plan)
        for slack in SLACKS:
            while left.any():
                rest = _sequences(left, capacity)
                if _sweep(left, price, slack, capacity, plan) < STALL * rest:
                    break
        if sum(plan.values()) - before < size / 2:
            break
    by_program = sum(plan.values())
    _best_fit(left, capacity, plan)
    best_fit, alone = sum(plan.values()) - by_program, defaultdict(int)
    _best_fit(whole, capacity, alone)
    if sum(alone.values()) < sum(plan.values()):
        plan, best_fit = alone, sum(alone.values())
    return Plan(dict(plan), full + bound, best_fit)


def _slots(plan):
    """Where the pieces of each length go: sorted keys (length, first rank), first sequence,
    copies in a sequence, offset of the first copy."""
    rows, rank, base = [], defaultdict(int), 0
    for config, times in sorted(plan.items()):
        offset = 0
        for length in sorted(set(config), reverse=True):
            copies = config.count(length)
            rows.append((length << 40 | rank[length], base, copies, offset))
            rank[length] += copies * times
            offset += copies * length
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def place(cut, plan):
    """Pieces with ``sequence_id`` and ``offset``; ``cut`` is stored, so both reads see one result."""
    by_length = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    # At most one row per task and length.
    before = cut.groupBy("part", "length").agg(F.count("*").alias("n")).select(
        "part", "length", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("before") + F.col("nth")).alias("rank"))
    slots = _slots(plan)  # bounded by the rounds' seeds and the capacity, not by the corpus

    def assign(batches):
        for doc, piece, start, length, crc32, rank in batches:
            n, r = np.array(length, np.int64), np.array(rank, np.int64)
            k = np.searchsorted(slots[:, 0], n << 40 | r, "right") - 1
            key, base, copies, offset = slots[k].T
            r = r - (key & ((1 << 40) - 1))
            yield (doc, piece, start, length, crc32, base + r // copies,
                   offset + r % copies * n)

    return mapped(
        ranked, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint", assign)


def pack(docs, tokenizer=TOKENIZER, end_id=END_ID, capacity=CAPACITY, cached=None):
    """All documents in sequences of at most ``capacity`` tokens; one row per piece."""
    cut = stored(pieces(docs, tokenizer, end_id, capacity, cached), "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    return place(cut, plan_sequences(histogram, capacity).sequences)


def op1_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
