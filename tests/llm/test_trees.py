"""Merkle manifest, conversation trie and language-model scores against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from frames import cases, empty, frame, given
from pyspark.sql import functions as F

from check import compare, connect
from tremorlake.llm import manifest, oracles, pitman, prefixes
from tremorlake.llm.queries import QUERIES


def by_nulls(row):
    return tuple((x is not None, x) for x in row)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root, and for each leaf its slots and siblings up to it."""
    paths, own, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for path, o in zip(paths, own):
            run = level[o // 16 * 16:o // 16 * 16 + 16]
            path.append((o % 16, run[:o % 16] + run[o % 16 + 1:]))
        level = [sha("".join(level[a:a + 16])) for a in range(0, len(level), 16)]
        own = [o // 16 for o in own]
    return level[0], paths


def plain_manifest(rows):
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                           for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    sources = defaultdict(list)
    for r in rows:
        bent = r.text
        if r.doc_id is not None and bent and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            bent = re.sub("[A-Z]", lambda m: m[0].lower(), bent)
        sources[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text),
                                  leaf(r, bent), r.doc_id))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sources[s].sort() or sources[s]]) for s in names}
    root, above = plain_tree([trees[s][0] for s in names])
    for s, up in zip(names, above):
        for x, path in zip(sources[s], trees[s][1]):
            bent = x[3]
            for slot, sibs in path + up:
                bent = sha("".join(sibs[:slot] + [bent] + sibs[slot:]))
            proof = sha("".join(h for _, sibs in path + up for h in sibs))
            yield x[4], x[2], trees[s][0], root, proof, bent, bent == root


def manifest_of(monkeypatch, spark, docs):
    monkeypatch.setattr(manifest, "table", lambda *_: docs)
    return manifest.op13_merkle_manifest(spark, "")


def test_manifest(spark, monkeypatch):
    """Awkward rows, and a source of more than one block next to sources of one document."""
    many = spark.range(5000).select(
        (F.col("id") * 7 - 20).alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"),
        F.lit("en").alias("lang"),
        F.expr("case when id < 4400 then 'big' when id % 50 = 1 then concat('s', id) end").alias("source"),
        F.lit(1).cast("bigint").alias("n_chars")).repartition(5)
    for docs in (cases(spark), many):
        got = manifest_of(monkeypatch, spark, docs)
        assert sorted(map(tuple, got.collect()), key=by_nulls) == sorted(
            plain_manifest(docs.collect()), key=by_nulls)
    assert manifest_of(monkeypatch, spark, empty(spark)).isEmpty()


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            role, text = r.role or "", r.text or ""
            own[r.conv_id].append((r.turn is not None, r.turn or 0,
                                   sha(f"{len(role.encode())}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, held in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(held) - 1) * words
            leaves[p[:d]] += not children[p]
    for p, held in members.items():
        yield (min(held), len(p), min(members[p[:-1]]) if p else None, len(held), children[p],
               leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p])))))


def test_trie(spark, monkeypatch):
    """Shared heads, absent and short bases, null and repeated turns, equal and long conversations."""
    rows = [(c, t, r, x) for c in range(-45, 45) for t, r, x in [
        (0, "user", "hi"), (1, None, f"a{c % 3}"), (2, "b", None)][:abs(c) % 4]]
    rows += [(0, 0, "user", "hi"), (None, 1, "a", "b"), (7, None, "z", "first one"),
             (7, None, "y", "x y"), (60, 1, "q", ""), (81, 0, "s", "t"), (82, 0, "s", "t"),
             (2**61, 5, "a", "b\x1cc d"), (100, 3, "u", "w")]
    rows += [(c, k, "r", f"w{k % 7} z") for c, n in ((101, 90), (121, 70)) for k in range(n)]
    # Most conversations are one and the same.
    rows += [(1000 + c, k, "user", f"same {k}") for c in range(0, 200) for k in range(3)]
    made = spark.createDataFrame(rows, CONVERSATIONS).withColumn("depth", F.lit(1)).repartition(5)
    monkeypatch.setattr(prefixes, "table", lambda *_: made)
    got = prefixes.op12_conversation_trie(spark, "")
    assert sorted(map(tuple, got.collect()), key=by_nulls) == sorted(
        plain_trie(made.collect()), key=by_nulls)
    monkeypatch.setattr(prefixes, "table", lambda *_: made.limit(0))
    assert prefixes.op12_conversation_trie(spark, "").isEmpty()


def test_unequal_prefixes_are_counted_again(spark, monkeypatch):
    """With primes so small that fingerprints collide, verification sees it and tries others."""
    rows = spark.createDataFrame([(c, 0, "u", f"t{c}") for c in range(400)], CONVERSATIONS)
    monkeypatch.setattr(prefixes, "PRIMES", (3, 5, 7))
    monkeypatch.setattr(prefixes, "MOST_TRIES", 2)
    with pytest.raises(RuntimeError, match="share a fingerprint"):
        prefixes.trie(rows)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), oracles.ORACLES[name]) is None


def words_of(text):
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())] + [None]


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def plain_base(rows):
    counts = Counter(w for r in rows if not is_held(r.doc_id) for w in words_of(r.text))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = words_of(r.text)
        yield (r.doc_id, is_held(r.doc_id), len(own), sum(counts[w] > 0 for w in own), n,
               round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6))


def base_of(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                    round(r.base_score, 6)) for r in rows), key=by_nulls)


@pytest.mark.parametrize("small", [True, False])
def test_scores(spark, sf_dir, monkeypatch, small):
    """Counts and the plain score are exact, also in small blocks, pieces and buckets with frequent
    words kept by context; the model beats the plain score on held-out texts."""
    docs = cases(spark).select("doc_id", "text", F.lit(1).alias("row")).unionByName(
        given(spark, sf_dir, "documents").select("doc_id", "text", F.lit(2).alias("row")))
    if small:
        monkeypatch.setattr(pitman, "BLOCK_TOKENS", 3000)
        monkeypatch.setattr(pitman, "PIECE", 5000)
        monkeypatch.setattr(pitman, "BUCKET_BYTES", 100_000)
    rows = pitman.scores(docs).collect()
    assert base_of(rows) == sorted(plain_base(docs.collect()), key=by_nulls)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(
        r.n_tokens for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    if small:
        assert pitman.scores(empty(spark)).isEmpty()


class PlainSampler:
    """One customer at a time, for every restaurant: the tables of each dish."""

    def __init__(self, pairs, d1, d0, vocabulary, draw):
        self.seats, self.top = defaultdict(lambda: defaultdict(list)), defaultdict(list)
        self.d1, self.d0, self.v, self.draw = d1, d0, vocabulary, draw
        self.customers = pairs
        for u, w in pairs:
            self.sit(u, w)

    @staticmethod
    def _n(room):
        return sum(map(sum, room.values())), sum(map(len, room.values()))

    def parent(self, w):
        c, t = self._n(self.top)
        own = self.top.get(w, [])
        return (sum(own) - self.d0 * len(own) + (1 + self.d0 * t) / (self.v + 1)) / (1 + c)

    def p(self, u, w):
        c, t = self._n(self.seats[u])
        own = self.seats[u].get(w, [])
        return (sum(own) - self.d1 * len(own) + (1 + self.d1 * t) * self.parent(w)) / (1 + c)

    def _choose(self, tables, d, new):
        at = self.draw.choices(range(len(tables) + 1), [n - d for n in tables] + [new])[0]
        if at == len(tables):
            tables.append(0)
        tables[at] += 1
        return tables[at] == 1

    def sit(self, u, w):
        t = self._n(self.seats[u])[1]
        if self._choose(self.seats[u][w], self.d1, (1 + self.d1 * t) * self.parent(w)):
            t = self._n(self.top)[1]
            self._choose(self.top[w], self.d0, (1 + self.d0 * t) / (self.v + 1))

    def leave(self, u, w):
        if self._gone(self.seats[u][w]):
            self._gone(self.top[w])

    def _gone(self, tables):
        at = self.draw.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
            return True

    def sweep(self):
        for u, w in self.customers:
            self.leave(u, w)
            self.sit(u, w)


def test_scores_are_those_of_a_plain_sampler(spark, monkeypatch):
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(25)]
    follows = {w: draw.sample(vocabulary, 4) for w in vocabulary}

    def text():
        own = [draw.choice(vocabulary)]
        while len(own) < 12:
            own.append(draw.choice(follows[own[-1]]) if draw.random() < 0.8 else draw.choice(vocabulary))
        return " ".join(own)

    texts = [text() for _ in range(90)]
    monkeypatch.setattr(pitman, "SAMPLES", 12)
    monkeypatch.setattr(pitman, "BURN", 3)
    rows = pitman.scores(frame(spark, texts)).collect()
    pairs = [(u, w) for k, t in enumerate(texts) if not is_held(k)
             for u, w in zip([None, *words_of(t)], words_of(t))]
    n = Counter(Counter(pairs).values())
    d1 = n[1] / (n[1] + 2 * n[2])
    plain = PlainSampler(pairs, d1, 0.5, len({w for _, w in pairs}), draw)
    sums, sweeps = defaultdict(float), 12
    held = [k for k in range(len(texts)) if is_held(k)]
    wanted = {(u, w) for k in held for u, w in zip([None, *words_of(texts[k])], words_of(texts[k]))}
    for s in range(3 + sweeps):
        plain.sweep()
        if s >= 3:
            for pair in wanted:
                sums[pair] += plain.p(*pair) / sweeps
    got = {r.doc_id: r.score for r in rows}
    for k in held:
        own = words_of(texts[k])
        score = sum(math.log10(sums[pair]) for pair in zip([None, *own], own))
        assert got[k] == pytest.approx(score, abs=0.06 * len(own))
    assert sum(got[k] for k in held) == pytest.approx(sum(
        math.log10(sums[p]) for k in held
        for p in zip([None, *words_of(texts[k])], words_of(texts[k]))), rel=0.02)


def test_session_settings_are_left_alone(spark, sf_dir):
    """A query of this package changes no setting that the rest of the library depends on."""
    from tremorlake.session import settle

    settle(spark)
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    for name in ("op2_token_counts", "op12_conversation_trie"):
        QUERIES[name](spark, sf_dir).count()
    after = {r.key: r.value for r in spark.sql("SET").collect()}
    assert {k: v for k, v in after.items() if not k.startswith("spark.app.")} == {
        k: v for k, v in before.items() if not k.startswith("spark.app.")}
