"""Near duplicates, search, shards and the pipeline."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from frames import CASES, cases, empty, frame, given
from pyspark.sql import functions as F

import corpus_pipeline
from tremorlake.llm import components, search, sharding, simhash


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or (
        [b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def pairs_within(fps, bits):
    return [(a, b) for k, a in enumerate(fps) for b in fps[k + 1:]
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits]


def test_fingerprints_and_components(spark, sf_dir):
    docs = cases(spark).select("doc_id", "text").unionByName(
        given(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = docs.collect()
    got = defaultdict(set)
    for r in simhash.near_duplicates(docs).collect():
        got[r.fp & (2**64 - 1)].add(r.component_id)
    own = defaultdict(list)
    for r in rows:
        own[plain_fingerprint(r.text)].append(r.doc_id)
    assert set(got) == set(own)
    fps = sorted(own)
    root, least = roots(fps, pairs_within(fps, 2)), defaultdict(list)
    for fp in fps:
        least[root[fp]] += [d for d in own[fp] if d is not None]
    assert got == {fp: {min(least[root[fp]], default=None)} for fp in fps}


@pytest.mark.parametrize("full", [1, 4, 64])
def test_links_connect_what_is_near(spark, full):
    """Clusters of fingerprints that differ in a few bits, so buckets of every size."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice((1, 3, 40))):
            fps.add(simhash._signed(centre ^ sum(1 << rng.randrange(64) for _ in range(
                rng.randrange(4)))))
    fps = sorted(fps)
    prints = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    n, both = simhash.bit_statistics(prints)
    assert n == len(fps)
    for plan in (simhash.partitions(n, both), simhash.partitions(10**9, both * 10**9 / n)):
        linked = components.components(simhash.links(prints, plan, full=full))
        got = {r.node: r.root for r in linked.collect()}
        want = roots(fps, pairs_within(fps, 2))
        assert {f: got.get(f, f) for f in fps} == want


def test_thresholds_meet_the_pigeonhole():
    rng = np.random.default_rng(0)
    bits = rng.random((500, 64)) < np.linspace(0.1, 0.9, 64)
    both = bits.T.astype(float) @ bits
    for parts in (1, 2, 3):
        groups = simhash.grouped_bits(500, both, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, chosen = simhash.thresholds(500, both, groups, 2)
        assert sum(chosen) == 2 - parts + 1


@pytest.mark.parametrize("links", [
    [], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)],
    [(k, (k * 7) % 50) for k in range(50)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(df).collect()}
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    assert got == roots(nodes, [x for x in links if x[0] != x[1]])


def near_copy(words, rng, changes):
    words = list(words)
    for k in rng.sample(range(len(words)), changes):
        words[k] = f"new{rng.random()}"
    return " ".join(words)


def test_one_of_each_stays(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(30)]
    texts = [" ".join(w) for w in base] + [near_copy(w, rng, 2) for w in base] + [
        " ".join(w) for w in base[:10]] + [" ".join(base[0])] * 100
    kept = {r.doc_id for r in simhash.one_of_each(frame(spark, texts)).collect()}
    assert kept == set(range(30))


def test_dedup_moves_no_text_at_the_end(spark, capsys):
    """Rows that stay are marked by bits, more than 64 of them and in several partitions."""
    texts = [f"text {k % 150} has words of its own {k % 150} and no others" for k in range(400)]
    out = simhash.one_of_each(frame(spark, texts).repartition(5))
    assert sorted(r.doc_id for r in out.collect()) == list(range(150))
    out.explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out


def test_stored_leaves_no_shuffle_files(spark):
    import glob

    from tremorlake.llm import common

    def files():
        return set(glob.glob("/tmp/blockmgr-*/*/shuffle_*"))

    before, own = spark.conf.get(common.SHUFFLES_GO), files()
    counts = spark.range(5000).groupBy(F.expr("id % 997 as k")).agg(F.count("*").alias("n"))
    assert common.stored(counts, "counts").count() == 997
    assert not [f for f in files() - own if f.endswith(".data") and os.path.getsize(f) > 2000]
    assert spark.conf.get(common.SHUFFLES_GO) == before


def test_dedup_of_awkward_documents(spark):
    out = simhash.one_of_each(cases(spark))
    assert out.columns == cases(spark).columns
    texts = [r.text for r in out.collect()]
    # All without a word are equal; the doubled text stays once.
    assert len(texts) == len({(t or "").strip().lower() for _, t, *_ in CASES})
    assert simhash.one_of_each(empty(spark)).count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0


def word_sets(texts):
    out = []
    for t in texts:
        words = (t or "").lower().split()
        out.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    return out


def kept_plainly(texts):
    """Numbers of the texts that stay: one of each class of Jaccard similarity 0.8 or more."""
    sets = word_sets(texts)
    near = [(a, b) for a in range(len(sets)) for b in range(a)
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = roots(range(len(sets)), near)
    return {k for k in root if root[k] == k}


def changed(rng, words, count):
    out = list(words)
    for k in rng.sample(range(len(out)), count):
        out[k] = f"new{rng.randrange(10**9)}"
    return out


def kept(spark, texts):
    return {r.doc_id for r in simhash.one_of_each(frame(spark, texts)).collect()}


def test_near_copies_below_one_template(spark):
    rng = random.Random(21)
    template, texts, copies = [f"t{k}" for k in range(250)], [], []
    for k in range(300):  # alike at 0.73; some have a copy that is alike at about 0.87
        own = template + [f"own{k}x{j}" for j in range(45)]
        texts.append(" ".join(own))
        if k % 3 == 0:
            copies.append(" ".join(changed(rng, own, 4)))
    want = kept_plainly(texts + copies)
    assert want == set(range(300))
    assert kept(spark, texts + copies) == want


def test_similarity_is_decided_exactly(spark):
    rng = random.Random(22)
    texts = []
    for k in range(120):  # pairs from about 0.7 to 0.95, both sides of the limit
        own = [f"b{k}w{j}" for j in range(rng.choice([40, 120, 300, 900]))]
        texts += [" ".join(own), " ".join(changed(rng, own, max(1, len(own) * rng.randint(1, 6) // 200)))]
    for k in range(40):  # 1 to 12 shingles, one or two of them changed
        own = [f"s{k}w{j}" for j in range(5 + k % 12)]
        texts += [" ".join(own), " ".join(own[:-1] + ["x"]), " ".join([*own, "more"])]
    for k in range(60):  # exactly on the limit and just below it: 80 of 100 and 79 of 100
        own = [f"e{k}w{j}" for j in range(84 if k % 2 else 83)]
        texts += [" ".join(own), " ".join([*own, *[f"m{j}" for j in range(20 if k % 2 else 21)]])]
    sets = word_sets(texts)
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[:240:2], sets[1:240:2])]
    assert sum(0.75 <= s < 0.8 for s in alike) > 3 and sum(0.8 <= s < 0.9 for s in alike) > 10
    assert kept(spark, texts) == kept_plainly(texts)


def test_crowds_are_joined_exactly(spark, monkeypatch):
    """Large groups around a base, whose copies are alike or not, by rounds and by listing."""
    rng = random.Random(23)
    texts = []
    for k, count in enumerate((1, 3, 4, 5)):
        own = [f"g{k}w{j}" for j in range(300)]
        texts += [" ".join(changed(rng, own, count)) for _ in range(60)] + [" ".join(own)] * 3
    rng.shuffle(texts)
    want = kept_plainly(texts)
    assert kept(spark, texts) == want
    monkeypatch.setattr(simhash, "CROWD", 0)
    assert kept(spark, texts) == want


def test_fingerprints_propose_first(spark, monkeypatch):
    """The dedup goes by SimHash: what is within its bits is proposed, and buckets by shingle hold
    no two documents that it joined."""
    rng = random.Random(24)
    own = [f"f{k}w{j}" for k in range(6) for j in range(400)]
    base = [own[400 * k:400 * k + 400] for k in range(6)]
    texts = [" ".join(w) for w in base] + [" ".join([*w, f"last{k}"]) for w in base for k in range(5)]
    texts += [" ".join(changed(rng, w, 8)) for w in base]
    proposed, held, proposals, listed = [], {}, simhash.fingerprint_pairs, simhash.stored

    def seen(distinct, *args):
        out = listed(proposals(distinct, *args), "seen")
        prints = {r.node: r.fp % (1 << 64) for r in distinct.collect()}
        proposed.append((prints, {(r.a, r.b) for r in out.collect()}))
        return out

    def kept_rows(df, name):
        out = listed(df, name)
        held.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(simhash, "fingerprint_pairs", seen)
    monkeypatch.setattr(simhash, "stored", kept_rows)
    assert kept(spark, texts) == kept_plainly(texts) == set(range(6))
    (prints, pairs), = proposed
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert len(near) >= 30 and roots(prints, pairs) == roots(prints, near)
    buckets = defaultdict(set)
    for r in held["shared"][0].collect():
        buckets[r.key].add(r["class"])
    assert all(len(classes) > 1 for classes in buckets.values())


def test_search_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(0, 0.2, 16).round(2).tolist()) for k in range(700)]
    rows += [(700, rows[50][1]), (50, rows[3][1]), (800, None), (850, []), (900, [None] * 16),
             (950, [float("nan")] * 16), (1000, [float("inf")] + [0.0] * 15), (None, rows[1][1]),
             (1050, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    df = df.withColumn("row", F.lit(1)).withColumn("score", F.lit(2))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(
        df, F.expr("vec_id % 50 = 0"), 5).collect())
    valid = [(i, np.pad(np.floor(256 * np.float32(v).astype(float)), (0, 16 - len(v))))
             for i, v in rows if i is not None and v is not None and None not in v
             and np.isfinite(v).all()]
    want = []
    for k, (i, v) in enumerate(valid):
        if i % 50 == 0:
            scored = sorted((-int(v @ w), j) for m, (j, w) in enumerate(valid) if m != k)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert got == sorted(want)


def reshuffled(df):
    """``df`` as one partition whose rows come in another order whenever they are read."""
    import pyarrow as pa

    def run(batches):
        rows = pa.Table.from_batches(batches)
        order = np.random.default_rng().permutation(len(rows))
        yield from rows.take(pa.array(order)).to_batches()

    return df.coalesce(1).mapInArrow(run, df.schema)


def test_dedup_of_rows_in_no_order(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(f"{w}x{k}" for w in words) for k in range(80)]
    assert kept(spark, texts * 2) == set(range(80))
    docs = reshuffled(frame(spark, texts * 2))
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(range(80))


def test_search_of_rows_in_no_order(spark):
    rows = [(k, [float(k), 1.0]) for k in range(100)]
    df = reshuffled(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = {(r.query_id, r.vec_id) for r in search.top_k(df, F.expr("vec_id >= 98"), 2).collect()}
    assert got == {(98, 99), (98, 97), (99, 98), (99, 97)}


def test_search_holds_one_group_of_queries(spark, monkeypatch):
    rows = [(k, [float(k), 1.0]) for k in range(100)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = sorted(search.top_k(df, F.expr("vec_id % 10 = 0"), 3).collect())
    monkeypatch.setattr(search, "QUERY_GROUP", 4)
    found = search.top_k(df, F.expr("vec_id % 10 = 0"), 3)
    assert sorted(found.collect()) == want and len(want) == 30
    # Nothing of the groups is left in the plan: one scan of what was found.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Union" not in plan


def test_search_of_little(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    rows = search.top_k(df, F.expr("vec_id % 50 = 0"), 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 1, 131072)]
    assert search.top_k(df.limit(0), F.expr("vec_id % 50 = 0")).count() == 0


def test_cells_spare_exact_reads():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(0, 0.12, (4096, 64))).astype(np.int64)
    best = search.Best(40, 5)
    ids = np.arange(4096)
    read = search.scan(vectors[:40], ids[:40], best, ids, ids, vectors)
    scores = vectors[:40] @ vectors.T
    scores[np.arange(40), np.arange(40)] = np.iinfo(np.int64).min
    assert (best.score == np.sort(scores, axis=1)[:, ::-1][:, :5]).all()
    assert read < 0.05 * 40 * 4096


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_balanced_and_contiguous(spark, sf_dir, shards):
    docs = given(spark, sf_dir, "documents").select("doc_id", "text").unionByName(
        cases(spark).select("doc_id", "text").where("doc_id is null or doc_id <> 3"))
    rows = sharding.assign(docs, shards).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / shards) <= 2 * largest
    ordered = [r.doc_id if r.doc_id is not None else -2**63
               for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)


def test_shard_files(spark, tmp_path):
    path = sharding.write_shards(cases(spark), str(tmp_path / "shards"), 3)
    back = spark.read.parquet(path)
    assert back.count() == len(CASES) and set(cases(spark).columns) <= set(back.columns)
    assert sharding.assign(empty(spark)).count() == 0


def test_pipeline(spark, sf_dir):
    docs = given(spark, sf_dir, "documents")
    docs = docs.unionByName(cases(spark).select(*docs.columns))
    docs = docs.withColumn("row", F.lit("kept")).withColumn("rate", F.lit(0.5))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id", "piece").count() >= sizes[-1]


def test_pipeline_of_nothing(spark, sf_dir):
    docs = given(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_queries_are_registered():
    from __spark_entry__ import queries

    names = [n for n in queries() if re.match(r"op\d+_|pipeline$", n)]
    assert len(names) == 14
