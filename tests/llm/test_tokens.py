"""Encoding, counting, packing and the coded files against plain versions."""

import gc
import weakref
import zlib
from array import array
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from frames import CASES, cases, empty, frame, given
from hypothesis import given as draw
from hypothesis import settings
from hypothesis import strategies as st

from tremorlake.llm import binary, common, counting, packing, rans, tokens, toxicity
from tremorlake.llm.tokens import Encoder
from tremorlake.session import workspace

VOCABULARIES = (("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 1))
ENCODERS = {name: Encoder(name, end) for name, end in VOCABULARIES}


def plain(name, end, texts):
    found = ENCODERS[name].tokenizer.encode_batch([t or "" for t in texts],
                                                  add_special_tokens=False)
    return [array("I", [*x.ids, end]) for x in found]


@pytest.mark.parametrize("name,end", VOCABULARIES)
def test_cached_encoding_is_the_library_s(name, end, sf_dir):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()
    texts += [row[1] for row in CASES]
    for _ in range(2):  # without and with the cache filled
        got = ENCODERS[name].encode(texts)
        assert got == [ids.tobytes() for ids in plain(name, end, texts)]


@settings(max_examples=300, deadline=None)
@draw(st.lists(st.text(st.sampled_from("aBé'st .,!\n\t ᠎1_ßéΣ̀本-"), max_size=30),
               max_size=4))
def test_cached_encoding_of_odd_texts(texts):
    for name, end in VOCABULARIES:
        assert ENCODERS[name].encode(texts) == [x.tobytes() for x in plain(name, end, texts)]


@pytest.mark.parametrize("name,end", VOCABULARIES)
def test_new_words_are_one_call(name, end, monkeypatch):
    """However many words no worker has met, the library gets them as one text."""
    made = Encoder(name, end)
    texts = [" ".join(f"{a}{b}{c}" + "," * (a == "ré") for b in "abcdefg" for c in "xyz")
             for a in ("ba", "ré", "Zu")]
    asked = []

    def ids(texts):
        asked.append(len(texts))
        return Encoder._ids(made, texts)

    monkeypatch.setattr(made, "_ids", ids)
    assert made.encode(texts) == [x.tobytes() for x in plain(name, end, texts)]
    assert max(asked) <= len(texts)


@pytest.mark.parametrize("name,end", VOCABULARIES)
def test_first_words_of_lines_are_in_that_call(name, end, monkeypatch):
    """Nor does the library get a new first word of a line, or a known word with marks, alone."""
    made = Encoder(name, end)
    texts = ["".join(f"{a}{b}{c}" + (",\n" if b in "adg" else " ") for b in "abcdefg"
                     for c in "xyz") + "end" for a in ("ba", "ré", "Zu")]
    asked = []

    def ids(texts):
        asked.append(len(texts))
        return Encoder._ids(made, texts)

    monkeypatch.setattr(made, "_ids", ids)
    want = [x.tobytes() for x in plain(name, end, texts)]
    assert made.encode(texts) == want
    assert max(asked) <= len(texts)
    monkeypatch.setattr(made, "_words", lambda words: pytest.fail(f"asked again: {words}"))
    again = ["baax baby,\nbabx, rébz Zuby!"]
    assert made.encode(again) == [x.tobytes() for x in plain(name, end, again)]


@pytest.mark.parametrize("name,end", VOCABULARIES)
def test_full_caches_change_no_id(name, end, monkeypatch):
    from tremorlake.llm import tokens

    monkeypatch.setattr(tokens, "CACHED", 40)
    monkeypatch.setattr(tokens, "CACHED_LENGTH", 4)
    made = Encoder(name, end)
    for k in range(12):
        texts = [" ".join(f"{'abc'[j % 3]}{chr(97 + j * k % 26)}{'é' * (j % 2)}," * (j % 5 > 0)
                          + f"longer{j}\nthe" for j in range(4 * k)), "the Straße", "", None]
        assert made.encode(texts) == [x.tobytes() for x in plain(name, end, texts)]
        assert len(made.known) <= 40 + 8 * 48


def test_a_worker_keeps_one_operator_s_caches():
    """Else those of the stages before stay in memory through the stages after them."""
    made = tokens.encoder(*VOCABULARIES[0])
    assert tokens.encoder(*VOCABULARIES[0]) is made
    gone = [weakref.ref(made)]
    del made
    gone.append(weakref.ref(toxicity.reader(["mean"])))
    gc.collect()
    assert gone[0]() is None and gone[1]() is toxicity.reader(["mean"])
    tokens.encoder(*VOCABULARIES[1])
    gc.collect()
    assert gone[1]() is None


def test_a_task_s_end_returns_what_arrow_holds(monkeypatch):
    told = []
    pool = SimpleNamespace(release_unused=lambda: told.append("released"))
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    run = common.returning(lambda batches: (told.append(b) or b * 2 for b in batches))
    assert list(run(iter([1, 2]))) == [2, 4] and told == [1, 2, "released"]


def test_fewer_known_words_pack_alike(spark):
    docs = cases(spark)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    few, many = (Counter(packing.pieces(docs, **own).select(*keys).collect())
                 for own in ({"cached": 3}, {}))
    assert few == many and few
    made = Encoder(*VOCABULARIES[1], cached=3)
    made.encode(["one two three four five six seven"])
    made.encode(["other words than those before, and more of them"])
    assert len(made.known) <= 12


@pytest.mark.parametrize("name,end", VOCABULARIES)
def test_known_words_are_not_asked_again(name, end, monkeypatch):
    """Nor are first words; new words behind a space are those of the library's whole encoding."""
    made = Encoder(name, end)
    texts = ["Été naïveté Straße, größer zzqx ÿþ vorbei.", "Zuvor the bqzv größer,"]
    want = [x.tobytes() for x in plain(name, end, texts)]
    assert made.encode(texts) == want
    assert bool(made.words) == (name == "byte_bpe_50k.json")
    monkeypatch.setattr(made, "_ids", lambda texts: [Encoder._ids(made, [t])[0] for t in texts
                                                     if pytest.fail(f"asked again: {t}")])
    assert made.encode(texts) == want


def key(row):
    return tuple((v is not None, v) for v in row)


def test_token_counts(spark):
    sums = counting.suffix_sums(counting.length_histogram(cases(spark)))
    lengths = [len(x) for x in plain("byte_bpe_50k.json", 0, [r[1] for r in CASES])]
    want = [(n, c, sum(v > n for v in lengths), sum(min(v, n) for v in lengths))
            for n, c in sorted(Counter(lengths).items())]
    got = sums.orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.docs, r.docs_longer, r.truncated_tokens) for r in got] == want
    assert {r.total_tokens for r in got} == {sum(lengths)}
    limits = [0, 1, 3, 10, 10**9]
    asked = {r.context_limit: (r.docs_longer, r.truncated_tokens)
             for r in counting.at_limits(sums, limits).collect()}
    assert asked == {n: (sum(v > n for v in lengths), sum(min(v, n) for v in lengths))
                     for n in limits}
    ranks = {r["rank"]: r.n_tokens for r in counting.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    ordered = sorted(lengths)
    assert ranks == {q: ordered[int(np.ceil(q * len(ordered))) - 1] for q in (0.1, 0.5, 1.0)}
    assert counting.suffix_sums(counting.length_histogram(empty(spark))).count() == 0


def check_packed(rows, docs, capacity=4096):
    want = []
    for (doc, *_), ids in zip(docs, plain("word_bpe_49k.json", 1, [d[1] for d in docs])):
        for k in range(0, len(ids), capacity):
            own = ids[k:k + capacity]
            want.append((doc, k // capacity, k, len(own), zlib.crc32(own.tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(w[3] for w in want) // capacity)


def test_packing(spark, sf_dir):
    check_packed(packing.pack(cases(spark)).collect(), CASES)
    docs = given(spark, sf_dir, "documents")
    used, least = check_packed(packing.pack(docs).collect(),
                               [tuple(r) for r in docs.collect()])
    assert used <= least + 2
    assert packing.pack(empty(spark)).count() == 0


def best_fit_alone(histogram, capacity=4096):
    """Plain best fit decreasing: how many sequences."""
    rooms, used = [0] * (capacity + 1), 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            room = next((r for r in range(length, capacity + 1) if rooms[r]), None)
            if room is None:
                room, used = capacity, used + 1
            else:
                rooms[room] -= 1
            rooms[room - length] += 1
    return used


def histograms():
    rng = np.random.default_rng(1)
    logs = Counter(np.clip(rng.lognormal(6, 1, 8000).astype(int), 1, 4096).tolist())
    documents = Counter(np.minimum(4096, np.exp(rng.normal(6.5, 0.8, 6000)).astype(int)).tolist())
    yield "lognormal", logs, 1
    yield "documents", documents, 1
    yield "lognormal x 1000", logs, 1000
    yield "documents x 5000", documents, 5000
    yield "three in a sequence", Counter(rng.integers(1025, 1700, 20000).tolist()), 1
    yield "one length", Counter({1366: 1000}), 1
    yield "few", Counter({4096: 2, 4095: 1, 1: 3}), 1


@pytest.mark.parametrize("name,base,factor", list(histograms()),
                         ids=[name for name, *_ in histograms()])
def test_plan_by_the_linear_program(name, base, factor):
    histogram = Counter({length: n * factor for length, n in base.items()})
    plan = packing.plan_sequences(histogram)
    used, seen = sum(plan.sequences.values()), Counter()
    for config, times in plan.sequences.items():
        assert sum(config) <= 4096 and times > 0
        for length in config:
            seen[length] += times
    assert seen == histogram
    area = sum(length * n for length, n in histogram.items()) / 4096
    assert area <= plan.bound + 1e-6 and plan.bound <= used + 1e-6
    assert used <= plan.bound * 1.001 + 1
    assert plan.best_fit <= 0.05 * used + 1
    if factor == 1:
        assert used <= best_fit_alone(histogram)


@pytest.mark.parametrize("n", [0, 1, 255, 1024, 70_001, rans.BLOCK])
def test_blocks_decode_whole_and_in_part(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
    table = rans.Table(*np.unique(np.append(ids, 7), return_counts=True))
    data = rans.encode(ids, table)
    assert (rans.decode(data, table) == ids).all()
    for first, last in ((n // 2, n // 2 + 5), (n - 1, n), (n // 3, n)):
        if 0 <= first <= last <= n:
            assert (rans.decode(data, table, first, last) == ids[first:last]).all()
    if n > 1000:
        bad = bytearray(data)
        bad[-5] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(bad), table)


def test_joined_checksums():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"12345", b"67" * 999)):
        assert binary.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def check_files(spark, docs, rows):
    path = binary.write_ids(docs, workspace(spark, "t-ids"))
    got = [tuple(r) for r in binary.documents(spark, path).orderBy("start").collect()]
    at, want = 0, []
    rows = sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))
    for (_, row), ids in zip(rows, plain("byte_bpe_50k.json", 0, [r[1][1] for r in rows])):
        want.append((row[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_files_hold_every_document_in_order(spark, sf_dir):
    rows = [r for r in CASES if r[0] not in (4, 9, None)]
    check_files(spark, cases(spark).where("doc_id not in (4, 9)"), rows)
    docs = given(spark, sf_dir, "documents")
    check_files(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_a_document_longer_than_a_block(spark):
    long = "a b c d " * (rans.BLOCK // 3)
    check_files(spark, frame(spark, ["short", long, "end"]),
                [(0, "short"), (1, long), (2, "end")])


def test_no_document(spark):
    path = binary.write_ids(empty(spark), workspace(spark, "t-none"))
    assert binary.documents(spark, path).count() == 0
