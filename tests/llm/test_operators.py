"""Operators against brute force on small fixtures, and their defined cases."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import decontamination as D
from touchline.llm import jaccard_join as J
from touchline.llm import license_scan as S
from touchline.llm import lm_scoring as L
from touchline.llm import packing as K
from touchline.llm import pii as P
from touchline.llm import quality_classifier as C
from touchline.llm import quality_rules as Q
from touchline.llm import token_output as O
from touchline.llm import url_filters as U
from touchline.llm.tokens import Encoder, public, read_tokenizer

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, node string, id string, "
    "spans string, tokens string, ids string, rank string, length2 string, `odd.name` string"
)


def _row(i, text):
    return (i, text, None, None, None, *["x"] * 10)


WORDS = [a + b for a in "ba be bi bo bu da de di do du".split() for b in ("", "n", "ra", "sti")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def hostile(spark):
    rng = random.Random(1)
    text = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, text), (4, text), (5, text), (6, prose(rng, 30_000)), (7, "x" * 50_000), (None, text), (8, "a b"), (9, "a b"),
            (10, "0" * 3000 + "@" * 50), (11, "é 　  ü \x1c  ß" * 30), (12, "mail a.b@c.de or 10.0.0.1, +1 (555) 010-9999; 4111 1111 1111 1111")]
    return spark.createDataFrame([_row(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a b"), (2, None), (None, "a b"), (3, "A, B!"), (4, "")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 0), (6, None), (99, 1), (None, 1)], "doc_id bigint, quality int")


def pages_of(df):
    return df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.net/"), F.substring("text", 1, 50)).alias("url"), F.col("text").alias("html"))


def runs(docs, items, labels):
    word, byte = public("word_bpe_49k.json"), public("byte_bpe_50k.json")
    return {
        "quality": lambda: Q.quality_verdicts(docs), "kept": lambda: Q.keep_documents(docs), "jaccard": lambda: J.jaccard_components(docs),
        "pii": lambda: P.personal_data(docs), "masked": lambda: P.redacted(docs), "classifier": lambda: C.quality_scores(docs, labels),
        "lm": lambda: L.document_scores(docs), "packing": lambda: K.packed_documents(docs, word), "urls": lambda: U.url_verdicts(pages_of(docs)),
        "tokens": lambda: O.read_tokens(docs.sparkSession, O.token_files(docs, byte)), "leaks": lambda: D.contamination(docs, items),
        "cut": lambda: D.without_phrases(docs, items), "licenses": lambda: S.licenses(docs),
    }


@pytest.mark.parametrize("name", sorted(runs(None, None, None)))
def test_hostile_rows_and_empty_tables(hostile, items, labels, name):
    found = runs(hostile, items, labels)[name]().collect()
    total = hostile.count()
    if name == "packing":
        assert len({r.doc_id for r in found}) == total - 1  # one key is there twice
    elif name == "kept":
        assert [r.doc_id for r in found].count(4) == 2 and found[0].asDict()["odd.name"] == "x"
    elif name == "cut":
        assert len(found) == total - 2 and all(not re.search(r"\ba b\b", r.text or "") for r in found)  # two have no other word
    else:
        assert len(found) == total
    empty = runs(hostile.where("false"), items.where("false"), labels.where("false"))[name]()
    assert empty.columns and empty.count() == 0


def test_defined_results_of_hostile_rows(hostile, items):
    by_id = {r.doc_id: r for r in J.jaccard_components(hostile).collect()}
    assert (by_id[1].n_shingles, by_id[1].component_id) == (0, 1) and by_id[5].component_id == 4 and by_id[9].component_id == 8
    assert by_id[None].component_id is None
    leaks = {r.doc_id: r for r in D.contamination(hostile, items).collect()}
    assert leaks[8].n_hit == 2 and leaks[8].n_items == 2 and not leaks[1].contaminated
    data = {r.doc_id: r for r in P.personal_data(hostile).collect()}
    assert (data[12].n_email, data[12].n_ip, data[12].n_card, data[12].n_phone) == (1, 1, 1, 1) and data[1].spans == ""


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_against_all_pairs(spark, size, percent):
    rng = random.Random(size)
    docs = []
    for _ in range(6):
        base = prose(rng, rng.choice([8, 40, 150])).split()
        for _ in range(rng.choice([2, 25, 40])):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 18))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs.append(" ".join(w[: rng.randrange(len(w) - 2, len(w) + 1)]))
    docs += [prose(rng, n) for n in range(12)] + docs[:5]
    sets = []
    for t in docs:
        w = t.split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(docs)))
    for _ in docs:
        for i, j in itertools.combinations(range(len(docs)), 2):
            if sets[i] and sets[j] and root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low = min(root[i], root[j])
                root = [low if r in (root[i], root[j]) else r for r in root]
    found = J.jaccard_components(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), size=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_delta_links_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 5)
    test_jaccard_against_all_pairs(spark, 4, 85)


def test_fm_index_against_scan():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(0, 4, 3000), 0)
    index = D.FMIndex(text, 3)
    for n in (1, 2, 5):
        phrase = np.array([[*[0] * (6 - n), *rng.integers(1, 4, n)]])
        low, high = index.search(phrase, np.array([n]))
        want = [i for i in range(len(text) - n) if (text[i : i + n] == phrase[0, 6 - n :]).all()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_cut_leaves_no_phrase(spark):
    phrase = " ".join(f"p{i}" for i in range(10))
    split = " ".join(f"p{i}" for i in range(5)) + " " + phrase + ". " + " ".join(f"p{i}" for i in range(5, 10))
    docs = spark.createDataFrame([(1, f"before, {phrase}; after"), (2, split), (3, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(7, phrase)], "item_id long, text string")
    found = {r.doc_id: r.text for r in D.without_phrases(docs, items).collect()}
    assert found == {1: "before, ; after", 3: "clean text"}


def test_pii_rules_against_plain_patterns():
    rng = random.Random(4)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rng.choice("a1.@-+ 2(") for _ in range(rng.randrange(40)))
        good, _ = P.rule_spans(text)
        assert [s for s in good if s[0] == "email"] == [("email", *m.span()) for m in email.finditer(text)]
        assert [s for s in good if s[0] == "ip"] == [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) < 256 for p in m[0].split("."))]


def test_tagger_learns_and_its_gradient_holds():
    text = [("word " * 12)[: 30 + k % 20] + "192.168.0.7" + " word" * 8 for k in range(40)]
    ids, tags = np.zeros((40, P.WINDOW), np.uint8), np.zeros((40, P.WINDOW), np.int64)
    for i, t in enumerate(text):
        w = P.char_ids(t)[: P.WINDOW]
        ids[i, : len(w)] = w
        tags[i] = P.window_tags(P.rule_spans(t)[0], 0)
    tagger = P.Tagger()
    small, gold = ids[:2], tags[:2]
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    _, grads = tagger.loss_and_grads(small, gold)
    for name in ("emb", "fx", "bh", "trans", "out"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        held = tagger.p[name][at]
        tagger.p[name][at] = held + 1e-3
        up, _ = tagger.loss_and_grads(small, gold)
        tagger.p[name][at] = held - 1e-3
        down, _ = tagger.loss_and_grads(small, gold)
        tagger.p[name][at] = held
        assert (up - down) / 2e-3 == pytest.approx(grads[name][at], rel=0.05, abs=1e-3)
    tagger = P.Tagger()
    losses = tagger.fit(ids, tags, steps=60)
    assert losses[-1] < losses[0] / 5
    assert (tagger.decode(ids)[0] == tags).mean() > 0.97


def test_reconcile_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        found = [(("ip", a, a + rng.randrange(1, 8)), rng.random()) for a in (rng.randrange(20) for _ in range(6))]
        weight = collections.Counter()
        for s, p in found:
            weight[s] += p * (s[2] - s[1])
        best = max(
            sum(weight[s] for s in some)
            for n in range(7) for some in itertools.combinations(weight, n)
            if all(x[2] <= y[1] for x, y in itertools.pairwise(sorted(some, key=lambda s: s[1])))
        )
        assert sum(weight[s] for s in P.reconcile(found)) == pytest.approx(best)


def test_isotonic_and_held_out_accuracy(spark):
    y = C.pooled(np.arange(5), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert y.tolist() == [0, 0.5, 0.5, 1, 1]
    rng = random.Random(6)
    docs = [(i, prose(rng, 80) if i % 3 else prose(rng, 80).replace(" ", "&&& ")) for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in docs], "doc_id long, quality int")
    found = [r for r in C.quality_scores(table, labels).collect() if r.held_out]
    assert len(found) > 30 and all(r.predicted == int(r.doc_id % 3 > 0) and 0 <= r.score <= 1 for r in found)
    none = C.quality_scores(table, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_network_is_a_distribution_with_right_gradients():
    rng = np.random.default_rng(1)
    net = L.Network(rng.integers(1, 50, 90).astype(float))
    h = rng.standard_normal((1, L.HIDDEN)).astype(np.float32)
    assert np.exp(net.log_probs(np.repeat(h, 90, axis=0), np.arange(90))).sum() == pytest.approx(1, abs=1e-4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    before, after, start = rng.integers(0, 90, (3, 5)), rng.integers(0, 90, (3, 5)), np.zeros((3, L.HIDDEN))
    _, grads, _ = net.loss_and_grads(before, after, start)
    for name in ("emb", "x", "h", "b", "c", "w"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        held = net.p[name][at]
        net.p[name][at] = held + 1e-3
        up = net.loss_and_grads(before, after, start)[0]
        net.p[name][at] = held - 1e-3
        down = net.loss_and_grads(before, after, start)[0]
        net.p[name][at] = held
        assert (up - down) / 2e-3 == pytest.approx(grads[name][at], rel=0.05, abs=1e-5)
    ids = np.tile(np.arange(1, 21), 400)
    net = L.Network(np.full(90, 5.0))
    first = net.train(ids, 0.01)
    assert min(net.train(ids, 0.02) for _ in range(8)) < first / 2
    # state is carried over windows: a row scored at once equals its parts scored word by word
    row = rng.integers(0, 90, 3 * L.WINDOW + 5)
    table, state, last, total = net.inputs(), np.zeros((1, L.HIDDEN), np.float32), np.zeros(1, np.int64), 0.0
    for word in row:
        state = net._step(table[last], state)[4]
        last = np.array([word])
        total += net.log_probs(state, last)[0]
    assert net.score([row])[0] == pytest.approx(total / np.log(10), rel=1e-4)


def test_lm_base_scores_against_counts(spark):
    rng = random.Random(7)
    docs = [(i, prose(rng, 30)) for i in range(60)]
    counts = collections.Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in L.document_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        words = [*docs[r.doc_id][1].split(), None]
        assert r.n_tokens == len(words) and r.train_tokens == n and r.n_known == sum(w in counts for w in words)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r.score < 0


def test_packing_is_gapless_and_tight(spark):
    rng = random.Random(8)
    docs = [(i, prose(rng, rng.choice([0, 3, 50, 400, 900, 5000]))) for i in range(300)]
    path = public("word_bpe_49k.json")
    plain = Encoder(read_tokenizer(path))._encoder
    rows = K.packed_documents(spark.createDataFrame(docs, "doc_id long, text string"), path).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in docs:
        pieces = sorted(by_doc[i])
        assert [x for _, p in pieces for x in p] == [*plain.encode(t, add_special_tokens=False).ids, 0]
        assert all(len(p) == 2048 for _, p in pieces[:-1])
    total = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(by_sequence) <= total / 2048 * 1.05 + 1


def test_ranks_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(K, "RANKED", 10)
    rows = K.ranked(spark.range(95).select("id", (F.col("id") % 3).alias("length")), ["id"]).collect()
    for n in range(3):
        got = sorted(r["rank"] for r in rows if r.length == n)
        assert got == list(range(len(got)))


def test_encoder_equals_the_library():
    rng = random.Random(9)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode = Encoder(read_tokenizer(public(name)), bound=50)
        texts = ["".join(rng.choice(["ab", "C", " ", "  ", "\n", "é", ".", ",", "'s", "7", "\t", "❤", "<|endoftext|>", "x y"]) for _ in range(rng.randrange(30))) for _ in range(800)]
        for t, ids in zip(texts, encode(texts), strict=True):
            assert ids.tolist() == encode._encoder.encode(t, add_special_tokens=False).ids


def test_shards_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for high in (3, 300, 50_000):
        docs = [rng.integers(0, high, n).astype(np.uint32) for n in (1, 5, 4000, 1, 2500)]
        docs.append(np.tile(docs[2][:700], 9))
        blob = O.encode_shard(docs)
        shard = O.Shard(blob)
        assert [d.tolist() for d in shard.all()] == [d.tolist() for d in docs]
        assert all(shard.document(k).tolist() == d.tolist() for k, d in enumerate(docs))
    assert len(O.encode_shard([np.tile(np.arange(64, dtype=np.uint32), 500)])) < 32_000 * 2 / 3


def test_url_rules_and_segmentation():
    rules = U.Rules(U.RULES)
    cases = {("a.net", "/x"): "net/", ("b.example.net", "/en/1"): "example.net/en/", ("example.com", "/de/"): "example.com/de/", ("net", ""): None, ("xnet", "/"): None, ("a.org", "/fr/q"): "org/fr/"}
    for (host, path), want in cases.items():
        rule = rules(host, path)
        assert (rule.text if rule else None) == want
    counts = {"free": 5, "bets": 3, "be": 9, "ts": 1, "fr": 2, "ee": 1}
    segment = U.Segmenter(counts)

    def best(name):
        if not name:
            return 0.0
        return min((segment.cost.get(name[:k], segment.strange if k == 1 else 1e9) + best(name[k:])) for k in range(1, len(name) + 1))

    for name in ("freebets", "beets", "xfreeq", "tsfr"):
        words = segment.split(name)
        assert "".join(words) == name
        assert sum(segment.cost.get(w, segment.strange) for w in words) == pytest.approx(best(name))


def test_license_stretches_against_scan(spark):
    rng = random.Random(10)
    notices = {name: re.sub(r"[^a-z0-9]+", " ", text.lower()).split() for name, text in S.TEMPLATES.items()}
    own = {n: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for n, w in notices.items()}
    docs = []
    for i in range(120):
        w = prose(rng, rng.randrange(0, 200)).split()
        name = rng.choice(list(notices))
        some = list(notices[name])
        if i % 3 == 0 and len(some) > 9:
            some[rng.choice([0, -1])] = "changed"
        at = rng.randrange(len(w) + 1)
        docs.append((i, " ".join(w[:at] + (some if i % 4 else some[: len(some) // 2]) + w[at:])))
    found = {r.doc_id: r.licenses for r in S.licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        w = t.split()
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        want = sorted(n for n, o in own.items() if any(g in o and 100 * len(set(grams[k : k + 2 * len(o)]) & o) >= 80 * len(o) for k, g in enumerate(grams)))
        assert found[i] == ",".join(want), t


def test_most_frequent_rows_keep_ties_together(spark):
    from touchline.llm.shared import most_frequent

    counts = spark.createDataFrame([(w, c) for c in (1, 1, 1, 5, 5, 9) for w in ("a",)], "word string, c bigint")
    for most, want in ((0, []), (1, [9]), (2, [9]), (3, [5, 5, 9]), (5, [5, 5, 9]), (6, [1, 1, 1, 5, 5, 9])):
        assert sorted(r.c for r in most_frequent(counts, most)) == want
