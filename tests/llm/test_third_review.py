"""Cases of the third review: linked families with open members, rows that repeat a key, items that repeat one, ids left over."""

import itertools
import random
import time

import numpy as np

from touchline.llm import decontamination as D
from touchline.llm import jaccard_join as J
from touchline.llm import lm_scoring as L
from touchline.llm import pii as P


def families(monkeypatch, centre_of):
    """Let ``centre_of`` (smallest id -> id of its centre) say which nodes hang on which centre."""

    def chosen(nodes):
        by = {r.rep: r.node for r in nodes.select("rep", "node").collect()}
        rows = [(node, by[centre_of[i]]) for i, node in by.items() if centre_of.get(i) in by]
        return nodes.sparkSession.createDataFrame(rows, "node long, centre long")

    monkeypatch.setattr(J, "_families", chosen)


def test_open_members_of_linked_families(spark, monkeypatch):
    words = [f"a{i}" for i in range(100)]
    docs = [words, words[:95] + [f"b{i}" for i in range(5)], words[:75] + [f"x{i}" for i in range(25)], words[:75] + [f"x{i}" for i in range(23)] + ["y", "z"]]
    families(monkeypatch, {3: 1, 4: 2})
    found = J.jaccard_components(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs, 1)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_any_families_give_the_same_links(spark, monkeypatch):
    rng = random.Random(8)
    docs = []
    base = [f"w{i}" for i in range(120)]
    for k in range(60):  # chains of edits: neighbours are linked, the ends are not
        base = base if k % 20 else [f"w{i}" for i in range(k, k + 120)]
        at = rng.randrange(100)
        base = base[:at] + [f"e{k}"] + base[at + 1 :]
        docs.append(list(base))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in docs]
    root = list(range(len(docs)))
    for _ in docs:
        for i, j in itertools.combinations(range(len(docs)), 2):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                low = min(root[i], root[j])
                root = [low if r in (root[i], root[j]) else r for r in root]
    families(monkeypatch, {i: rng.choice(range(0, 60, 6)) for i in range(60) if i % 6})
    found = J.jaccard_components(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(root))


def test_one_of_rows_that_repeat_a_key(spark):
    text, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(4, text), (4, text), (5, text), (None, text), (None, text), (None, other), (None, other), (6, "b c"), (6, "a c"), (1, ""), (1, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, _key string, _again int")
    found = J.one_of_each(docs)
    assert found.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in found.collect()) == sorted([(4, text), (0, other), (6, "a c"), (1, ""), (1, ""), (7, "")])
    assert J.one_of_each(docs.where("false")).count() == 0


def test_items_that_repeat_a_key_count_once(spark):
    items = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, "a b")], "item_id long, text string")
    row = D.contamination(spark.createDataFrame([(1, "x a b y c d")], "doc_id long, text string"), items).first()
    assert (row.n_items, row.n_hit) == (2, 4)


def test_training_reads_every_id(monkeypatch):
    rng = np.random.default_rng(2)
    for n in (2, 3, 100, 4097, 5003):
        net = L.Network(np.full(50, 10.0))
        ids = rng.integers(0, 50, n)
        seen = []
        plain = L.Network._window
        monkeypatch.setattr(L.Network, "_window", lambda self, before, goals, h, plain=plain: (seen.append((before, goals)), plain(self, before, goals, h))[1])
        net.train(ids, 0.01)
        monkeypatch.undo()
        assert sum(b.size for b, _ in seen) == n - 1
        assert np.array_equal(np.sort(np.concatenate([g.ravel() for _, g in seen])), np.sort(ids[1:]))


def test_many_addresses_in_one_text():
    text = " ".join(f"name{i}@host.example" for i in range(8_000))
    begin = time.time()
    (good, every), = P.Finder(P.Tagger())([text])
    assert len(good) == 8_000 and set(good) <= set(every) and time.time() - begin < 60  # quadratic work took 300 s
