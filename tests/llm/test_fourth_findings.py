"""Steps that took too long or too much memory in the third round's second list of findings."""

import re

import numpy as np
from pyspark.sql import functions as F

from touchline.llm import packing, pii
from touchline.llm.tokens import public


def test_windows_of_any_width_lie_side_by_side(monkeypatch):
    tagger, rng, most = pii.Tagger(seed=5), np.random.default_rng(2), []
    widths = np.sort(rng.choice([96, 192, 288, 960], 30))[::-1]
    ids = np.zeros((30, 960), np.uint8)
    for row, w in zip(ids, widths, strict=True):
        row[:w] = rng.integers(0, 98, w)
    monkeypatch.setattr(pii, "SIDE_BY_SIDE", 8)
    monkeypatch.setattr(pii, "DECODED", 7)
    plain = pii.Tagger._best
    monkeypatch.setattr(pii.Tagger, "_best", lambda self, s: (most.append(len(s)), plain(self, s))[1])
    rows, tags, sure = tagger.decode_open(ids, widths)
    assert max(most) <= 7 and sum(most) == len(rows) > 7
    for k, tag, p in zip(rows, tags, sure, strict=True):
        s = tagger.scores(ids[k : k + 1, : widths[k]])[0]
        m, w = tagger.marginals(s)[0], widths[k]
        assert (tag[:w] == plain(tagger, s)[0][0]).all() and not tag[w:].any()
        assert np.allclose(p[:w], np.take_along_axis(m, tag[:w].astype(int)[None, :, None], 2)[0, :, 0], atol=1e-4)


def test_little_of_a_text_is_read_twice(monkeypatch):
    read, plain = [], pii.Tagger._columns
    monkeypatch.setattr(pii.Tagger, "_columns", lambda self, ids, *rest: (read.append(ids.size), plain(self, ids, *rest))[1])
    text = "a word and 7 more, " * 2_000
    pii.Finder(pii.Tagger())([text])
    assert len(text) <= sum(read) < 1.15 * len(text)  # a third of it was


def test_ids_stay_in_the_part_that_made_them(spark):
    docs = spark.range(0, 600, 1, 7).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("doc_id"), F.expr("repeat('some words here ', int(pow(id % 30, 2)))").alias("text"))
    path = public("word_bpe_49k.json")
    packed = packing.packed_documents(docs, path)
    # a window over all columns sent every id through a shuffle and a sort
    assert packed.columns == packing.packed_pieces(packing.token_pieces(docs, path)).columns
    for moved in re.findall(r"Exchange hash.*\n.*", packed._jdf.queryExecution().executedPlan().toString()):
        assert "ids#" not in moved
    rows, taken = packed.collect(), {}
    plain = packing.token_pieces(docs, path).collect()
    assert sorted((r.doc_id or -1, r.piece, r.start, r.ids) for r in rows) == sorted((r.doc_id or -1, r.piece, r.start, r.ids) for r in plain)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == taken.get(r.sequence_id, 0) and r.length == len(r.ids) // 4
        taken[r.sequence_id] = r.offset + r.length
    assert max(taken.values()) <= packing.MOST
    assert len(taken) == packing.packed_pieces(packing.token_pieces(docs, path)).select("sequence_id").distinct().count()
    assert packing.packed_documents(docs.limit(0), path).count() == 0
