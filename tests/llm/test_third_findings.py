"""Steps that took too long or too much memory in the third round."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from touchline.llm import packing, pii
from touchline.llm.tokens import Encoder, Merger, public, read_tokenizer

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", FILES)
def test_words_merged_side_by_side_equal_the_library(name):
    file, rng = read_tokenizer(public(name)), random.Random(4)
    merger, library = Merger(json.loads(file)["model"]), Encoder(file)._encoder
    words = ["".join(rng.choice("abeinorst") for _ in range(rng.randrange(1, 40))) for _ in range(600)] + ["a" * n for n in range(1, 65)] + ["inginging", "été", "ähnlich"]
    raw = [w.encode() for w in words]
    sizes = np.array([len(r) for r in raw])
    ids, counts = merger(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
    for w, got in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == library.encode(w, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_words_of_letters_are_not_asked_of_the_library_one_by_one(name, monkeypatch):
    encode, asked = Encoder(read_tokenizer(public(name))), []
    plain = Encoder._ids
    monkeypatch.setattr(Encoder, "_ids", lambda self, text: (asked.append(text), plain(self, text))[1])
    texts = ["An été, a dawn.\nThe next line", "", "a", "x" * 300, "Ünder the Straße, it is À la carte.", "don't\tstop  here\n\n", " led", "end\n"]
    got = list(encode.each(pa.array(texts).slice(0, 5)))
    assert sum(map(len, asked)) <= 303  # the word that is too long for the merger
    for t, ids in zip(texts, [*got, *encode(texts[5:])], strict=True):
        assert ids.tolist() == encode._encoder.encode(t, add_special_tokens=False).ids


def test_network_reads_rows_side_by_side(monkeypatch):
    tagger, rng, most = pii.Tagger(seed=5), np.random.default_rng(2), []
    ids = rng.integers(0, 98, (40, pii.WINDOW)).astype(np.uint8)
    plain = pii.Tagger._best
    monkeypatch.setattr(pii, "DECODED", 7)
    monkeypatch.setattr(pii.Tagger, "_best", lambda self, s: (most.append(len(s)), plain(self, s))[1])
    rows, tags, sure = tagger.decode_open(ids)
    assert max(most) <= 7 and sum(most) == len(rows) > 7
    every, how = plain(tagger, tagger.scores(ids)[0])
    assert (tags == every[rows]).all() and np.allclose(sure, how[rows], atol=1e-4)
    # gates that overflow are shut or open for good
    for k in ("fh", "bh", "fx", "bx"):
        tagger.p[k] *= 1000
    assert np.isfinite(tagger._columns(ids)).all()


def test_pieces_get_their_places_inside_the_row(spark):
    rng = random.Random(6)
    lengths = [rng.choice([1, 2, 3, 7, 40, 41, 700, 1000, 1025, 2048, rng.randrange(1, 2049)]) for _ in range(900)]
    pieces = spark.createDataFrame([(k if k % 9 else None, 0, n, b"x") for k, n in enumerate(lengths)], "doc_id long, piece int, length long, ids binary")
    packed = packing.packed_pieces(pieces)
    # ids of a whole table went through Python once more only to be handed back
    assert "MapInArrow" not in packed._jdf.queryExecution().toString()
    rows, taken = packed.collect(), {}
    assert sorted(r.length for r in rows) == sorted(lengths) and all(r.ids == b"x" for r in rows)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == taken.get(r.sequence_id, 0)
        taken[r.sequence_id] = r.offset + r.length
    assert max(taken.values()) <= packing.MOST and len(taken) <= sum(lengths) / packing.MOST * 1.05 + 1
    assert packing.packed_pieces(pieces.limit(0)).count() == 0
