"""Cases of the second review: each was cut or missed before."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from touchline.llm import license_scan as S
from touchline.llm import lm_scoring as L


def test_lm_learns_from_texts_of_any_hash(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") + str(i) for _ in range(40)) for i in range(20)]
    docs = spark.createDataFrame([(i, texts[i % 20]) for i in range(3000)], "doc_id long, text string")
    docs = docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) != 0)
    row = L.document_scores(docs).agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > 0.8 * row[1]  # logarithms: the unigram model's are lower


def test_lm_vocabulary_grows_with_the_corpus():
    own = {}
    for times in (1, 100):
        head = [(b"w%d" % i, max(1, 100_000 * times // (i + 1))) for i in range(50_000)]
        words = L.Vocabulary(head, 10, 10 + sum(c for _, c in head), 50_001)
        own[times] = len(words.counts) - 2
        assert list(words.outputs(np.array([own[times] - 1, own[times], -1]))) == [own[times] + 1, 1, 1, 0]
        assert words.counts.sum() == words.tokens
        classes = len(L.Network(words.counts).bounds) - 1
        assert 0.5 * np.sqrt(own[times]) < classes < 2 * np.sqrt(own[times])
    assert own[1] > 2000 and own[100] > 5 * own[1]


def test_lm_spreads_copies_over_parts(spark):
    words = L.Vocabulary([(b"a", 2000), (b"b", 1000)], 1000, 4000, 3)
    docs = spark.createDataFrame([(7, "a b a")] * 1000, "doc_id long, text string")
    rows = L.coded(docs, "doc_id", "text", spark.sparkContext.broadcast(words))
    sizes = [r["count"] for r in rows.groupBy(F.pmod("h", F.lit(8))).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 200


def test_license_bodies_edited_and_across_windows(spark):
    rng = random.Random(4)
    bodies = [(name, text) for _, name, text in S.BODIES]
    docs, want = [], []
    for name, text in bodies:
        for lead in (0, 100, 500):
            words = text.split()
            words[-3] = "edited"
            docs.append(" ".join(f"w{rng.randrange(999)}" for _ in range(lead)) + " " + " ".join(words) + " tail of it")
            want.append(name)
    for text, names in (("Licensed under the MIT license", "MIT"), ("// SPDX-License-Identifier: MIT\nint a;", "MIT"), ("All rights reserved.", ""),
                        ("# SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", "BSD-3-Clause,GPL-2.0-only"),
                        (f"{bodies[-2][1]} {'and then ' * 100} {bodies[6][1]}", f"{bodies[-2][0]},{bodies[6][0]}")):
        docs.append(text)
        want.append(names)
    found = {r.doc_id: r.licenses for r in S.licenses(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(docs))] == [",".join(sorted(w.split(","))) for w in want]


def test_marks_are_in_every_match():
    rng = random.Random(4)
    known = [(re.sub(r"[^a-z0-9]+", " ", text.lower()).split(), least) for text, least in [(t, 80) for t in S.TEMPLATES.values()] + [(t, 80) for _, _, t in S.BODIES] + [(t, 100) for _, t in S.NOTICES]]
    needed = S.marks(known)
    assert all(len(w) > 4 for w in needed)
    for words, least in known:
        shingles = sorted({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
        bare = [s for s in shingles if not any(m in w for m in needed for w in s)]
        assert 100 * len(bare) < least * len(shingles)
        some = rng.sample(shingles, -(-least * len(shingles) // 100))
        assert any(m in w for m in needed for s in some for w in s)
    assert S.marks([(["a", "b", "c", "d", "e"], 80)]) and S.marks([]) == []
