"""Token counts against the library: random strings, whole tables, defined cases."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from touchline.llm import token_counts as T
from touchline.llm.tokens import public

PATH = public("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    TEXT = f.read()
COUNTER = T.Counter(TEXT)


def expected(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\taeinrst'0.")))
def test_any_text(text):
    assert COUNTER([text]) == [expected(text)]


def test_runs_marks_and_long_words():
    rng = random.Random(3)
    texts = ["", " ", "a" * 5001, "ab" * 3000 + "b" * 777, "".join(rng.choice("etaoinshr") for _ in range(9000)), " " * 4000 + "x", "\n \n\t  ", "=" * 3001,
             "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "it's we'll I'M don''t", "é" * 2100, "ࢗ\U000323b0 x", "1" * 2500, "a\u0085b　 c"]
    assert COUNTER(texts) == [expected(t) for t in texts]


def test_ragged_and_queue_agree():
    rng = random.Random(5)
    words = ["".join(rng.choice("aabtheing ") for _ in range(rng.randint(1, 60))).encode() for _ in range(3000)]
    merges = T.Merges(json.loads(TEXT))
    assert merges.counts(words).tolist() == [merges._one(w) for w in words]


def test_memory_turns_over(monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 50)
    small = T.Counter(TEXT, known=60)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) for _ in range(200)) for _ in range(30)]
    assert small(texts) == [expected(t) for t in texts]
    assert len(small._lately) <= 60 + 2 * 50


def test_files_of_another_kind_are_refused():
    spec = json.loads(TEXT)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        T.Merges(spec)
    with open(public("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        T.Merges(json.load(f))


def test_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in T.token_counts(docs, PATH).collect()}
    assert len(rows) == docs.count()
    for r in docs.collect():
        n = expected(r.text or "")
        assert (rows[r.doc_id].n_bytes, rows[r.doc_id].n_tokens, rows[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 1024)


def test_defined_cases(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "x" * 300_000), (4, "same"), (4, "same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash")).withColumn("_key", F.lit(1)).withColumn("a.b", F.lit(2))
    found = sorted((tuple(r) for r in T.token_counts(docs, PATH, limit=1).collect()), key=str)
    want = sorted(((k, len(t or ""), expected(t or ""), expected(t or "") > 1) for k, t in rows), key=str)
    assert found == want
    assert T.token_counts(docs.limit(0), PATH).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert T.token_counts(docs.limit(0), PATH).count() == 0
