import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm.bpe import TOKENIZERS, encode, encode_words, load
from cohortloom.llm.queries import QUERIES

PATH = os.path.join(TOKENIZERS, "byte_bpe_50k.json")
FIRST, MERGES = load(PATH)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "array(1) as ids", "'x' as lang")
    return {r.doc_id: r.ids for r in encode(df).collect()}


def test_texts(spark, reference):
    r = random.Random(1)
    texts = ["", "Hello world", " it's  tabs\t\n\n ", "<|endoftext|>", "日本語 é ﬁ １２", "a" * 3000, " " * 500, "x\x1cy\x85z ", "👩‍👩‍👧"]
    texts += ["".join(r.choice("aab bc\n\t '　<|>sé1٣") for _ in range(r.randint(0, 60))) for _ in range(300)]
    got = run(spark, texts)
    assert [got[i] for i in range(len(texts))] == reference(texts)


def test_nulls_repeats_and_long(spark):
    df = spark.createDataFrame([(1, None), (None, "a b"), (2, "a b"), (2, "a b")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.ids) for r in encode(df).collect()), key=str)
    assert (1, []) in got and len(got) == 4 and [x for _, x in got if x] == [got[-1][1]] * 3
    assert encode(df.limit(0)).count() == 0
    long = "Der Patient war stabil. " * 20_000
    assert len(run(spark, [long])[0]) > 100_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12), max_size=12))
def test_words_do_not_touch(words):
    """All words at once give what each gives alone."""
    assert encode_words(words, FIRST, MERGES) == [encode_words([w], FIRST, MERGES)[0] for w in words]


def test_query(spark, reference):
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in QUERIES["p7_ids"](spark, d).collect()}
    assert list(got) and set(got) == set(text) and [got[k] for k in text] == reference(list(text.values()))
