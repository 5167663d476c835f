import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortloom.llm.languages import Params, calibrate, corrections, label_language, label_texts, passages, prefixes, train
from cohortloom.llm.queries import QUERIES

D = "/root/testdata/sf0.01"
SAMPLES = duckdb.sql(f"select lang, sample_text from '{D}/lang_samples.parquet' order by sample_id").fetchall()


@pytest.fixture(scope="module")
def model():
    return train(SAMPLES[::2])


def test_held_out_sentences(model):
    rest = SAMPLES[1::2]
    for change in (lambda t: t, str.upper, lambda t: t.replace(".", "").replace(",", "")):
        got = label_texts([change(t) for _, t in rest], model, {}, [])
        assert sum(len(g) == 1 and g[0][0] == lang for g, (lang, _) in zip(got, rest)) >= 0.98 * len(rest)


def test_held_out_mixtures(model):
    r = random.Random(2)
    by = {}
    for lang, t in SAMPLES[1::2]:
        by.setdefault(lang, []).append(t)
    good = 0
    for _ in range(200):
        langs = r.sample(sorted(by), r.randint(2, 3))
        text = r.choice([" ", "\n\n", "\n- "]).join(r.choice(by[x]) for x in langs)
        good += [p[0] for p in label_texts([text], model, {}, [])[0]] == langs
    assert good >= 190


def test_short_foreign_phrases_open_no_passage(model):
    base = next(t for lang, t in SAMPLES if lang == "en")
    for phrase in ('"grazie mille"', '"спасибо"', "(Zustand nach)", "'tudo bem'", "Nota de alta:"):
        assert [p[0] for p in label_texts([f"{base} {phrase} {base}"], model, {}, [])[0]] == ["en"]


def test_texts_without_words(model):
    assert label_texts([None, "", " \n", "180.2\n145.0", "x" * 200_000], model, {}, [])[:4] == [[], [], [], []]


@pytest.mark.parametrize(("label", "want"), [("en_gb", "en"), ("pt-BR", "pt"), ("EN", "en"), (" fre ", "fr"), ("Deutsch", "de"), ("Portuguese", "pt"), ("xx", None), ("und", None), ("", None), (None, None), ("-", None), ("n/a", None), ("unknown", None), ("rus", "ru"), ("español", "es")])
def test_labels(label, want):
    assert label_language(label, ["de", "en", "es", "fr", "it", "nl", "pl", "pt", "ru"]) == want


def test_documents(spark):
    en, it = (next(t for lang, t in SAMPLES if lang == x) for x in ("en", "it"))
    rows = [(1, en, "en-US"), (2, en, None), (3, it, "es"), (4, en + "\n" + it, "en"), (5, None, None), (6, "12 34", None), (7, it, "Italian"), (2, en, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("seg", F.lit("a"))
    samples = spark.createDataFrame([(*s, 1) for s in SAMPLES] + [(None, "x", 1), ("en", None, 1)], "lang string, sample_text string, text int")
    found = passages(docs, samples)
    got = sorted((r.doc_id, r.seg, r.lang) for r in corrections(found).collect())
    assert got == [(2, 1, "en"), (2, 1, "en"), (3, 1, "it"), (4, 1, "en"), (4, 2, "it")]
    assert all(0 < r.confidence < 1 for r in found.collect())
    assert passages(docs.limit(0), samples).count() == 0 and passages(docs, samples.limit(0)).count() == 0


def table(rows, model):
    """Mean confidence, share of right languages and size, by range of confidence."""
    seen = [(model.confidence(m, n), lang == found) for lang, found, m, n in prefixes(rows, model)]
    cuts = (0, 0.5, 0.7, 0.9, 0.99, 1)
    parts = [[x for x in seen if a < x[0] <= b] for a, b in zip(cuts, cuts[1:])]
    return [(sum(c for c, _ in p) / len(p), sum(ok for _, ok in p) / len(p), len(p)) for p in parts if p]


def test_confidence_is_accuracy():
    """On sentences that neither the model nor its calibration has seen, confidence is the share that is right."""
    model = train(SAMPLES[::2])
    model.calibration = calibrate(SAMPLES[::2])
    found = table(SAMPLES[1::2], model)
    assert len(found) >= 3
    for mean, right, n in found:
        assert abs(mean - right) < 0.05 + 2 * (0.25 / n) ** 0.5


def test_ambiguous_texts_are_uncertain():
    model = train(SAMPLES)
    model.calibration = calibrate(SAMPLES)
    sure = label_texts([t for _, t in SAMPLES], model, {}, [])
    unsure = label_texts(["no", "la", "normal animal", "zqx", "no la"], model, {}, [])
    assert all(p[2] > 0.95 for g in sure for p in g) and all(p[2] < 0.9 for g in unsure for p in g)


def test_sample_bound(spark):
    samples = spark.createDataFrame(SAMPLES, "lang string, sample_text string")
    docs = spark.createDataFrame([(1, SAMPLES[0][1], None)], "doc_id bigint, text string, lang string")
    assert passages(docs, samples, Params(samples=90)).count() == 1


def test_query(spark):
    got = QUERIES["p9_found"](spark, "/root/testdata/sf0.001")
    assert got.count() == got.select("doc_id", "seg").distinct().count() > 0
