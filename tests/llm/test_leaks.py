import random

from pyspark.sql import functions as F

from cohortloom.llm.leaks import SuffixAutomaton, leaked_items, remove_leaks, words_of
from cohortloom.llm.queries import QUERIES

WORDS = [f"w{i}" for i in range(40)]


def windows(words, n=12):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(5))
    i = spark.createDataFrame(items, "item_id bigint, item_text string").withColumn("text", F.lit("x"))
    return d, i


def test_random_against_windows(spark):
    r = random.Random(5)
    items = [(i, " ".join(r.choice(WORDS[: 4 if i % 3 == 0 else 40]) for _ in range(r.randint(3, 40)))) for i in range(30)]
    docs = []
    for k in range(120):
        words = [r.choice(WORDS + ["zz"]) for _ in range(r.randint(0, 60))]
        if r.random() < 0.7:
            src = r.choice(items)[1].split()
            a = r.randint(0, max(0, len(src) - 12))
            at = r.randint(0, len(words))
            words[at:at] = src[a : a + r.randint(8, 20)]
        docs.append((k, " ".join(words)))
    want = {(d, i) for d, t in docs for i, s in items if windows(t.split()) & windows(s.split())}
    got = [(x.doc_id, x.item_id) for x in leaked_items(*frames(spark, docs, items)).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20


ITEM = "A 78-year-old carpenter of 50411 grams arrives with hair loss and a stiff neck that began 4479 minutes after moving"


def test_shapes(spark):
    shapes = [
        ITEM.upper(),
        "note:\n> " + ITEM.replace(" and", "\n> and"),
        ITEM.replace("arrives", "arr-\nives").replace("neck", "ne-\r\n  ck"),
        ITEM.replace("78-year", "78-\nyear"),
        ITEM.replace("grams", "gra⁠ms").replace("hair", "ha­ir"),
        ITEM.replace("loss", "loss­\nx").replace("­\nx", "") + " x",
        ITEM.replace(" ", "  \t"),
        ITEM.replace("carpenter", "cárpènter"),
        "before it " + " ".join(ITEM.split()[2:13]) + " after",
        "before it " + " ".join(ITEM.split()[2:14]) + " after",
        ITEM.replace("grams", "pounds").replace("stiff", "sore"),
        None,
        "",
    ]
    got = {x.doc_id for x in leaked_items(*frames(spark, list(enumerate(shapes)), [(1, ITEM), (2, "too short"), (3, None), (1, ITEM)])).collect()}
    assert got == {0, 1, 2, 3, 4, 5, 6, 7, 9}


def test_more_items_than_one_automaton(spark, monkeypatch):
    from cohortloom.llm import leaks

    items = [(i, " ".join(f"k{i}_{j}".replace("_", "x") for j in range(20))) for i in range(9)]
    docs = [(i, t) for i, t in items]
    monkeypatch.setattr(leaks, "AUTOMATON_WORDS", 50)
    docs += [(20, "before it " * 40 + items[1][1] + " and " + items[8][1])]
    d, i = frames(spark, docs, items)
    assert len(list(leaks.automata(i))) > 1
    assert {(x.doc_id, x.item_id) for x in leaked_items(d, i).collect()} == {(k, k) for k in range(9)} | {(20, 1), (20, 8)}
    got = {r.doc_id: r for r in remove_leaks(d, i).collect()}
    assert got[20].n_leaked == 40 and got[20].clean.split() == ["before", "it"] * 40 + ["and"] and got[3].clean is None


def test_nothing_leaks_from_clean_texts(spark):
    """Clean texts have no pair that the search reports: divided words, overlapping leaks, and leaks that would
    appear where others were cut out. Words outside stay."""
    r = random.Random(8)
    vocabulary = [a + b for a in ("re", "up", "in") for b in ("set", "let", "on")] + ["re", "up", "in", "set", "let", "on"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(12, 30)))) for i in range(12)]

    def divide(text):
        words = []
        for w in text.split():
            k = r.randint(1, max(1, len(w) - 1))
            words.append(w[:k] + "-\n" + w[k:] if len(w) > 2 and r.random() < 0.3 else w)
        return " ".join(words)

    docs = []
    for k in range(150):
        x, y = r.choice(items)[1].split(), r.choice(items)[1].split()
        a = r.randint(0, len(x))
        text = {0: x, 1: x[:a] + y + x[a:], 2: x[:a] + y, 3: [*x[:11], *y, *x[11:]]}[k % 4]
        docs.append((k, "Seen before " * 40 + divide(" ".join(text)) + " Seen after" * 40))
    d, i = frames(spark, docs, items)
    leaked = {x.doc_id for x in leaked_items(d, i).collect()}
    got = remove_leaks(d, i)
    rows = got.collect()
    assert len(leaked) > 120 and {x.doc_id for x in rows if x.n_leaked} == leaked
    assert all(x.clean.startswith("Seen before " * 40) and x.clean.endswith(" Seen after" * 40) for x in rows)
    assert leaked_items(got.selectExpr("doc_id", "clean as text"), i).count() == 0


def test_clean(spark):
    docs = [(1, "Seen today. " + ITEM + ". Stable " + "and well " * 30), (2, ITEM), (3, None), (4, "nothing"), (5, "")]
    got = {r.doc_id: r for r in remove_leaks(*frames(spark, docs, [(1, ITEM)])).collect()}
    assert got[1].clean.startswith("Seen today. . Stable") and got[1].n_leaked == 22
    assert got[2].clean is None and got[3].clean is None and got[4].clean == "nothing" and got[5].clean == ""


def test_empty_tables(spark):
    d, i = frames(spark, [(1, ITEM)], [(1, ITEM)])
    assert leaked_items(d, i.limit(0)).count() == 0 and leaked_items(d.limit(0), i).count() == 0
    assert SuffixAutomaton([]).vocabulary == {} and words_of("1½ ﬁt") == ["11", "2", "fit"]


def test_long_text(spark):
    d, i = frames(spark, [(1, "stable and well " * 100_000 + ITEM)], [(1, ITEM)])
    assert leaked_items(d, i).count() == 1


def test_query(spark):
    got = QUERIES["p8_found"](spark, "/root/testdata/sf0.001")
    assert got.count() == got.distinct().count() > 0
