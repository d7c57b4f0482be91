import random

import pytest
from pyspark.sql import functions as F

from brute import hits, words
from markscale.llm import decontaminate
from markscale.llm.decontaminate import build_index, find_hits, hit_items, hit_words, proximity_matches


def found(docs, items, **more):
    got = find_hits(docs, items, **more)
    assert [c for c in got.columns if c in docs.columns] == docs.columns
    return got.select("doc_id", "text", "n_words", "hits", hit_words(F.col("hits")).alias("n_hit"), hit_items(F.col("hits")).alias("ids")).collect()


def check(rows, items, window):
    for r in rows:
        want = sorted(set(hits(r.text, items, window)), key=repr)
        assert sorted({tuple(h) for h in r.hits}, key=repr) == want
        assert len(r.hits) == len(want)
        assert r.n_words == len(words(r.text))
        assert r.n_hit == len({i for _, at, size in want for i in range(at, at + size)})
        assert r.ids == sorted({str(i) for i, _, _ in want})


@pytest.mark.parametrize("window,points", [(13, 3), (4, 3), (3, 1), (1, 2)])
def test_against_brute_force(spark, window, points):
    """Few different words: repeated terms, overlapping and truncated occurrences."""
    rng = random.Random(window)
    word = lambda: rng.choice(["a", "b", "C", "dé", "Ü1", "e-f"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 14, 20])))) for i in range(12)]
    items += [(3, "B a b A"), (3, "B a b A"), (90, None), (91, "zz never a b"), (92, "a " * 20)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(12)))]
        for _ in range(rng.randrange(4)):
            v = words(rng.choice(items)[1])
            low = rng.randrange(len(v) + 1)
            parts += [" ".join(v[low : low + rng.randrange(20)]), word()]
        docs.append((i, " ".join(parts)))
    docs += [(0, docs[0][1]), (None, docs[1][1]), (None, None), (70, ""), (71, "a " * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shift", F.lit(1)).withColumn("term", F.lit("x"))
    rows = found(df, spark.createDataFrame(items, "item_id long, text string"), window=window, points=points)
    assert len(rows) == len(docs)
    check(rows, list(dict.fromkeys(items)), window)


def test_tables_too_large_to_broadcast_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "TERM_BYTES", 0)
    test_against_brute_force(spark, 4, 3)
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "a b"), (2, None)], "doc_id long, text string")
    bad = docs.where("text = 'a b'").select(F.col("doc_id").alias("key"), decontaminate.text_hash(F.col("text")).alias("text_key"))
    assert sorted(map(repr, decontaminate.drop_documents(docs, bad).collect())) == ["Row(doc_id=1, text='c')", "Row(doc_id=2, text=None)"]


def test_separators_at_the_ends_and_case(spark):
    texts = ["", " ", "--", "a", " a", "a ", "--A--b--", "É-Z é", "\x00x\x7f", "Ab\u00a0Cd", "x" * 50_000 + " y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.key: r.terms for r in build_index(docs).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("terms")).collect()}
    for i, text in enumerate(texts):
        assert [(t.pos, t.term) for t in found.get(i, [])] == list(enumerate(words(text)))


def test_edge_rows(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "漢字"), (2, "other text"), (3, None)], "item_id long, text string")
    rows = found(edge_docs, items)
    assert len(rows) == edge_docs.count()
    assert sorted(r.ids for r in rows if r.ids) == [["1"], ["2"]]
    assert find_hits(no_docs, items).count() == 0
    assert all(r.hits == [] for r in find_hits(edge_docs, items.limit(0)).collect())


def test_items_without_an_id_are_found(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "x a b c y"), (3, "none")], "doc_id long, text string")
    items = [(None, "a b c"), (None, "two three"), (7, "a b c")]
    rows = found(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_hit, r.ids) for r in rows} == {1: (2, [""]), 2: (3, ["", "7"]), 3: (0, [])}


def test_words_near_each_other(spark):
    docs = spark.createDataFrame([(1, "red big house"), (2, "house x x x x red"), (3, "big red red house big"), (None, "house red"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, ["red", "house"]), (2, ["big", "red", "house"]), (3, ["red", "never"]), (4, ["x"])], "query long, terms array<string>")
    got = sorted((r.query, repr(r.key), r.pos) for r in proximity_matches(build_index(docs), queries, 2).collect())
    # "house" is rarer than "red", "big" rarer than both.
    assert got == [(1, "1", 2), (1, "3", 3), (1, "None", 0), (2, "1", 1), (2, "3", 4), *[(4, "2", i) for i in (1, 2, 3, 4)]]
