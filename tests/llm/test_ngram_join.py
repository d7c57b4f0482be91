import random

import pytest
from pyspark.sql import functions as F

from brute import classes, prose
from markscale.llm import ngram_join
from markscale.llm.ngram_join import components, linked_pairs, one_of_each, runs_for, similarity_classes
from markscale.llm.queries import ngram_join_query


def check(got, rows):
    """``got`` against brute force over ``rows`` of distinct ids."""
    ids = [r[0] for r in rows]
    first, links = classes([r[1] for r in rows])
    smallest = {}
    for i, c in enumerate(first):
        smallest[c] = min(smallest.get(c, ids[i]), ids[i])
    want = {ids[i]: (smallest[c], links[i]) for i, c in enumerate(first)}
    assert {r.key: (r.class_id, r.n_links) for r in got} == want


def edited(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("leaf,block", [(128, 128), (4, 3)])
def test_against_brute_force(spark, monkeypatch, leaf, block):
    """Groups of near copies, shared passages and short texts; small limits drive the splits and blocks."""
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(3)
    texts = [edited(prose(seed, 120, 10**6), rng, rng.randrange(5)) for seed in (1, 2, 3) for _ in range(25)]
    passage = prose(9, 60, 10**6)
    texts += [f"{prose(100 + i, 80, 10**6)} {passage} {prose(200 + i, 60, 10**6)}" for i in range(30)]
    texts += ["one", "One!", "two words", "two, words", "a b c d", "a b c d e", "a b c d e f", "é É", "é  É."]
    texts += [texts[0]] * 5 + [texts[0].upper(), texts[0].replace(" ", ", ")]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    check(similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_given_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = ngram_join_query(spark, sf_dir).withColumnRenamed("doc_id", "key").collect()
    check(got, rows)


def test_edge_rows(edge_docs, no_docs):
    clashing = edge_docs.withColumn("digest", F.lit("x")).withColumn("size", F.lit("y"))
    got = similarity_classes(clashing).collect()
    assert len(got) == edge_docs.count()
    alone = [r for r in got if r.class_key is None]
    assert len(alone) == 5 and all(r.n_links == 0 and r.class_id == r.key for r in alone)
    assert {r.class_id for r in got if r.key in (1, 2)} == {1}
    # NULL id and id 8 are near copies
    assert [r.class_id for r in got if r.key is None and r.class_key] == [8]
    kept = one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [1, 3, 4, 5, 6, 7, None, 8, 9, 9]))
    assert similarity_classes(no_docs).count() == 0 and one_of_each(no_docs).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("s0", f"s{i}") for i in range(1, 50)]
    edges += [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [("r1", "r1")]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {n: {"c": "c000", "s": "s0", "r": "r0"}[n[0]] for e in edges for n in e}


def test_runs_grow_with_recall():
    assert runs_for(0.9, 0.8) < runs_for(0.99999, 0.8) <= 12


def test_signatures_that_a_pair_may_have_are_linked(spark):
    """Linked by as few matching coordinates as pairs at the threshold have once in 100,000."""
    import math

    import numpy as np

    n = ngram_join.COORDINATES
    below = np.cumsum([math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(n + 1)])
    fewest = int(np.searchsorted(below, 1e-5))
    a = np.arange(n, dtype=np.uint32)
    b = np.where(a < fewest, a, a + n).astype(np.uint32)
    sets = spark.createDataFrame([(1, a.tobytes()), (2, b.tobytes())], "sid long, signature binary")
    leaves = spark.createDataFrame([(7, 1), (7, 2)], "path long, sid long")
    assert len(ngram_join.signature_links(leaves, sets, 0.8).collect()) == 1


def test_recall_holds_at_any_depth():
    """Pairs of random signatures, split to depth 20 as chosen paths are: the share lost below a root is as reckoned."""
    rng, pool, trials = random.Random(5), 54, 4000
    lost = reckoned = 0
    for _ in range(trials):
        same = [rng.random() < 0.8 for _ in range(pool)]
        nodes = 1
        for _ in range(20):
            if nodes > 50:
                break
            nodes = sum(same[c] for _ in range(nodes) for c in rng.sample(range(pool), ngram_join.CHILDREN))
        lost += nodes == 0
        reckoned += ngram_join.lost_below(sum(same), pool)
    assert abs(lost - reckoned) / trials < 0.02 and 0.05 < lost / trials < 0.1
    assert ngram_join.path_miss(runs_for(0.99999, 0.8), 0.8) <= 5e-6


def test_threshold_is_exact():
    import numpy as np

    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)  # 8 of 10
    assert linked_pairs([a, b], None, 800_000, 1_000_000)[0].tolist() == [0]
    assert linked_pairs([a, b], None, 800_001, 1_000_000)[0].tolist() == []
