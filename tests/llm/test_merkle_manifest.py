import hashlib

import pytest
from pyspark.sql import functions as F

from markscale.llm import merkle_manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, fan):
    """The root and every leaf's path of (left, right), node by node."""
    paths, nodes = [[] for _ in leaves], [(leaf, [i]) for i, leaf in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for start in range(0, len(nodes), fan):
            run = nodes[start : start + fan]
            for k, (_, members) in enumerate(run):
                flanks = ("".join(n for n, _ in run[:k]), "".join(n for n, _ in run[k + 1 :]))
                for i in members:
                    paths[i].append(flanks)
            above.append((h("".join(n for n, _ in run)), [i for _, members in run for i in members]))
        nodes = above
    return nodes[0][0], paths


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute(rows, fan):
    """Per row (group, order, leaf): subroot, root and the digest of its proof."""
    groups = {}
    for i, (group, order, leaf) in enumerate(rows):
        groups.setdefault(group, []).append((order is not None, order, leaf, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: tree([leaf for _, _, leaf, _ in sorted(groups[g])], fan) for g in names}
    root, tops = tree([inner[g][0] for g in names], fan)
    found = [None] * len(rows)
    for g, top in zip(names, tops):
        for (_, _, _, i), path in zip(sorted(groups[g]), inner[g][1]):
            found[i] = (inner[g][0], root, h("".join(a + b for a, b in path + top)))
    return found


def run(spark, rows, fan, height):
    frame = spark.createDataFrame(rows, "source string, doc_id long, leaf string")
    found = merkle_manifest.manifest(frame, "source", "doc_id", "leaf", fan, height)
    return found.withColumns(
        {"proof": merkle_manifest.proof_digest(F.col("path")), "ok": merkle_manifest.verified(F.col("leaf"), F.col("path"), F.col("root"))}
    )


@pytest.mark.parametrize(("fan", "height"), [(3, 1), (3, 2), (2, 3), (5, 1), (3, 6)])
def test_trees_match_brute_force_in_blocks_of_any_size(spark, fan, height):
    sizes = {None: 1, "": 2, "a": 3, "é": 4, "Z": 9, "hot": 300, "z": 28}
    rows = [(g, i * 7 % 1000, h(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    found = run(spark, rows, fan, height).collect()
    expected = [(g, k, leaf, *more) for (g, k, leaf), more in zip(rows, brute(rows, fan))]
    assert sorted(((r.source, r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(r.ok for r in found)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [("a", k, h(str(v))) for k, v in [(None, 1), (None, 1), (1, 2), (1, 3), (1, 2), (2, 4), (2, 4)]] + [(None, None, h("x"))] * 4
    expected = brute(rows, 3)
    found = run(spark, rows, 3, 1).collect()
    assert sorted((r.subroot, r.root, r.proof) for r in found) == sorted(expected)


def test_a_lone_leaf_is_its_own_root(spark):
    (row,) = run(spark, [("a", 1, h("x"))], 3, 2).collect()
    assert (row.subroot, row.root, row.proof, row.ok) == (h("x"), h("x"), h(""), True)


def test_no_rows(spark):
    assert run(spark, [], 3, 2).count() == 0


def test_leaves_of_edge_rows(spark, edge_docs):
    names = ("doc_id", "source", "lang", "n_chars", "text")
    found = edge_docs.select(*names, merkle_manifest.leaf(*map(F.col, names)).alias("leaf")).collect()
    assert all(r.leaf == h("".join(field(r[c]) for c in names)) for r in found)


def test_edge_rows_with_clashing_columns(spark, edge_docs):
    names = ("doc_id", "source", "lang", "n_chars", "text")
    rows = edge_docs.select("doc_id", "source", merkle_manifest.leaf(*map(F.col, names)).alias("leaf"), F.lit(1).alias("place"))
    found = merkle_manifest.manifest(rows, "source", "doc_id", "leaf")
    given = [(r.source, r.doc_id, r.leaf) for r in rows.collect()]
    shown = found.select("subroot", "root", merkle_manifest.proof_digest(F.col("path")), "place").collect()
    assert sorted(tuple(r)[:3] for r in shown) == sorted(brute(given, 3)) and {r.place for r in shown} == {1}


def test_tampering_is_noticed(spark):
    rows = [("a", i, h(str(i))) for i in range(40)]
    found = run(spark, rows, 3, 2)
    changed = found.withColumn("leaf", F.when(F.col("doc_id") == 7, F.lit(h("other"))).otherwise(F.col("leaf")))
    bad = changed.where(~merkle_manifest.verified(F.col("leaf"), F.col("path"), F.col("root")))
    assert [r.doc_id for r in bad.collect()] == [7]
