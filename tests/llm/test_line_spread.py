import random
from collections import defaultdict

from pyspark.sql import functions as F

from markscale.llm.line_spread import boilerplate_lines, remove_boilerplate, site_sketches


def cleaned(rows, min_sites):
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if site is not None and line.strip():
                sites[line].add(site)
    gone = {line for line, s in sites.items() if len(s) >= min_sites}
    return sorted(repr((k, None if t is None else "\n".join(x for x in t.split("\n") if x not in gone))) for k, t, _ in rows)


def test_lines_of_many_sites_go(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        lines = [f"line {rng.randrange(30) ** 2}" if rng.random() < 0.7 else rng.choice(["", " ", f"own {i}", "é " * 30]) for _ in range(8)]
        rows.append((i, "\n".join(lines), f"s{int(rng.random() ** 3 * 40)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for min_sites in (2, 10, 25):
        got = sorted(repr((r.doc_id, r.text)) for r in remove_boilerplate(df, min_sites=min_sites).collect())
        assert got == cleaned(rows, min_sites)


def test_estimates_beyond_the_exact_sizes_of_a_sketch(spark):
    sites = spark.range(30_000).select(F.concat(F.lit("s"), "id").alias("source"), F.lit("many\nboth").alias("text"))
    few = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("source"), F.lit("fewer").alias("text"))
    both = sites.unionByName(few)
    assert boilerplate_lines(both, min_sites=25_000).count() == 2
    assert boilerplate_lines(both, min_sites=30_000).count() == 2  # exact counts decide here
    assert boilerplate_lines(both, min_sites=30_001).count() == 0
    assert site_sketches(both).count() == 3


def test_edge_rows(edge_docs, no_docs):
    clashing = edge_docs.withColumn("n_lines", F.lit("x")).withColumn("line", F.lit("y"))
    got = remove_boilerplate(clashing, min_sites=2)
    assert got.columns == clashing.columns + ["n_removed"]
    rows = [(r.doc_id, r.text, r.source) for r in edge_docs.collect()]
    assert sorted(repr((r.doc_id, r.text)) for r in got.collect()) == cleaned(rows, 2)
    assert remove_boilerplate(no_docs).count() == 0
