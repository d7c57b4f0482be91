from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from markscale.llm.mixing import mix_sources, repeat_documents, source_targets


def water_filling(sizes, weights, most=3):
    """Targets by repeated sharing, as plain Python."""
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        weight = sum(weights[s] for s in free)
        left = total - sum(capped.values())
        shares = {s: left * weights[s] / weight for s in free}
        over = [s for s in free if shares[s] > most * sizes[s]]
        if not over:
            return {**capped, **shares}
        capped.update({s: most * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [[100, 5, 1000, 3, 0, 40], [7], [1, 1, 1000], [10, 20, 30, 40, 50, 60, 1, 2]])
def test_targets_share_what_capped_sources_leave(spark, sizes):
    rows = [(i + 1, n, i % 3 + 1) for i, n in enumerate(sizes)]
    got = {r.sid: r.target for r in source_targets(spark.createDataFrame(rows, "sid int, source_size long, weight int")).collect()}
    want = water_filling({r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows})
    assert got == pytest.approx(want)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_every_source_gets_its_words_evenly(spark, block):
    rows = [(i, " ".join(["w"] * (i * 7 % 40)), "abc"[min(2, i % 7)]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mix_sources(docs, block_tokens=block)
    taken = mix.taken().join(mix.sources.drop("source"), "sid").collect()
    assert len(taken) == 200
    sums, targets = defaultdict(int), {}
    for r in taken:
        sums[r.sid] += r.taken
        targets[r.sid] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(sums[s] - targets[s]) <= 0.5 for s in sums)
    slots = sorted(mix.schedule.collect(), key=lambda r: r.position)
    assert len({r.position for r in slots}) == len(slots)
    # Low discrepancy: in every stretch of the schedule each source has about its share.
    need = {s: sum(r.sid == s for r in slots) for s in sums}
    for end in range(1, len(slots) + 1, max(1, len(slots) // 20)):
        for s, n in need.items():
            assert abs(sum(r.sid == s for r in slots[:end]) - end * n / len(slots)) <= 8


def test_pieces_tile_the_blocks(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), None if i % 2 else "s") for i in range(60)]
    mix = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_tokens=10)
    words = {r.position: r.words for r in mix.schedule.collect()}
    got = defaultdict(int)
    for r in mix.pieces().collect():
        assert 0 <= r.from_word < r.to_word
        got[r.position] += r.to_word - r.from_word
    assert got == words


def test_edge_rows(edge_docs, no_docs):
    clashing = edge_docs.withColumn("size", F.lit("x")).withColumn("start", F.lit("y"))
    mix = mix_sources(clashing)
    rows = mix.taken().collect()
    assert len(rows) == edge_docs.count()
    assert sum(r.taken for r in rows) == pytest.approx(sum(r.target for r in mix.sources.collect()), abs=3)
    assert all(r.taken == 0 for r in rows if not r.size)
    assert set(repeat_documents(clashing, mix).columns) == set(clashing.columns)
    assert mix_sources(no_docs).taken().count() == 0
    assert mix_sources(edge_docs.where("text is null or text = ''")).taken().count() == 4


def test_reruns_agree(edge_docs):
    first, second = (sorted(map(repr, mix_sources(edge_docs).taken().collect())) for _ in range(2))
    assert first == second


def test_shared_and_missing_ids_keep_each_source_at_its_target(spark):
    rows = [(i % 50 if i % 5 else None, source, f"{source} {i} " + "w " * (i % 9)) for source in ("a", "b", None) for i in range(300)]
    rows += [(1, "a", "alike in all columns")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = mix_sources(docs, block_tokens=16)
    got = repeat_documents(docs, mix).collect()
    size = lambda text: len(text.split())
    for s in mix.sources.collect():
        words = sum(size(r.text) for r in got if r.source == s.source)
        assert abs(words - s.target) <= 0.03 * s.target
    times = {}
    for r in got:
        times[r.source, r.text] = times.get((r.source, r.text), 0) + 1
    # No document more than three times; seven rows alike at most three times seven.
    assert max(n for (_, text), n in times.items() if text != "alike in all columns") <= 3
    assert times.get(("a", "alike in all columns"), 0) <= 21
