import hashlib
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from markscale.llm import token_alignment
from markscale.llm.queries import QUERIES

VOCABULARIES = token_alignment.Vocabularies()
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARIES.byte_level), reason="no vocabularies")

ODD = ["▁ is no space", "<s> </s> <unk> <|endoftext|>", "  two  blanks \n\n\t", "漢字 \x00 é ß 😀", "x", " ", "a" * 3000, " " * 3000 + "b"]


def encoders():
    """Token (id, bytes) lists of both sides by the vocabularies' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(VOCABULARIES.byte_level), sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES.pieces)
    a.encode_special_tokens = True
    letters = token_alignment.byte_letters()

    def of_a(text):
        found = a.encode(" " + text, add_special_tokens=False)
        return [(i, bytes(letters[c] for c in t)) for i, t in zip(found.ids, found.tokens)]

    def of_b(text):
        def spelled(i):
            return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

        return [(i, spelled(i)) for i in b.encode(text)]

    return of_a, of_b


def brute(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every text, from explicit byte ranges."""
    of_a, of_b = encoders()
    rows, links = [], []
    for text in texts:
        a, b = (of_a(text), of_b(text)) if text else ([], [])
        plain = b" " + (text or "").encode()
        if b"".join(t for _, t in a) != plain or b"".join(t for _, t in b) != plain:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links.append([(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e])
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low < e <= cut) for side in spans))
            low = cut
        shown = ";".join(groups)
        rows.append((len(a), len(b), len(groups), hashlib.sha256(shown.encode()).hexdigest() if a else ""))
    held = Counter(pair for own in links for pair in own)
    best = {}
    for (_, j), n in held.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (na, nb, ng, len(own), sum(held[p] == best[p[1]] for p in own), sum(held[p] for p in own), sha)
        for (na, nb, ng, sha), own in zip(rows, links)
    ]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def check(rows, scored, digest="groups", key="doc_id"):
    expected = [(k, *values) for (k, _), values in zip(rows, brute([t for _, t in rows]))]
    found = [tuple(r) for r in scored.select(key, *NAMES, digest).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_the_registered_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    kept = [(r.doc_id, r.text if len(r.text or "") < 4000 else None) for r in docs]
    # Brute force over all pairs of tokens is for short texts; the long ones are compared by their counts of tokens.
    frame = spark.createDataFrame(kept, "doc_id long, text string")
    check(kept, token_alignment.align(frame)[0])
    of_a, of_b = encoders()
    whole = {r.doc_id: r for r in QUERIES["op11_token_alignment"](spark, sf_dir).collect()}
    assert len(whole) == len(docs)
    assert all((whole[r.doc_id].n_a, whole[r.doc_id].n_b) == (len(of_a(r.text)), len(of_b(r.text))) for r in docs if r.text)
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups and 0 <= r.n_best <= r.n_links for r in whole.values())


def test_odd_texts_in_small_blocks(spark):
    rows = [*enumerate(ODD), (1, None), (1, ""), (None, "x"), (None, None), (3, ODD[3]), (20, "plain words, plain words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("a clash"))
    check(rows, token_alignment.align(frame, block_bytes=64)[0])


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    short = [(k, None if t and len(t) > 9000 else t) for k, t in rows]
    check(short, token_alignment.align(spark.createDataFrame(short, "doc_id long, text string"))[0])
    assert token_alignment.align(edge_docs)[0].count() == len(rows)
    assert token_alignment.align(no_docs)[0].count() == 0


def test_a_text_key(spark):
    rows = [("é", "some words"), (None, "more")]
    check(rows, token_alignment.align(spark.createDataFrame(rows, "name string, body string"), "name", "body")[0], key="name")


def test_the_counts_of_pairs(spark):
    rows = [(1, "the cat"), (2, "the cat the"), (3, None)]
    _, counts = token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))
    of_a, of_b = encoders()
    (a, _), (b, _) = of_a("the")[0], of_b("the")[0]
    assert counts.where(F.col("pair") == a * token_alignment.PAIR + b).select("n", "best").collect() == [(3, True)]


def test_groups_of_tokens(spark):
    rows = [(1, ODD[3] + " words"), (2, None), (3, ODD[0]), (4, "one two")]
    found = {r.doc_id: r for r in token_alignment.token_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, text in rows:
        r = found[key]
        shown = ";".join(
            "|".join(",".join(str(i) for i, at in zip(ids, groups) if at == g) for ids, groups in ((r.a, r.a_group), (r.b, r.b_group)))
            for g in range(max(r.a_group, default=-1) + 1)
        )
        (expected,) = brute([text])
        assert (hashlib.sha256(shown.encode()).hexdigest() if shown else "") == expected[-1]


def test_both_encoders_of_a_give_the_same_ids():
    side = token_alignment.ByteLevel(VOCABULARIES.byte_level)
    for text in [*ODD, " " * 200_000 + "x", "\n \t" * 50_000]:
        assert (side.encode(text) == side.by_merges(text)).all()


def test_a_task_holds_a_piece_of_texts_at_a_time(spark, tmp_path, monkeypatch):
    asked, came = tmp_path / "asked", tmp_path / "came"
    encoder, cut = token_alignment.Aligner, token_alignment.blocks_of

    class Watched(encoder):
        def encode(self, texts):
            with open(asked, "a") as file:
                file.write(f"{sum(len(t or '') for t in texts)}\n")
            return encoder.encode(self, texts)

    def watched(batch, text, size):
        with open(came, "a") as file:
            file.write(f"{batch.nbytes}\n")
        return cut(batch, text, size)

    monkeypatch.setattr(token_alignment, "Aligner", Watched)
    monkeypatch.setattr(token_alignment, "blocks_of", watched)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    rows = [(i, f"{i} some words of a text " * 40) for i in range(4_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in token_alignment.align(frame)[0].collect()}
    assert spark.conf.get(setting) == before
    sizes = [int(n) for n in asked.read_text().split()]
    assert sum(sizes) == sum(len(t) for _, t in rows) and max(sizes) <= 256 << 10
    assert max(int(n) for n in came.read_text().split()) <= 512 << 10
    assert len(found) == len(rows) and all(r.n_links == r.n_a + r.n_b - r.n_groups > 0 for r in found.values())


def test_blocks_go_on_through_batches(monkeypatch):
    import pyarrow as pa

    def batch(texts):
        return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["key", "text"])

    def blocks(batches, block_bytes):
        parts = token_alignment.blocks_of_parts(aligner, batches, block_bytes)
        return [token_alignment.block_row(p, n) for n, p in enumerate(parts)]

    aligner = token_alignment.Aligner(VOCABULARIES)
    words = ["some words", None, "", "more words of a text"] * 5
    whole, = blocks([batch(words)], 1 << 20)
    dealt, = blocks([batch(words[i : i + 3]) for i in range(0, len(words), 3)], 1 << 20)
    for name in ("pairs", "counts", "held"):
        assert whole.column(name).to_pylist() == dealt.column(name).to_pylist()
    # A long text is a block of its own; rows without text are bounded by their number.
    long = blocks([batch(["x", "a b " * 100, "y"])], 64)
    assert [len(b.column("docs")[0]) for b in long] == [1, 1, 1]
    monkeypatch.setattr(token_alignment, "BLOCK_ROWS", 4)
    assert [len(b.column("docs")[0]) for b in blocks([batch([None, ""])] * 5, 1 << 20)] == [4, 4, 2]
