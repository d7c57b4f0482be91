"""Alignment of two tokenizers over every text, as Arrow tables inside the tasks and Spark joins between them.

Texts are cut into blocks of about ``BLOCK_BYTES``, and these into pieces of about ``PIECE_BYTES``. In a piece both
tokenizers encode every text; the token lists are flattened with their parent indices, token bytes are summed up per
document, and the two tables of token ends meet in one full outer hash join on (document, end). Between two
neighbouring ends lies exactly one pair of overlapping tokens, a link; ends of both sides cut the text into groups.
Links are counted per document and per block with ``Table.group_by``. A block keeps only the counts of its earlier
pieces, and texts come to a task in batches of half a piece, so a task's memory does not grow with the input.

Spark merges the partial counts of all blocks by pair. A block then asks for the count of each of its
distinct pairs once, so what is shuffled is one small row per pair and block, never a row per link. A pair that
is in every block is one row per block and is spread by the join like any other key.

- A text that is NULL or empty, or whose tokens do not spell " " + text (an encoder that normalises, say), has no
  tokens: all counts are 0 and ``groups`` is empty. The space is B's own; A gets it written out.
- Special tokens' strings inside of a text are plain text.
- A text of any length is encoded whole; one longer than ``PIECE_BYTES`` is a piece of its own, one longer than
  ``BLOCK_BYTES`` a block. A block has at most ``BLOCK_ROWS`` rows.
- Rows alike, or alike in key, each have their own result and each count. A NULL key is a key. An empty table gives no rows.
- Other columns do not pass through; their names may be anything.

The vocabulary files are read by the tasks, from a path that every executor has.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markscale.session import materialise

BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 10_000
PIECE_BYTES = 256 << 10
#: Spark's bound for the bytes of a batch that goes to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A pair of ids is one number: the id of A times this, plus the id of B.
PAIR = 1 << 31
#: The sign of a space in pieces, and the pattern that splits a text before byte-level merges.
PIECE_SPACE = "▁"
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Vocabularies:
    """Paths of a byte-level BPE (tokenizers JSON) and of a sentencepiece model, on every executor."""

    byte_level: str = "/opt/tokenizers/byte_bpe_50k.json"
    pieces: str = "/opt/tokenizers/piece_bpe_32k.model"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A: the ranks of the vocabulary in tiktoken's encoder, which gives the ids of the file's merges."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_letters()
        special = {token["content"] for token in model["added_tokens"] if token["special"]}
        vocabulary = {token: i for token, i in model["model"]["vocab"].items() if token not in special}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
        self.path, self.spare = path, None
        self.encoder = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.encoder.encode_to_numpy(text).astype(np.int64)
        except BaseException as failure:  # the pattern's engine gives up on very long runs of white space
            if isinstance(failure, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.by_merges(text)

    def by_merges(self, text: str) -> np.ndarray:
        """The same ids from the file's own library, which is slower."""
        if self.spare is None:
            from tokenizers import Tokenizer

            self.spare = Tokenizer.from_file(self.path)
            self.spare.encode_special_tokens = True
        return np.array(self.spare.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        return lists_of([self.encode(" " + text) for text in texts])


class Pieces:
    """B: a sentencepiece model; it puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.tokens = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(PIECE_SPACE, " ").encode()
            for i, piece in ((i, self.model.id_to_piece(i)) for i in ids)
        ]

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        return lists_of([np.array(ids, dtype=np.int64) for ids in self.model.encode(texts, num_threads=1)])


def lists_of(arrays: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64)))
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, pa.int64()))


class Side:
    """The token bytes of one vocabulary, and its ids as text followed by each of some separators."""

    def __init__(self, tokens: list[bytes], separators: str):
        self.bytes = pa.array(tokens, pa.large_binary())
        self.sizes = pa.array([len(t) for t in tokens], pa.int64())
        self.shown = pa.array((f"{i}{s}" for s in [*separators, ""] for i in range(len(tokens))), pa.large_binary())
        self.count = len(tokens)


class Aligner:
    def __init__(self, vocabularies: Vocabularies):
        self.a, self.b = ByteLevel(vocabularies.byte_level), Pieces(vocabularies.pieces)
        self.side_a, self.side_b = Side(self.a.tokens, ",|"), Side(self.b.tokens, ",;")
        self.shown = pa.concat_arrays([self.side_a.shown, self.side_b.shown])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Which texts both sides spell exactly, and the token lists of those."""
        full = np.array([bool(t) for t in texts], dtype=bool)
        sources = [texts[i] for i in np.flatnonzero(full)]
        a, b = self.a.encode_all(sources), self.b.encode_all(sources)
        plain = [b" " + t.encode() for t in sources]
        same = spells(a, self.side_a, plain) & spells(b, self.side_b, plain)
        full[np.flatnonzero(full)[~same]] = False
        return full, a.filter(pa.array(same)), b.filter(pa.array(same))

    def links(self, a: pa.Array, b: pa.Array) -> pa.Table:
        """A row per link in order of its end: ``key`` (document << 32 | end), ``a``, ``b``, ``cut``."""
        left = pa.table({"key": end_keys(a, self.side_a), "a": a.flatten()})
        right = pa.table({"key": end_keys(b, self.side_b), "b": b.flatten()})
        met = left.join(right, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
        cut = pc.and_(pc.is_valid(met["a"]), pc.is_valid(met["b"]))
        # A token covers all ends up to its own; a document's last end is one of both sides.
        return pa.table(
            {"key": met["key"], "a": pc.fill_null_backward(met["a"]), "b": pc.fill_null_backward(met["b"]), "cut": cut}
        )

    def groups(self, a: pa.Array, b: pa.Array, links: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The group of every token, counted through the block."""
        cuts = links["key"].filter(links["cut"]).to_numpy()
        return tuple(
            np.searchsorted(cuts, end_keys(ids, side).to_numpy()) for ids, side in ((a, self.side_a), (b, self.side_b))
        )

    def group_digests(self, a: pa.Array, b: pa.Array, links: pa.Table) -> list[str]:
        """Per document the SHA-256 of ``a1,a2|b1;a3|b2,b3``, from one flat table of shown ids."""
        in_a, in_b = self.groups(a, b, links)
        more_a, more_b = np.diff(in_a, append=-1) == 0, np.diff(in_b, append=-1) == 0
        last = np.zeros(len(in_b), dtype=bool)
        last[np.cumsum(pc.list_value_length(b).to_numpy()) - 1] = True
        # A group shows its tokens of A, then those of B.
        code = np.empty(len(in_a) + len(in_b), dtype=np.int64)
        at_a = np.arange(len(in_a)) + np.searchsorted(in_b, in_a, "left")
        at_b = np.arange(len(in_b)) + np.searchsorted(in_a, in_b, "right")
        code[at_a] = a.flatten().to_numpy() + self.side_a.count * np.where(more_a, 0, 1)
        code[at_b] = len(self.side_a.shown) + b.flatten().to_numpy() + self.side_b.count * np.where(more_b, 0, np.where(last, 2, 1))
        flat = self.shown.take(pa.array(code))
        spots = np.frombuffer(flat.buffers()[1], dtype=np.int64)
        data = memoryview(flat.buffers()[2]) if len(code) else memoryview(b"")
        stops = np.concatenate(([0], np.cumsum(pc.list_value_length(a).to_numpy() + pc.list_value_length(b).to_numpy())))
        return [hashlib.sha256(data[spots[i] : spots[j]]).hexdigest() for i, j in zip(stops[:-1], stops[1:])]


def spells(ids: pa.Array, side: Side, plain: list[bytes]) -> np.ndarray:
    """Which token lists join to the given bytes."""
    wanted = np.array([len(p) for p in plain], dtype=np.int64)
    size = segment_sums(ids, side.sizes)
    same = size == wanted
    for i in np.flatnonzero(same):
        tokens = side.bytes.take(ids[i].values)
        same[i] = tokens.buffers()[2].to_pybytes()[: wanted[i]] == plain[i] if wanted[i] else True
    return same


def segment_sums(ids: pa.Array, sizes: pa.Array) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(sizes.take(ids.flatten()).to_numpy())))
    stops = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy())))
    return total[stops[1:]] - total[stops[:-1]]


def end_keys(ids: pa.Array, side: Side) -> pa.Array:
    """The end of every token in bytes of its document, below the document's number."""
    owner = pc.list_parent_indices(ids).cast(pa.int64())
    running = pc.cumulative_sum(side.sizes.take(ids.flatten()))
    before = np.cumsum(np.concatenate(([0], segment_sums(ids, side.sizes))))[:-1]
    end = pc.subtract(running, pa.array(before, pa.int64()).take(owner))
    return pc.add(pc.shift_left(owner, pa.scalar(32, pa.int64())), end)


def blocks_of(batch: pa.RecordBatch, text: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``size`` bytes of text, or of one row."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy().astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Texts of jobs that run meanwhile go to Python in batches of about ``size`` bytes."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def encode_blocks(docs: DataFrame, key: str, text: str, vocabularies: Vocabularies, block_bytes: int) -> DataFrame:
    """A row per block: its documents, its distinct pairs with their counts, and the pairs of each document in turn."""
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"block long, docs array<struct<key:{kind},n_a:long,n_b:long,n_groups:long,n_links:long,groups:string>>, "
        "pairs array<long>, counts array<long>, held array<int>, pair_of array<int>, times array<int>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, first = Aligner(vocabularies), TaskContext.get().partitionId() << 32
        for number, parts in enumerate(blocks_of_parts(aligner, batches, block_bytes)):
            yield block_row(parts, first + number)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def blocks_of_parts(aligner: Aligner, batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[list[tuple[pa.StructArray, pa.Table]]]:
    """The counted pieces of each block; a block goes on through the batches, up to half a piece beyond its size."""
    piece_bytes = min(PIECE_BYTES, block_bytes)
    parts, size, rows = [], 0, 0
    for batch in batches:
        for piece in blocks_of(batch, 1, piece_bytes):
            own = (pc.sum(pc.binary_length(piece.column(1))).as_py() or 0) + piece.num_rows
            if parts and (size + own > block_bytes + piece_bytes // 2 or rows + piece.num_rows > BLOCK_ROWS):
                yield parts
                parts, size, rows = [], 0, 0
            parts.append(count_piece(aligner, piece, 1))
            size, rows = size + own, rows + piece.num_rows
    if parts:
        yield parts


def count_piece(aligner: Aligner, rows: pa.RecordBatch, text: int) -> tuple[pa.StructArray, pa.Table]:
    """The documents of a piece, and how many links of each (``doc``, its place) hold each ``pair``."""
    full, a, b = aligner.encode(rows.column(text).to_pylist())
    links = aligner.links(a, b)
    owner = np.right_shift(links["key"].to_numpy(), 32)
    linked = pa.table({"doc": owner, "pair": pc.add(pc.multiply(links["a"], PAIR), links["b"])})
    per_doc = linked.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    places = np.flatnonzero(full)

    def spread(values) -> pa.Array:
        out = np.zeros(len(full), dtype=np.int64)
        out[places] = values
        return pa.array(out)

    digests = np.full(len(full), "", dtype=object)
    digests[places] = aligner.group_digests(a, b, links)
    docs = pa.StructArray.from_arrays(
        [
            rows.column(0),
            spread(pc.list_value_length(a).to_numpy()),
            spread(pc.list_value_length(b).to_numpy()),
            spread(np.bincount(owner, weights=links["cut"].to_numpy(), minlength=len(places))),
            spread(np.bincount(owner, minlength=len(places))),
            pa.array(digests, pa.string()),
        ],
        ["key", "n_a", "n_b", "n_groups", "n_links", "groups"],
    )
    times = pc.cast(per_doc["count_all"], pa.int32())
    return docs, pa.table({"doc": places[per_doc["doc"].to_numpy()], "pair": per_doc["pair"], "times": times})


def block_row(parts: list[tuple[pa.StructArray, pa.Table]], number: int) -> pa.RecordBatch:
    stops = np.cumsum([len(docs) for docs, _ in parts])
    shifted = [t.set_column(0, "doc", pc.add(t["doc"], int(stop) - len(docs))) for (docs, t), stop in zip(parts, stops)]
    per_doc = pa.concat_tables(shifted).sort_by("doc").combine_chunks()
    in_all = per_doc.group_by("pair", use_threads=False).aggregate([("times", "sum")]).sort_by("pair")
    pairs = in_all["pair"].to_numpy()
    columns = {
        "docs": pa.concat_arrays([docs for docs, _ in parts]),
        "pairs": pa.array(pairs),
        "counts": in_all["times_sum"].combine_chunks().cast(pa.int64()),
        "held": pa.array(np.bincount(per_doc["doc"].to_numpy(), minlength=stops[-1]).astype(np.int32)),
        "pair_of": pa.array(np.searchsorted(pairs, per_doc["pair"].to_numpy()).astype(np.int32)),
        "times": per_doc["times"].combine_chunks(),
    }
    one_row = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *one_row], ["block", *columns])


def link_counts(blocks: DataFrame) -> DataFrame:
    """``pair``, ``n``, ``best``: how many links hold a pair, and whether no pair of the same id of B is held by more."""
    partial = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counts = partial.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    counts = materialise(counts.withColumn("b", F.col("pair") % PAIR), "pair-counts")
    # At most one row per id of A meets under an id of B.
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_blocks(blocks: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Per document its own numbers, ``n_best`` and ``count_sum``."""
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(counts, "pair").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("place", "n", "best"))).alias("told")
    )
    rows = blocks.select("block", "docs", "held", "pair_of", "times").join(told, "block", "left")
    rows = rows.select("docs", "held", "pair_of", "times", F.col("told.n").alias("n"), F.col("told.best").alias("best"))
    schema = f"{blocks.schema['docs'].dataType.elementType.simpleString()[7:-1]},n_best:long,count_sum:long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, held, pair_of, times, n, best = (column[i].values for column in batch.columns)
                sums = {"n_best": np.zeros(len(docs), np.int64), "count_sum": np.zeros(len(docs), np.int64)}
                if len(pair_of):
                    own = np.repeat(np.arange(len(docs)), held.to_numpy())
                    place, weight = pair_of.to_numpy(), times.to_numpy()
                    np.add.at(sums["n_best"], own, weight * best.to_numpy(zero_copy_only=False)[place])
                    np.add.at(sums["count_sum"], own, weight * n.to_numpy()[place])
                names = [field.name for field in docs.type]
                yield pa.RecordBatch.from_arrays([*docs.flatten(), *map(pa.array, sums.values())], [*names, *sums])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def align(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    vocabularies: Vocabularies = Vocabularies(), block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Per document ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (digest), ``n_best``, ``count_sum``;
    and the corpus' ``pair``, ``n``, ``best``. Encodes and counts when it is called."""
    with small_batches(docs.sparkSession, PIECE_BYTES // 2):
        blocks = materialise(encode_blocks(docs, key, text, vocabularies, block_bytes), "token-blocks")
    counts = materialise(link_counts(blocks), "link-counts")
    return score_blocks(blocks, counts, key), counts


def token_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabularies: Vocabularies = Vocabularies()
) -> DataFrame:
    """The alignment itself: per document the ids of both sides and the group of each token, from 0."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, a array<long>, b array<long>, a_group array<long>, b_group array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabularies)
        for batch in batches:
            for rows in blocks_of(batch, 1, BLOCK_BYTES):
                full, a, b = aligner.encode(rows.column(1).to_pylist())
                links = aligner.links(a, b)
                parts = []
                for ids, group in zip((a, b), aligner.groups(a, b, links)):
                    owner = pc.list_parent_indices(ids).to_numpy()
                    firsts = group[np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy())))[:-1]] if len(ids) else group
                    parts.append(pa.array(group - (firsts[owner] if len(ids) else 0)))
                size_of = lambda ids: spread_sizes(full, pc.list_value_length(ids).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        *(pa.ListArray.from_arrays(size_of(ids), ids.flatten()) for ids in (a, b)),
                        *(pa.ListArray.from_arrays(size_of(ids), part) for ids, part in zip((a, b), parts)),
                    ],
                    ["key", "a", "b", "a_group", "b_group"],
                )

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def spread_sizes(full: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """List offsets for all rows, where only those of ``full`` have elements."""
    out = np.zeros(len(full) + 1, dtype=np.int32)
    out[1:][full] = sizes
    return pa.array(np.cumsum(out, dtype=np.int32))
