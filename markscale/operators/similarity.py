"""Similarity of an answer to its reference text: chunk, encode, mean cosine over all chunk pairs.

The mean over all pairs is computed as the dot product of the two mean unit vectors. In the row
form nothing is shuffled; with ``score_distinct`` a text that many rows share is encoded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscale.functions.chunks import sentence_chunks
from markscale.functions.records import pieces
from markscale.functions.vectors import dot
from markscale.operators.skew import lookup_join
from markscale.session import materialise

# An encoder is opened once per task: ``encoder()`` returns a function from a flat array of chunks
# to a matrix with one row per chunk.
Encoder = Callable[[], Callable[[pa.Array], np.ndarray]]
Chunker = Callable[[Column], Column]

#: Chunks that an encoder gets at once, and their bytes; a longer chunk is alone.
CHUNKS_PER_CALL, BYTES_PER_CALL = 8192, 4 << 20
#: Bytes that the letter encoder looks up at once.
LETTER_BYTES = 1 << 20


def letter_encoder() -> Callable[[pa.Array], np.ndarray]:
    """Embed a chunk as its counts of the letters a to z, with one pass over the text buffer, block by block."""
    codes = np.full(256, -1, dtype=np.int64)
    codes[ord("a") : ord("z") + 1] = np.arange(26)

    def encode(chunks: pa.Array) -> np.ndarray:
        chunks = chunks.cast(pa.large_string())
        at, size = chunks.offset, len(chunks)
        offsets = np.frombuffer(chunks.buffers()[1], dtype=np.int64)[at : at + size + 1]
        text = np.frombuffer(chunks.buffers()[2], dtype=np.uint8)
        counts = np.zeros(size * 26, dtype=np.int64)
        for start in range(offsets[0], offsets[-1], LETTER_BYTES):
            end = min(start + LETTER_BYTES, offsets[-1])
            code = codes[text[start:end]]
            owner = np.repeat(np.arange(size), np.diff(np.clip(offsets, start, end)))
            letters = code >= 0
            counts += np.bincount(owner[letters] * 26 + code[letters], minlength=size * 26)
        return counts.reshape(size, 26)

    return encode


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Encoder:
    """An encoder around a sentence model; ``load()`` returns its ``encode(list of strings)``."""

    def encoder():
        encode = load()
        return lambda chunks: np.asarray(encode(chunks.to_pylist()))

    return encoder


def _mean_units(encode, chunks: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Mean unit vector of every chunk list, and which lists have any chunk.

    Chunks go to the model a bounded number at a time, whatever the length of their text.
    """
    sizes = chunks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = chunks.flatten()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.zeros((len(sizes), 0))
    at = 0
    for piece in pieces(flat, CHUNKS_PER_CALL, BYTES_PER_CALL):
        rows = np.asarray(encode(piece), dtype=np.float64)
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = rows / np.where(norms == 0, 1.0, norms)
        owners = owner[at : at + len(piece)]
        at += len(piece)
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        if sums.shape[1] == 0:
            sums = np.zeros((len(sizes), rows.shape[1]))
        sums[owners[starts]] += np.add.reduceat(rows, starts, axis=0)
    return sums / np.maximum(sizes, 1)[:, None], sizes > 0


def _pair_scores(encoder: Encoder) -> Callable[..., Column]:
    def compare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encode = encoder()
        for answers, references in batches:
            a, a_known = _mean_units(encode, answers)
            b, b_known = _mean_units(encode, references)
            known = a_known & b_known
            if not known.any():
                yield pa.nulls(len(known), pa.float64())
            else:
                yield pa.array(np.einsum("ij,ij->i", a, b), mask=~known)

    # Declared non-deterministic, so that a filter on the score never encodes a text twice.
    return F.arrow_udf(compare, "double").asNondeterministic()


def _vectors(encoder: Encoder) -> Callable[..., Column]:
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder()
        for chunks in batches:
            means, known = _mean_units(encode, chunks)
            offsets = pa.array(np.arange(len(known) + 1) * means.shape[1], pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.array(means.ravel()), mask=pa.array(~known))

    return F.arrow_udf(embed, "array<double>").asNondeterministic()


def _with_chunks(df: DataFrame, chunker: Chunker, **names: str) -> DataFrame:
    """Add the chunks of text columns, ``target=source``; a missing or empty text has none.

    A generator keeps the optimizer from moving the chunk expressions, which may nest functions, into
    the arguments of a Python function.
    """

    def chunks(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        return F.when(text != "", chunker(text)).otherwise(F.array().cast("array<string>"))

    found = F.array(F.struct(*[chunks(source).alias(target) for target, source in names.items()]))
    rows = df.withColumn("_found", F.explode(found))
    return rows.withColumns({target: F.col("_found")[target] for target in names}).drop("_found")


def score(
    df: DataFrame,
    encoder: Encoder,
    *,
    chunker: Chunker = sentence_chunks,
    answer_col: str = "answer",
    reference_col: str = "reference",
    target_col: str = "similarity",
) -> DataFrame:
    """Add the similarity of answer and reference as a column of the same row, without a shuffle.

    Only the chunks travel to the Python workers and only the score comes back. A text without
    chunks has no similarity.
    """
    compare = _pair_scores(encoder)
    rows = _with_chunks(df, chunker, _answer=answer_col, _reference=reference_col)
    return rows.withColumn(target_col, compare("_answer", "_reference")).drop("_answer", "_reference")


def score_distinct(
    df: DataFrame,
    encoder: Encoder,
    *,
    chunker: Chunker = sentence_chunks,
    answer_col: str = "answer",
    reference_col: str = "reference",
    target_col: str = "similarity",
    partitions: int | None = None,
) -> DataFrame:
    """The same scores as :func:`score`, with each distinct reference text encoded once.

    Worth its shuffles when the encoder is expensive and many rows (the answers of many models)
    share their references. ``partitions`` sets how many tasks encode the distinct texts. Answers are
    encoded before the join.
    """
    reference = F.coalesce(F.col(reference_col), F.lit(""))
    # Copies of a text collapse before the shuffle; its digest is the join key.
    texts = df.select(reference.alias("_text")).groupBy("_text").agg(F.count("*").alias("_rows"))
    if partitions:
        texts = texts.repartition(partitions)
    embed = _vectors(encoder)
    texts = _with_chunks(texts, chunker, _chunks="_text").select(
        F.sha2("_text", 256).alias("_key"), embed("_chunks").alias("_reference_vector"), "_rows"
    )
    vectors = materialise(texts, "reference-vectors")
    answered = _with_chunks(df, chunker, _chunks=answer_col).withColumn("_answer_vector", embed("_chunks"))
    keyed = answered.drop("_chunks").withColumn("_key", F.sha2(reference, 256))
    joined = lookup_join(keyed, vectors, "_key", "_rows")
    return joined.withColumn(target_col, dot(F.col("_answer_vector"), F.col("_reference_vector"))).drop(
        "_key", "_answer_vector", "_reference_vector"
    )


#: Bytes of sums that a task holds before it passes them on.
SUM_BYTES = 32 << 20


class _Sums:
    """Per group the sums of the unit vectors of either side, how many vectors there were, and whether any had elements."""

    def __init__(self, dimensions: int):
        self.width, self.held = 2 * dimensions, {}

    def add(self, key: tuple, sums: np.ndarray, counts: np.ndarray, seen: bool) -> None:
        known = self.held.get(key)
        if known is None:
            self.held[key] = [sums.copy(), counts.copy(), seen]
        else:
            known[0] += sums
            known[1] += counts
            known[2] |= seen

    def full(self) -> bool:
        return len(self.held) * self.width * 8 > SUM_BYTES

    def drain(self, types: list[pa.DataType]) -> tuple[list[pa.Array], list]:
        """The key columns and the states, which are forgotten."""
        held, self.held = self.held, {}
        return [pa.array(list(values), kind) for values, kind in zip(zip(*held), types)], list(held.values())


def _keys_of(batch: pa.RecordBatch, count: int) -> tuple[dict[tuple, int], np.ndarray]:
    """The distinct keys of a batch and the number of each row's key."""
    numbers: dict[tuple, int] = {}
    rows = zip(*(batch.column(i).to_pylist() for i in range(count)))
    return numbers, np.fromiter((numbers.setdefault(key, len(numbers)) for key in rows), np.int64, batch.num_rows)


def _block_sums(names: list[str], dimensions: int):
    """From rows (keys, side, vector) to a row per group and block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, types = _Sums(dimensions), None
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(names))]
            numbers, owner = _keys_of(batch, len(names))
            side = batch.column(len(names)).fill_null(-1).to_numpy(zero_copy_only=False)
            vectors = batch.column(len(names) + 1)
            place = np.where((side == 0) | (side == 1), owner * 2 + side, len(numbers) * 2)
            counts = np.bincount(place, minlength=len(numbers) * 2 + 1)[:-1].reshape(-1, 2)
            valid = vectors.is_valid().to_numpy(zero_copy_only=False)
            rows = vectors.drop_null().flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
            # A zero vector has no direction: it counts, and adds nothing.
            units = rows / np.where(norms == 0, 1.0, norms)
            order = np.argsort(place[valid], kind="stable")
            ranked = place[valid][order]
            starts = np.flatnonzero(np.diff(ranked, prepend=-1))
            total = np.zeros((len(numbers) * 2 + 1, dimensions))
            if len(starts):
                total[ranked[starts]] = np.add.reduceat(units[order], starts, axis=0)
            total = total[:-1].reshape(len(numbers), -1)
            seen = np.bincount(owner[valid], minlength=len(numbers)) > 0
            for key, k in numbers.items():
                sums.add(key, total[k], counts[k], bool(seen[k]))
            if sums.full():
                yield from _state_rows(sums, names, types)
        if types is not None:
            yield from _state_rows(sums, names, types)

    return run


def _state_rows(sums: _Sums, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    keys, states = sums.drain(types)
    if states:
        flat = pa.array(np.concatenate([s[0] for s in states]))
        offsets = pa.array(np.arange(len(states) + 1) * sums.width, pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, flat), *(pa.array([int(s[1][n]) for s in states], pa.int64()) for n in (0, 1)), pa.array([s[2] for s in states])]
        yield pa.RecordBatch.from_arrays([*keys, *columns], [*names, "_sums", "_n0", "_n1", "_seen"])


def _merge_sums(names: list[str], dimensions: int):
    """From the block sums, sorted by group, to a row per group with its similarity."""

    def finished(sums: _Sums, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        keys, states = sums.drain(types)
        if states:
            values = [
                float(s[0][:dimensions] @ s[0][dimensions:]) / float(s[1][0] * s[1][1]) if s[2] and s[1].all() else None for s in states
            ]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(values, pa.float64())], [*names, "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, types = _Sums(dimensions), None
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(names))]
            numbers, owner = _keys_of(batch, len(names))
            keys = list(numbers)
            rows = batch.column(len(names)).flatten().to_numpy().reshape(-1, 2 * dimensions)
            counts = np.stack([batch.column(len(names) + 1 + n).to_numpy() for n in (0, 1)], axis=1)
            seen = batch.column(len(names) + 3).to_pylist()
            for i, number in enumerate(owner):
                sums.add(keys[number], rows[i], counts[i], seen[i])
            if sums.full():
                # Groups come in order, so only the last one can go on in the next batch.
                last = keys[owner[-1]]
                rest = sums.held.pop(last)
                yield from finished(sums, types)
                sums.held[last] = rest
        if types is not None:
            yield from finished(sums, types)

    return run


def set_similarity(
    df: DataFrame, keys: list[str], side: Column, vector_col: str, dimensions: int
) -> DataFrame:
    """Mean cosine over all pairs of the vectors on side 0 and side 1 of every group.

    Every task sums up the unit vectors of its rows by group, so a group of any size costs one row of two
    sums per task in the shuffle, and no pair is ever formed. Every vector must have ``dimensions`` elements; NULL
    elements add nothing, and a NULL or zero vector counts and adds nothing. ``keys`` are columns of plain values.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    wrong = F.raise_error(F.concat(F.lit(f"a vector is not {dimensions} wide but "), F.size(vector).cast("string")))
    checked = F.when(vector.isNull() | (F.size(vector) == dimensions), vector).otherwise(wrong)
    rows = df.select(*keys, side.cast("int").alias("_side"), checked.alias("_v"))
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema.fields[: len(keys)])
    blocks = rows.mapInArrow(_block_sums(keys, dimensions), f"{kinds}, _sums array<double>, _n0 long, _n1 long, _seen boolean")
    together = blocks.repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(_merge_sums(keys, dimensions), f"{kinds}, similarity double")
