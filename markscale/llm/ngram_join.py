"""N-gram Jaccard self-join by chosen paths.

A text is the set of hashes of its runs of ``n`` words (all of its words, where it has fewer). Its
*tokens* are (coordinate, minimum) pairs of a MinHash signature, of which two sets share a fraction
equal to their similarity.

1. Equal sets are joined first; from here on a set stands for all of its documents.
2. Chosen paths: every run starts at one sampled token; all sets that share it are a bucket. A bucket
   of more than ``LEAF`` sets is split on ``CHILDREN`` further sampled tokens, which the path chooses,
   and so on. ``runs`` follows from the target recall at any depth. Splitting ends at a small bucket, or
   where a child keeps most of its parent: such a bucket holds sets so similar that splitting is of no use.
3. Small buckets are compared all-to-all by their signatures, with a margin that follows from the target
   recall; dense ones are taken as they are. Buckets of the same sets are compared once.
4. Candidate links form groups. Within a group every pair is compared exactly on the full sets, in
   blocks of ``BLOCK`` sets against each other, so that no task holds a large group and no pair is
   ever written: a block gives each set's number of links and one edge to its class.
5. Classes are the connected components of the exact links.

- A NULL or wordless text has no set: it is a class of its own and has no links.
- Repeated rows are documents with equal sets, hence linked. A NULL id ranks last in ``class_id``,
  the smallest id of the class.
- Only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markscale.llm.common import key_text
from markscale.session import materialise

N, THRESHOLD, RECALL = 5, 0.8, 0.99999
COORDINATES, CHILDREN, LEAF = 96, 2, 128
#: A child with so much of its parent is dense.
DENSE = 0.6
BLOCK, BLOCK_BYTES = 1024, 32 << 20

SETS = "text_key string, digest string, size long, signature binary"


# Sets and signatures


def separators() -> bytes:
    """ASCII letters to lower case, every other ASCII character but digits to a space."""
    return bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def shingle_hashes(text: str | None, n: int, table: bytes, cache: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word n-grams."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    found = text.encode("utf-8", "replace").translate(table).split()
    if len(cache) > 500_000:
        cache.clear()
    values = []
    for word in found:
        value = cache.get(word)
        if value is None:
            value = cache[word] = xxhash.xxh64_intdigest(word)
        values.append(value)
    h = np.array(values, dtype=np.uint64)
    if not len(h):
        return h
    width = min(n, len(h))
    grams = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
        grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    return np.unique(grams)


def multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(grams), 4096):
        mixed = grams[i : i + 4096, None] * factors
        out = np.minimum(out, (mixed >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def document_sets(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``key``, ``text_key``, ``digest``, ``size``, ``signature`` of every row; one pass over the whole texts."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, factors, cache = separators(), multipliers(), {}
        for batch in batches:
            rows = []
            for body in batch["text"]:
                grams = shingle_hashes(body, n, table, cache)
                digest = hashlib.md5(grams.tobytes()).hexdigest() if len(grams) else None
                text_key = hashlib.md5((body or "").encode("utf-8", "replace")).hexdigest()
                rows.append((text_key, digest, len(grams), signature(grams, factors).tobytes() if len(grams) else None))
            frame = pd.DataFrame(rows, columns=["text_key", "digest", "size", "signature"])
            frame.insert(0, "key", batch["key"].array)
            yield frame

    kind = docs.schema[key].dataType.simpleString()
    # The id travels as text, which keeps NULLs and large numbers as they are.
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(describe, f"key string, {SETS}").withColumn("key", F.col("key").cast(kind))


# Chosen paths


def matching(n: int, share: float) -> list[float]:
    """The chances that 0, 1, ... n of ``n`` coordinates match."""
    return [math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(n + 1)]


def lost_below(matches: int, pool: int) -> float:
    """The chance that no path below a shared root keeps a pair together, however deep the splits are.

    ``matches`` of the ``pool`` coordinates are the pair's. All children that it shares go on, so this
    is the chance that a branching process dies out; it does not fall with every further split.
    """
    shared = [math.comb(matches, k) * math.comb(pool - matches, CHILDREN - k) / math.comb(pool, CHILDREN) for k in range(CHILDREN + 1)]
    lost = 0.0
    for _ in range(1000):
        lost = sum(chance * lost**k for k, chance in enumerate(shared))
    return lost


def path_miss(runs: int, threshold: float) -> float:
    """The chance that no run finds a pair at the threshold; all runs draw from the same pool of coordinates."""
    pool = COORDINATES - runs
    return sum(c * (1 - threshold * (1 - lost_below(m, pool))) ** runs for m, c in enumerate(matching(pool, threshold)))


def runs_for(recall: float, threshold: float) -> int:
    """The fewest runs whose miss is half of what the target recall allows; ``least_matches`` has the other half."""
    for runs in range(1, COORDINATES - 2 * CHILDREN):
        if path_miss(runs, threshold) <= (1 - recall) / 2:
            return runs
    raise ValueError(f"{COORDINATES} coordinates do not reach recall {recall} at threshold {threshold}")


def least_matches(recall: float, threshold: float) -> int:
    """The most matching coordinates of which a pair at the threshold has fewer with half of the allowed miss."""
    below, chances = 0.0, matching(COORDINATES, threshold)
    for least, chance in enumerate(chances):
        below += chance
        if below > (1 - recall) / 2:
            return least
    return COORDINATES


def token(coordinate: Column) -> Column:
    return F.substring(F.col("signature"), coordinate * 4 + 1, F.lit(4))


def root_paths(sets: DataFrame, runs: int) -> DataFrame:
    paths = [F.xxhash64(F.lit(r), F.substring("signature", 4 * r + 1, 4)) for r in range(runs)]
    return sets.select("sid", F.explode(F.array(*paths)).alias("path"))


def child_paths(rows: DataFrame, sets: DataFrame, runs: int) -> DataFrame:
    """The parent's sets under each child; the path decides which coordinates are sampled."""
    pool = COORDINATES - runs
    first = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(pool)).cast("int")
    gap = 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(pool // CHILDREN - 1)).cast("int")
    picks = [F.lit(runs) + F.pmod(first + gap * i, F.lit(pool)) for i in range(CHILDREN)]
    below = F.array(*[F.xxhash64("path", F.lit(3), p, token(p)) for p in picks])
    return rows.join(sets.select("sid", "signature"), "sid").select(
        "sid", F.col("n").alias("parent"), F.explode(below).alias("path")
    )


def buckets(rows: DataFrame) -> DataFrame:
    """Per path with two sets and more: ``n``, the parent's size and a fingerprint of the members."""
    return (
        rows.groupBy("path")
        .agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent"),
             F.bit_xor(F.xxhash64("sid")).alias("x"))
        .where("n > 1")
    )


def once(found: DataFrame) -> DataFrame:
    """One path for each set of members."""
    return found.groupBy("n", "x").agg(F.min("path").alias("path")).select("path", "n")


def candidate_buckets(sets: DataFrame, runs: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(small buckets, dense buckets) of all levels, as rows ``path``, ``sid``."""
    small, dense = [], []
    active = None
    rows = root_paths(sets, runs).withColumn("parent", F.lit(0).cast("long"))
    while True:
        found = materialise(buckets(rows), "buckets")
        large = found.where(f"n > {LEAF}")
        is_dense = F.col("n") >= DENSE * F.col("parent")
        small.append(rows.join(once(found.where(f"n <= {LEAF}")), "path").select("path", "sid"))
        if large.limit(1).count() == 0:
            return small, dense
        split_here = (F.col("parent") > 0) & is_dense
        dense.append(rows.join(once(large.where(split_here)), "path").select("path", "sid"))
        onward = rows.select("path", "sid").join(large.where(~split_here).select("path", "n"), "path")
        if active is None:  # what is split further is a small part of all sets
            active = materialise(
                sets.select("sid", "signature").join(onward.select("sid").distinct(), "sid", "left_semi"), "active-sets"
            )
        rows = materialise(child_paths(onward, active, runs), "paths")


def group_runs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The consecutive rows with equal ``columns`` of a sorted stream of batches."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        keys = [batch[c].to_numpy() for c in columns]
        changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        bounds = [0, *changes.tolist(), len(batch)]
        for low, high in zip(bounds[:-2], bounds[1:-1]):
            yield batch.iloc[low:high]
        held = batch.iloc[bounds[-2] :]
    if held is not None and len(held):
        yield held


def roots_of(count: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Union-find over the links of one small group; the root is the smallest member."""
    parent = list(range(count))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(left.tolist(), right.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(count)]


def signature_links(leaves: DataFrame, sets: DataFrame, threshold: float, recall: float = RECALL) -> DataFrame:
    """Edges ``u``, ``v`` that connect what each small bucket links by signature."""
    least = least_matches(recall, threshold)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        us: list[int] = []
        vs: list[int] = []
        for group in group_runs(batches, ["path"]):
            sids = group["sid"].tolist()
            marks = np.frombuffer(b"".join(group["signature"]), dtype=np.uint32).reshape(len(sids), COORDINATES)
            left, right = [], []
            for i in range(len(sids) - 1):
                near = np.flatnonzero((marks[i + 1 :] == marks[i]).sum(axis=1) >= least)
                left.append(np.full(len(near), i))
                right.append(near + i + 1)
            roots = roots_of(len(sids), np.concatenate(left), np.concatenate(right))
            for i, root in enumerate(roots):
                if i != root:
                    us.append(sids[i])
                    vs.append(sids[root])
            if len(us) > 50_000:
                yield pd.DataFrame({"u": us, "v": vs})
                us, vs = [], []
        yield pd.DataFrame({"u": us, "v": vs})

    rows = leaves.join(sets.select("sid", "signature"), "sid").repartition("path").sortWithinPartitions("path")
    return rows.mapInPandas(compare, "u long, v long")


# Components


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node that has an edge.

    Large-star and small-star rounds; each is written to the shared folder. Only minima and edges move.
    """
    edges = materialise(edges.where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written: the join is then one of plain exchanges, in which Spark can split a node with very many edges.
        lowest = materialise(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "lowest")
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smaller, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialise(moved.unionByName(smaller.withColumnRenamed("m", "v")).distinct(), "edges")
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == state:
            break
        state = mark
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return named.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# Exact comparison


def exact_links(docs: DataFrame, sets: DataFrame, groups: DataFrame, key: str, text: str, n: int, threshold: float) -> DataFrame:
    """``digest``, ``root``, ``links``: per block of comparisons, the documents linked to a set, and an edge."""
    totals = groups.join(sets.drop("signature"), groups["node"] == sets["sid"]).select("digest", "root", "rep", "documents", "size")
    weigh = totals.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("hashes") * 8 / BLOCK_BYTES)).cast("int")
    # Written: a join of its own, whose large groups Spark can split.
    weighed = materialise(weigh.select("root", parts.alias("parts")), "group-parts")
    members = totals.join(weighed, "root")
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("text"))
    # One plan at every size: the texts are shuffled once.
    rows = texts.join(members.hint("merge"), texts["rep"].eqNullSafe(members["rep"])).select("digest", "root", "parts", "documents", "text")

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, cache = separators(), {}
        for batch in batches:
            found = [shingle_hashes(body, n, table, cache) for body in batch["text"]]
            # Rows that share the representative's id but not its set fall away here.
            own = [hashlib.md5(g.tobytes()).hexdigest() == d for g, d in zip(found, batch["digest"])]
            out = batch.drop(columns="text")
            out["grams"] = [g.tobytes() for g in found]
            yield out[np.array(own, dtype=bool)]

    schema = "digest string, root long, parts int, documents long, grams binary"
    full = rows.mapInPandas(shingles, schema).dropDuplicates(["digest"])
    part = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    dealt = full.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    up, down = round(threshold * 1_000_000), 1_000_000

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, str, int]] = []
        for group in group_runs(batches, ["root", "low", "high"]):
            if len(group) < 2:
                continue
            digests, documents = group["digest"].tolist(), group["documents"].to_numpy()
            parts = group["part"].to_numpy()
            across = parts.min() != parts.max() or group["low"].iloc[0] != group["high"].iloc[0]
            left, right = linked_pairs([np.frombuffer(g, dtype=np.uint64) for g in group["grams"]], parts if across else None, up, down)
            links = np.bincount(left, documents[right], len(digests)) + np.bincount(right, documents[left], len(digests))
            for i, root in enumerate(roots_of(len(digests), left, right)):
                if links[i]:
                    out.append((digests[i], digests[root], int(links[i])))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["digest", "root", "links"])
                out = []
        yield pd.DataFrame(out, columns=["digest", "root", "links"])

    sorted_rows = dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    return sorted_rows.mapInPandas(compare, "digest string, root string, links long")


def linked_pairs(grams: list[np.ndarray], parts: np.ndarray | None, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a Jaccard similarity of ``up / down`` at least; only across ``parts`` if given."""
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    joined = np.concatenate(grams)
    ids = np.unique(joined, return_inverse=True)[1].reshape(-1)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    seen = np.zeros(int(ids.max()) + 1, dtype=bool)
    left, right = [], []
    for i in range(len(grams) - 1):
        own = ids[starts[i] : starts[i] + sizes[i]]
        seen[own] = True
        shared = np.add.reduceat(seen[ids[starts[i + 1] :]].astype(np.int64), starts[i + 1 :] - starts[i + 1])
        seen[own] = False
        fits = shared * down >= up * (sizes[i] + sizes[i + 1 :] - shared)
        if parts is not None:
            fits &= parts[i + 1 :] != parts[i]
        near = np.flatnonzero(fits) + i + 1
        left.append(np.full(len(near), i))
        right.append(near)
    return np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)


def similarity_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """Per row: ``key``, ``text_key`` (MD5 of the text), ``class_key``, ``class_id`` and ``n_links``.

    ``class_id`` is the smallest id of the row's class, ``n_links`` counts the other documents similar to
    it. ``class_key`` tells classes apart where ids repeat; it is NULL for texts without a set.
    """
    runs = runs_for(recall, threshold)
    rows = materialise(document_sets(docs, key, text, n), "sets")
    sets = materialise(
        rows.where("size > 0").groupBy("digest", "size", "signature").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("documents"))
        # A short name for the candidate search. Sets that happened to share one would only be compared once more.
        .withColumn("sid", F.xxhash64("digest")),
        "distinct-sets",
    )
    small, dense = candidate_buckets(sets, runs)
    leaves = small[0]
    for level in small[1:]:
        leaves = leaves.unionByName(level)
    edges = signature_links(leaves, sets, threshold, recall)
    for level in dense:
        stars = level.groupBy("path").agg(F.min("sid").alias("v"))
        edges = edges.unionByName(level.join(stars, "path").select(F.col("sid").alias("u"), "v"))
    groups = components(edges)
    links = materialise(exact_links(docs, sets, groups, key, text, n, threshold), "links")
    classes = components(links.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("digest").agg(F.sum("links").alias("links"))
    labelled = sets.select("digest", "rep", "documents").join(classes.withColumnRenamed("node", "digest"), "digest", "left")
    labelled = labelled.join(counted, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = labelled.join(smallest, "root").select(
        "digest", F.col("root").alias("class_key"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("documents") - 1).alias("n_links")
    )
    joined = rows.select("key", "text_key", "digest", "size").join(known, "digest", "left")
    return joined.select(
        "key",
        "text_key",
        "class_key",
        F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("key")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each class; of rows alike in id and text, one."""
    found = similarity_classes(docs, key, text, n, threshold, recall)
    own = F.concat_ws(":", F.lit("alone"), F.col("key").cast("string"), F.col("text_key"))
    stay = found.groupBy(F.coalesce("class_key", own).alias("class")).agg(F.min(F.struct(F.isnull("key").alias("no_key"), "key", "text_key")).alias("first"))
    stay = stay.select(key_text(F.col("first.key")).alias("__key"), F.col("first.text_key").alias("__text_key"))
    text_key = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.withColumns({"__key": key_text(F.col(key)), "__text_key": text_key})
    kept = rows.join(stay.hint("merge"), ["__key", "__text_key"], "left_semi").dropDuplicates(["__key", "__text_key"])
    return kept.select(*docs.columns)
