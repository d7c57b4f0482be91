"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage of the whole text is
encoded (hashed byte trigrams and text statistics, then a learned layer). Gated attention,
``w . (tanh(V h) * sigmoid(U h))``, softmaxed over the document's passages, weighs them, and the
weighted passage representation is scored by a logistic layer.

The model is fitted on the driver from a sample of at most ``per_class`` labelled documents of each
class, drawn by a hash of the id, always with all of its passages. Where texts are long, the sample of a class
ends with the document that reaches ``class_passages``. A
sampled document counts for all labelled documents of its class that it stands for, so that scores
follow the classes' true shares whether the sample is all of them or a few.
Scoring is one narrow pass over all documents and all of their passages.

- A NULL or empty text is a bag of one empty passage and has a score like any other.
- Rows with the same id: their labels are averaged (half and more is 1); the smallest text is learned.
- Labels that are NULL or without a document are left out. Without any label every score is 0.5.
- Result columns replace columns of the same name; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markscale.llm.common import hash52
from markscale.session import materialise

PASSAGE_BYTES = 1024
TRIGRAMS = 128
STATISTICS = 12
FEATURES = STATISTICS + TRIGRAMS
#: A text is encoded in pieces of so many bytes, so that memory does not grow with it.
SLAB_BYTES = 1 << 20

#: Bounds of the sample of labelled rows, in whole documents: their number, and the passages that complete it.
PER_CLASS, CLASS_PASSAGES = 3000, 60_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 16, 40, 64, 3e-3, 1e-4, 7


def byte_classes() -> np.ndarray:
    """0 lower case, 1 upper case, 2 digit, 3 space, 4 line break, 5 sentence marks, 6 other marks, 7 beyond ASCII."""
    kinds = np.full(256, 7, dtype=np.int64)
    kinds[:128] = 6
    for low, high, kind in (("a", "z", 0), ("A", "Z", 1), ("0", "9", 2)):
        kinds[ord(low) : ord(high) + 1] = kind
    kinds[list(b" \t")] = 3
    kinds[list(b"\r\n")] = 4
    kinds[list(b".,;:'\"?-()")] = 5
    return kinds


def cut_points(data: np.ndarray) -> np.ndarray:
    """Starts of the passages: about every ``PASSAGE_BYTES``, moved on to the next white space."""
    spaces = np.flatnonzero((data == 32) | (data == 10))
    wanted = np.arange(PASSAGE_BYTES, len(data) - PASSAGE_BYTES // 4, PASSAGE_BYTES)
    at = np.searchsorted(spaces, wanted)
    return np.unique(np.concatenate([[0], spaces[at[at < len(spaces)]]]))


def encode_slab(raw: bytes, kinds: np.ndarray) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    starts = cut_points(data)
    sizes = np.diff(np.append(starts, len(data)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    n = len(starts)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    shares = np.bincount(owner * 8 + kinds[data], minlength=n * 8).reshape(n, 8) / sizes[:, None]
    out[:, :8] = np.sqrt(shares)
    for i, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist())):
        words = raw[start : start + size].split()
        count = max(1, len(words))
        distinct = set(words)
        out[i, 8:12] = (
            len(distinct) / count,
            min(3.0, len(b"".join(words)) / count / 8),
            np.log1p(count) / 5,
            len({w.lower() for w in distinct}) / max(1, len(distinct)),
        )
    if len(data) > 2:
        wide = data.astype(np.uint32)
        code = (wide[:-2] * np.uint32(40503) + wide[1:-1] * np.uint32(60493)) ^ (wide[2:] * np.uint32(30011))
        bucket = ((code * np.uint32(2654435761)) >> np.uint32(25)).astype(np.int64)
        counts = np.bincount(owner[:-2] * TRIGRAMS + bucket, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, STATISTICS:] = np.sqrt(counts / sizes[:, None])
    return out


def encode(text: str | None, kinds: np.ndarray) -> np.ndarray:
    """One row of features per passage of the whole text."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return np.zeros((1, FEATURES), dtype=np.float32)
    return np.concatenate([encode_slab(raw[i : i + SLAB_BYTES], kinds) for i in range(0, len(raw), SLAB_BYTES)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class GatedAttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, passages: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        h = np.tanh(passages @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"] + p["v0"]), sigmoid(h @ p["U"] + p["u0"])
        energy = (t * s) @ p["w"]
        sizes = np.diff(np.append(starts, len(passages)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        raised = np.exp(energy - np.maximum.reduceat(energy, starts)[bag])
        attention = raised / np.add.reduceat(raised, starts)[bag]
        z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "s": s, "a": attention, "bag": bag, "z": z, "p": sigmoid(z @ p["c"] + p["c0"][0])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return self.forward((np.concatenate(bags) - self.mean) / self.scale, starts)["p"]

    def gradients(
        self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, counts: np.ndarray | float = 1.0
    ) -> dict[str, np.ndarray]:
        """Of the mean logistic loss; ``counts`` weigh the bags."""
        p, f = self.weights, self.forward(x, starts)
        off = counts * (f["p"] - labels) / len(labels)
        dz = (off[:, None] * p["c"])[f["bag"]]
        da = (f["h"] * dz).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
        dgate = de[:, None] * p["w"]
        dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": x.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "v0": dt.sum(axis=0), "U": f["h"].T @ ds,
            "u0": ds.sum(axis=0), "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ off, "c0": np.array([off.sum()]),
        }


def fit_bags(
    bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, counts: np.ndarray | None = None
) -> GatedAttentionModel:
    """Adam on the bags' logistic loss; the same bags in the same order give the same model.

    ``counts``: how many documents each bag stands for; one if not given.
    """
    counts = np.ones(len(bags)) if counts is None else counts / counts.mean()
    stacked = np.concatenate(bags)
    rng = np.random.default_rng(SEED)
    shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "v0": (GATE,), "U": (HIDDEN, GATE),
              "u0": (GATE,), "w": (GATE,), "c": (HIDDEN,), "c0": (1,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k in "WVUwc" else np.zeros(s) for k, s in shapes.items()}
    model = GatedAttentionModel(stacked.mean(axis=0), stacked.std(axis=0) + 0.05, weights)
    scaled = [((b - model.mean) / model.scale).astype(np.float64) for b in bags]
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            sizes = [len(scaled[j]) for j in chosen]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
            step += 1
            x = np.concatenate([scaled[j] for j in chosen])
            for k, g in model.gradients(x, starts, labels[chosen], counts[chosen]).items():
                g = g + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def id_remainder(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, class_passages: int = CLASS_PASSAGES
) -> GatedAttentionModel | None:
    """Learn from labelled rows outside of fold 0; None if there are none."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .withColumn("__h", hash52(F.col("doc_id").cast("string")))
    )
    known = materialise(known, "labelled")
    totals = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    drawn = [known.where(F.col("__label") == k).orderBy("__h", "doc_id").limit(per_class) for k in (0, 1)]
    sample = drawn[0].unionByName(drawn[1]).select("doc_id", "__label")  # 2 x per_class rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = materialise(rows.groupBy("doc_id", "__label").agg(F.min("text").alias("text")), "sampled")
    # A class is 3,000 rows of two numbers at most here; its earlier documents' passages decide.
    size = F.ceil(F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)) / PASSAGE_BYTES)
    sizes = rows.select("doc_id", "__label", size.alias("size"), hash52(F.col("doc_id").cast("string")).alias("__h"))
    earlier = Window.partitionBy("__label").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    whole = sizes.withColumn("__before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).where(F.col("__before") < class_passages)
    rows = rows.join(F.broadcast(whole.select("doc_id")), "doc_id", "left_semi")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = byte_classes()
        for batch in batches:
            for doc_id, label, text in zip(batch["doc_id"], batch["__label"], batch["text"]):
                yield pd.DataFrame({"doc_id": [doc_id], "label": [label], "bag": [encode(text, kinds).tobytes()]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    learned = sorted(rows.select("doc_id", "__label", "text").mapInPandas(bags, f"doc_id {kind}, label int, bag binary").collect(), key=lambda r: r["doc_id"])
    if not learned:
        return None
    encoded = [np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, FEATURES) for r in learned]
    found = np.array([r["label"] for r in learned])
    counts = np.array([totals[k] for k in found.tolist()]) / np.bincount(found)[found]
    return fit_bags(encoded, found.astype(np.float64), counts=counts)


def add_score(docs: DataFrame, model: GatedAttentionModel | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a document's label is 1."""
    if model is None:
        return docs.withColumn(out, F.lit(0.5))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        kinds = byte_classes()
        results = np.empty(len(texts))
        pending: list[np.ndarray] = []
        done = held = 0
        for text in texts:
            pending.append(encode(text, kinds))
            held += len(pending[-1])
            if held >= 2048:
                results[done : done + len(pending)] = model.scores(pending)
                done, pending, held = done + len(pending), [], 0
        if pending:
            results[done:] = model.scores(pending)
        return pd.Series(results)

    return docs.withColumn(out, score(F.col(text)))
