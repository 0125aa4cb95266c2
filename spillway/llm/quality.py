"""A quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over chunks that cover the whole text and overlap by a
window; each chunk is max-pooled, the chunks' mean is combined into one
probability. One input channel tells where the last bytes repeat those shortly
before, which no filter of one layer can see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.common import only, table, text_of

WIDTH, STRIDE, FILTERS, DEPTH = 8, 4, 24, 8
CHUNK = 256  # windows to a chunk
THRESHOLD = 0.3
#: Most labelled rows, and most bytes of their texts together, that a fit reads; rows are read whole.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 64 << 20
#: Texts are cut into pieces of so many bytes; each pass of the fit draws so many pieces of a text anew.
PIECE_BYTES, PIECES_AT_ONCE = 512, 4


#: The repeat channel: 8 bytes that equal those so many bytes before.
REPEATED, LAGS = 8, range(2, 33)


def repeats(data: np.ndarray) -> np.ndarray:
    """1 where the last 8 bytes (the last axis runs along the text), all but padding, repeat those up to 32 before; else 0."""
    out = np.zeros(data.shape, bool)
    for lag in LAGS:
        same = (data[..., lag:] == data[..., :-lag]) & (data[..., lag:] != 0)
        for run in (1, 2, 4):
            same = same[..., run:] & same[..., :-run]
        out[..., lag + REPEATED - 1 :] |= same
    return out


def inputs_of(embed: np.ndarray, data: np.ndarray) -> np.ndarray:
    x = embed[data]
    x[..., -1] = repeats(data)
    return x


@dataclass
class Network:
    """Embeddings of bytes (byte 0, which also pads, is zero), filters over two blocks of 4 bytes, and a logistic layer."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def pooled(self, buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The largest answer of each filter from each start (a window's number) to the next."""
        blocks = inputs_of(self.embed, buffer).reshape(-1, STRIDE * DEPTH)
        answers = blocks[:-1] @ self.filters[: STRIDE * DEPTH]
        answers += blocks[1:] @ self.filters[STRIDE * DEPTH :]
        return np.maximum(np.maximum.reduceat(answers, starts, axis=0) + self.bias, 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of each whole text."""
        if not texts:
            return np.empty(0)
        padded, starts, owners, at = [], [], [], 0
        for k, text in enumerate(texts):
            blocks = max(2, -(-len(text) // STRIDE))
            padded.append(text.ljust((blocks + 1) * STRIDE, b"\0"))
            windows = blocks - 1
            own = range(at, at + windows, CHUNK)
            starts += [*own, at + windows]  # the windows that reach into the next text are no chunk of either
            owners += [*[k] * len(own), -1]
            at += blocks + 1
        owner = np.array(owners)
        answers = self.pooled(np.frombuffer(b"".join(padded) + bytes(STRIDE), np.uint8), np.array(starts))[owner >= 0]
        owner = owner[owner >= 0]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        mean = np.add.reduceat(answers, first, axis=0) / np.diff(np.r_[first, len(owner)])[:, None]
        return 1 / (1 + np.exp(-np.clip(mean.astype(np.float64) @ self.weights + self.offset, -30, 30)))


def fit(pieces: np.ndarray, owner: np.ndarray, label: np.ndarray, epochs: int | None = None, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit by Adam. ``pieces``: rows of bytes; ``owner``: which text each is of; ``label``: 0 or 1 of each text.

    Without rows, or with one label alone, the network gives that label's share everywhere.
    """
    rng = np.random.default_rng(seed)
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3)) if len(label) else 0.5
    p = {
        "embed": rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
        "filters": rng.normal(0, 0.15, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "weights": np.zeros(FILTERS, np.float32) if 0 < share < 1 and len(set(label.tolist())) < 2 else rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "offset": np.array(np.log(share / (1 - share)), np.float32),
    }
    p["embed"][0] = 0
    network = lambda: Network(p["embed"], p["filters"], p["bias"], p["weights"].astype(np.float64), float(p["offset"]))
    if len(set(label.tolist())) < 2:
        return network()
    rows_of = [np.flatnonzero(owner == k) for k in range(len(label))]
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    size = pieces.shape[1]
    epochs = epochs or int(np.clip(60_000 // len(label), 10, 60))
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            drawn = [rows_of[k] if len(rows_of[k]) <= PIECES_AT_ONCE else rng.choice(rows_of[k], PIECES_AT_ONCE, replace=False) for k in batch]
            rows = np.concatenate(drawn)
            text = np.repeat(np.arange(len(batch)), list(map(len, drawn)))
            parts = np.bincount(text, minlength=len(batch)).astype(np.float32)
            x = pieces[rows]
            x_in = inputs_of(p["embed"], x)
            blocks = x_in.reshape(len(rows), size // STRIDE, STRIDE * DEPTH)
            answers = blocks[:, :-1] @ p["filters"][: STRIDE * DEPTH] + blocks[:, 1:] @ p["filters"][STRIDE * DEPTH :]
            best = answers.argmax(axis=1)
            pooled = np.maximum(np.take_along_axis(answers, best[:, None], axis=1)[:, 0] + p["bias"], 0)
            mean = np.zeros((len(batch), FILTERS), np.float32)
            np.add.at(mean, text, pooled)
            mean /= parts[:, None]
            error = (1 / (1 + np.exp(-(mean @ p["weights"] + p["offset"]))) - label[batch]).astype(np.float32) / len(batch)
            back = (error[:, None] * p["weights"] / parts[:, None])[text] * (pooled > 0)
            places = best[:, :, None] * STRIDE + np.arange(WIDTH)
            seen = np.take_along_axis(x[:, None, :], places, axis=2)
            inputs = x_in[np.arange(len(rows))[:, None, None], places].reshape(len(rows), FILTERS, WIDTH * DEPTH)
            g = {"weights": mean.T @ error + 1e-4 * p["weights"], "offset": error.sum(), "bias": back.sum(axis=0), "filters": np.einsum("rfi,rf->if", inputs, back)}
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], seen.ravel(), (back[:, :, None] * p["filters"].T[None]).reshape(-1, DEPTH))
            g["embed"][0] = 0
            step += 1
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                p[k] = (p[k] - rate * 0.5 ** (4 * epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return network()


def id_crc(column: str = "doc_id") -> Column:
    """CRC-32 of the id as text; of the empty string for null."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8"))


def labelled_pieces(docs: DataFrame, labels: DataFrame, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, owners and labels for ``fit`` from whole texts of labelled rows that are not held out.

    At most SAMPLE_ROWS rows, the first by a hash of doc_id, and of these as many
    as have SAMPLE_BYTES together. Of labels that differ for one doc_id the larger holds.
    """
    order = F.xxhash64("doc_id", F.lit(seed))
    known = only(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null").where(id_crc() % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
    texts = only(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")
    sizes = texts.select("doc_id", "quality", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash")).orderBy(order, "doc_id", "hash").limit(SAMPLE_ROWS).collect()
    fits = int(np.searchsorted(np.cumsum([r["size"] for r in sizes]), SAMPLE_BYTES, "right")) if sizes else 0
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(k, r["doc_id"], r["hash"]) for k, r in enumerate(sizes[: max(fits, min(1, len(sizes)))])], "_k long, doc_id long, _hash long")
    rows = texts.select(F.col("doc_id").cast("long"), "quality", F.encode("text", "UTF-8").alias("raw"), F.xxhash64("text").alias("_hash")).join(F.broadcast(chosen), ["doc_id", "_hash"]).dropDuplicates(["_k"]).orderBy("_k").collect()
    cut = [[r["raw"][a : a + PIECE_BYTES].ljust(PIECE_BYTES, b"\0") for a in range(0, max(len(r["raw"]), 1), PIECE_BYTES)] for r in rows]
    pieces = [np.frombuffer(x, np.uint8) for own in cut for x in own]
    owner = np.repeat(np.arange(len(rows)), list(map(len, cut))) if rows else np.empty(0, int)
    label = np.array([r["quality"] for r in rows])
    rng, snips = np.random.default_rng(seed), []
    for own in cut:  # texts may be short: a snippet of each counts as one more text
        raw = own[len(own) // 2].rstrip(b"\0")
        n = int(rng.integers(12, 120))
        at = int(rng.integers(0, max(1, len(raw) - n)))
        snips.append(np.frombuffer(raw[at : at + n].ljust(PIECE_BYTES, b"\0"), np.uint8))
    return np.array(pieces + snips).reshape(-1, PIECE_BYTES), np.r_[owner, len(rows) + np.arange(len(rows))], np.r_[label, label]


def train(docs: DataFrame, labels: DataFrame) -> Network:
    return fit(*labelled_pieces(docs, labels))


def _scored(network: Network, texts: list[str | None], at_once: int = 1 << 18) -> np.ndarray:
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    out, start, size = [], 0, 0
    for k, x in enumerate(raw):
        size += len(x)
        if size >= at_once or k == len(raw) - 1:
            out.append(network.scores(raw[start : k + 1]))
            start, size = k + 1, 0
    return np.concatenate(out) if out else np.empty(0)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score of each row: the whole text's probability of label 1.

    A null text scores as an empty one. Null and repeated ids and repeated rows are rows
    like any other, equal texts score alike, an empty table gives no rows, and
    other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scored(network, batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(work, "doc_id long, score double")


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score below ``threshold``."""
    network, at = train(docs, labels), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(network, batch.column(at).to_pylist()) >= threshold, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
