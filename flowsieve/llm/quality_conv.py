"""Quality of whole texts by a byte-level convolutional network in numpy.

``filters`` learned filters of ``width`` bytes slide over the text, every
``stride`` bytes. Their rectified responses are max-pooled in chunks of two
``hop``-byte cells; neighbouring chunks share a cell, so the chunks overlap by
half and cover the whole document. The chunk features are combined into the
document's vector (mean and maximum over its chunks), and a logistic unit turns
it into one probability.

A filter over one-hot bytes is a table lookup per byte position, which is how
both training and scoring compute it. Training runs on the driver over a
bounded sample of labelled rows (``sample``); scoring runs in Arrow batches on
the executors, a block of text at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsieve.llm.arrow_text import blocks, small_batches
from flowsieve.llm.sql_text import held_out


@dataclass(frozen=True)
class ConvConfig:
    """``sample``: most labelled rows that training reads; ``threshold``: least
    score of a predicted 1."""

    filters: int = 16
    width: int = 6
    stride: int = 2
    hop: int = 128
    sample: int = 4000
    epochs: int = 12
    batch: int = 32
    rate: float = 0.02
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 11


@dataclass
class ConvModel:
    """``table``: (width, 256, filters); byte 0 pads and weighs nothing."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.out, self.out_bias]


def _padded(data: np.ndarray, offs: np.ndarray, cfg: ConvConfig) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with every text filled up to whole cells, first cell of each)."""
    cells = np.maximum(1, -(-np.diff(offs) // cfg.hop))
    first = np.concatenate(([0], np.cumsum(cells)))
    out = np.zeros(int(first[-1]) * cfg.hop + cfg.width, dtype=np.uint8)
    shift = np.repeat(first[:-1] * cfg.hop - offs[:-1], np.diff(offs))
    out[np.arange(len(data)) + shift] = data
    return out, first


def _cells(x: np.ndarray, first: np.ndarray, model: ConvModel, cfg: ConvConfig) -> np.ndarray:
    """Filter responses, (cells, positions in the cell, filters). Windows that
    reach past a document's last cell would read its neighbour: they are out."""
    n_cells = int(first[-1])
    n = n_cells * cfg.hop
    acc = np.take(model.table[0], x[:n:cfg.stride], axis=0)
    for k in range(1, cfg.width):
        acc += np.take(model.table[k], x[k:k + n:cfg.stride], axis=0)
    acc = acc.reshape(n_cells, cfg.hop // cfg.stride, cfg.filters)
    past = (cfg.width - 1) // cfg.stride
    if past:
        acc[first[1:] - 1, -past:] = -np.inf
    return acc


def _documents(cell: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document vectors, chunk features, first chunk): chunk i joins cells i
    and i + 1 of a document; a document of one cell is one chunk."""
    size = np.diff(first)
    last = np.zeros(len(cell), dtype=bool)
    last[first[1:] - 1] = True
    pair = np.where(last[:, None], cell, np.maximum(cell, np.roll(cell, -1, axis=0)))
    keep = ~last
    keep[first[:-1][size == 1]] = True
    chunk = pair[keep]
    begin = np.concatenate(([0], np.cumsum(np.maximum(1, size - 1))[:-1]))
    n = np.maximum(1, size - 1)[:, None]
    return np.hstack((np.add.reduceat(chunk, begin) / n, np.maximum.reduceat(chunk, begin))), chunk, begin


def score_bytes(data: np.ndarray, offs: np.ndarray, model: ConvModel, cfg: ConvConfig) -> np.ndarray:
    """Probability of label 1 of each text."""
    x, first = _padded(data, offs, cfg)
    cell = np.maximum(_cells(x, first, model, cfg).max(axis=1) + model.bias, 0)
    z = _documents(cell, first)[0] @ model.out + model.out_bias
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _gradients(x, first, label, model: ConvModel, cfg: ConvConfig) -> list[np.ndarray]:
    response = _cells(x, first, model, cfg)
    top = response.argmax(axis=1)
    raw = np.take_along_axis(response, top[:, None, :], axis=1)[:, 0] + model.bias
    cell = np.maximum(raw, 0)
    vec, chunk, begin = _documents(cell, first)
    p = 1 / (1 + np.exp(-np.clip(vec @ model.out + model.out_bias, -30, 30)))
    dz = (p - label)[:, None] / len(label)
    f, size = cfg.filters, np.diff(first)
    n = np.maximum(1, size - 1)
    doc = np.repeat(np.arange(len(n)), n)
    d_chunk = (dz * model.out[:f] / n[:, None])[doc]
    is_top = chunk == vec[doc][:, f:]
    ties = np.add.reduceat(is_top.astype(np.float32), begin)
    d_chunk += is_top * (dz * model.out[f:] / ties)[doc]
    # a chunk's gradient goes to whichever of its two cells is larger
    left = np.concatenate([np.arange(a, max(a + 1, b - 1)) for a, b in zip(first, first[1:])])
    right = np.minimum(left + 1, np.repeat(first[1:], n) - 1)
    d_cell = np.zeros_like(cell)
    from_left = cell[left] >= cell[right]
    np.add.at(d_cell, left, d_chunk * from_left)
    np.add.at(d_cell, right, d_chunk * ~from_left)
    d_cell *= raw > 0
    at = np.arange(len(cell))[:, None] * cfg.hop + top * cfg.stride
    d_table = np.empty_like(model.table)
    flat_filter = np.broadcast_to(np.arange(f), at.shape)
    for k in range(cfg.width):
        index = x[at + k].astype(np.int64) * f + flat_filter
        d_table[k] = np.bincount(index.ravel(), weights=d_cell.ravel(), minlength=256 * f).reshape(256, f)
    d_table[:, 0] = 0
    return [d_table, d_cell.sum(axis=0), (vec * dz).sum(axis=0), dz.sum(axis=0)]


def train(texts: list[bytes], labels: np.ndarray, cfg: ConvConfig) -> ConvModel:
    """Fit the network by Adam on cross entropy. Without texts of both labels
    the model gives the share of label 1 (one half without any)."""
    rng = np.random.default_rng(cfg.seed)
    f = cfg.filters
    table = rng.normal(0, 0.1, (cfg.width, 256, f)).astype(np.float32)
    table[:, 0] = 0
    model = ConvModel(table, np.zeros(f, np.float32), rng.normal(0, 0.1, 2 * f).astype(np.float32), np.zeros(1, np.float32))
    share = float(np.mean(labels)) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        model.out[:] = 0
        model.out_bias[:] = 20 * (share - 0.5)
        return model
    model.out_bias[:] = np.log(share / (1 - share))
    lens = np.array([len(t) for t in texts])
    m, v, step = [np.zeros_like(w) for w in model.weights()], [np.zeros_like(w) for w in model.weights()], 0
    for epoch in range(cfg.epochs):
        order = rng.permutation(len(texts))
        rate = cfg.rate * (1 - epoch / cfg.epochs)
        for s in range(0, len(order), cfg.batch):
            part = order[s:s + cfg.batch]
            offs = np.concatenate(([0], np.cumsum(lens[part])))
            x, first = _padded(np.frombuffer(b"".join(texts[i] for i in part), dtype=np.uint8), offs, cfg)
            step += 1
            for i, (w, g) in enumerate(zip(model.weights(), _gradients(x, first, labels[part], model, cfg))):
                g = g.astype(np.float32) + cfg.decay * w
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                w -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, cfg: ConvConfig = ConvConfig()) -> ConvModel:
    """Train on at most ``sample`` labelled rows, those of least hash, none of
    them held out. Null labels are left out; a null text is empty."""
    known = (labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label")))
    # ids alone choose the sample; its size is a parameter, so it can be broadcast to the texts
    chosen = (docs.where(~held_out()).select("doc_id").distinct().join(known, "doc_id")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.sample))
    rows = (docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(cfg.sample).select("text", "label").toArrow())
    texts = [(t or "").encode() for t in rows.column("text").to_pylist()]
    return train(texts, rows.column("label").to_numpy(), cfg)


def score_quality(docs: DataFrame, model: ConvModel, cfg: ConvConfig = ConvConfig()) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Reads doc_id and text only. Null and empty texts are scored as no bytes; a
    null doc_id is not held out; an empty table gives an empty one.
    """
    def run(batches):
        for rows, data, offs in blocks(batches, "text"):
            p = score_bytes(data, offs, model, cfg)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(p),
                 pa.array((p >= cfg.threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: ConvModel, cfg: ConvConfig = ConvConfig()) -> DataFrame:
    """The rows, all their columns, whose text is predicted 1. Null and empty
    texts have the score of an empty text; rows without a doc_id are judged like
    others, repeated rows alike. Columns besides text may have any name and hold
    nulls. An empty table gives an empty table."""
    def run(batches):
        for rows, data, offs in blocks(batches, "text"):
            yield rows.filter(pa.array(score_bytes(data, offs, model, cfg) >= cfg.threshold))

    small_batches(docs.sparkSession)
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
