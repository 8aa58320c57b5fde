"""A byte-level convolutional quality classifier in numpy.

Each byte has a learned vector.  Learned filters of eight bytes slide over the
document in steps of four; their responses are max-pooled in overlapping chunks of
256 bytes (128 apart), which cover the whole document.  The mean and the maximum
of the chunks' responses are combined into one logit, hence one probability."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, aside, bounded_batches

#: Bytes of a step, of a block (half a chunk), and steps of a block.
STEP, HALF = 4, 128
STEPS = HALF // STEP
#: Most bytes whose responses are held at once; longer documents go in parts.
PART = 1 << 17
#: Defaults of training: labelled rows at most, bytes of all their texts at most, epochs.
SAMPLE, SAMPLE_BYTES, EPOCHS = 6000, 64 << 20, 6


def as_blocks(raw: bytes) -> np.ndarray:
    """The bytes, zero-padded to whole blocks, at least two; a step of zeros follows."""
    n = max(2, -(-len(raw) // HALF)) * HALF
    out = np.zeros(n + STEP, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out


@dataclass
class Net:
    table: np.ndarray  # (256, e): byte vectors
    filters: np.ndarray  # (2 * STEP * e, f)
    bias: np.ndarray  # (f,)
    out: np.ndarray  # (2 * f,)
    shift: np.ndarray  # (1,)

    @classmethod
    def random(cls, rng: np.random.Generator, e: int = 4, f: int = 48) -> Net:
        n = lambda *s: rng.standard_normal(s).astype(np.float32)
        net = cls(n(256, e) * 0.5, n(2 * STEP * e, f) / np.sqrt(2 * STEP * e, dtype=np.float32), np.zeros(f, np.float32), n(2 * f) * 0.1, np.zeros(1, np.float32))
        net.table[0] = 0
        return net

    def params(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.bias, self.out, self.shift]

    def responses(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(step vectors, filter responses at each step) of a padded document."""
        x = self.table[data].reshape(-1, STEP * self.table.shape[1])
        half = len(self.filters) // 2
        y = x @ np.concatenate([self.filters[:half], self.filters[half:]], axis=1)
        f = len(self.bias)
        return x, y[:-1, :f] + y[1:, f:] + self.bias

    def block_max(self, data: np.ndarray) -> np.ndarray:
        got = []
        for at in range(0, len(data) - STEP, PART):
            _, y = self.responses(data[at : min(at + PART, len(data) - STEP) + STEP])
            got.append(y.reshape(-1, STEPS, y.shape[1]).max(axis=1))
        return np.maximum(np.concatenate(got), 0)

    def features(self, raw: bytes) -> np.ndarray:
        b = self.block_max(as_blocks(raw))
        chunks = np.maximum(b[:-1], b[1:])
        return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])

    def score(self, raw: bytes) -> float:
        z = float(self.features(raw) @ self.out + self.shift[0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def gradients(net: Net, raw: bytes, label: int, weight: float) -> list[np.ndarray]:
    """Of the weighted log loss of one document, for each of ``net.params()``."""
    data = as_blocks(raw)
    x, y = net.responses(data)
    f, half = len(net.bias), len(net.filters) // 2
    steps = y.reshape(-1, STEPS, f)
    at = steps.argmax(axis=1)
    blocks = np.maximum(np.take_along_axis(steps, at[:, None], 1)[:, 0], 0)
    later = blocks[1:] > blocks[:-1]
    chunks = np.where(later, blocks[1:], blocks[:-1])
    pooled = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
    z = float(pooled @ net.out + net.shift[0])
    dz = np.float32(weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label))
    d_chunks = np.tile(dz * net.out[:f] / len(chunks), (len(chunks), 1))
    d_chunks[chunks.argmax(axis=0), np.arange(f)] += dz * net.out[f:]
    d_blocks = np.zeros_like(blocks)
    d_blocks[1:] += np.where(later, d_chunks, 0)
    d_blocks[:-1] += np.where(later, 0, d_chunks)
    d_blocks[blocks <= 0] = 0
    d_y = np.zeros_like(steps)
    np.put_along_axis(d_y, at[:, None], d_blocks[:, None], 1)
    d_y = d_y.reshape(-1, f)
    d_filters = np.concatenate([x[:-1].T @ d_y, x[1:].T @ d_y])
    d_x = np.zeros_like(x)
    d_x[:-1] += d_y @ net.filters[:half].T
    d_x[1:] += d_y @ net.filters[half:].T
    e = net.table.shape[1]
    d_bytes = d_x.reshape(-1, e)
    d_table = np.stack([np.bincount(data, d_bytes[:, i], 256) for i in range(e)], axis=1).astype(np.float32)
    d_table[0] = 0
    return [d_table, d_filters, d_y.sum(axis=0), dz * pooled, np.array([dz])]


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01, seed: int = 7) -> Net:
    """Fit by Adam on log loss, on rows shuffled anew in each epoch.  Without rows
    of both labels, the net answers the one label it saw, or 0.5 for none."""
    rng = np.random.default_rng(seed)
    net = Net.random(rng)
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        net.out[:] = 0
        net.shift[:] = 0 if not rows else 3 if ones else -3
        return net
    # small samples get as many steps as a large one's epochs have
    epochs = max(epochs, -(-4000 // len(rows)))
    net.shift[:] = np.log(ones / (len(rows) - ones))
    first = [np.zeros_like(p) for p in net.params()]
    second = [np.zeros_like(p) for p in net.params()]
    t, steps = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = order[at : at + batch]
            total = [np.zeros_like(p) for p in net.params()]
            for i in own:
                for g, d in zip(total, gradients(net, *rows[i], 1 / len(own)), strict=True):
                    g += d
            t += 1
            now = rate * (1 - 0.9 * t / steps)
            for p, g, m, v in zip(net.params(), total, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 5: fold 0 is held out.  Null for null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """At most ``sample`` labelled rows outside the held-out fold, in the order of a hash
    of the id, with their whole texts, as many as ``most_bytes`` hold; a text that alone
    is larger teaches nothing.  Both bounds hold the driver's memory."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    scratch = Scratch(docs.sparkSession, "labels")
    known = scratch.keep(known, "sample")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # the sample's size is a parameter, so its broadcast is bounded
    rows = rows.join(F.broadcast(known), "doc_id").where(F.octet_length("text") <= most_bytes)
    rows = scratch.keep(rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")), "texts")
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # at most ``sample`` numbers
    some = rows.select("doc_id", F.sum(F.octet_length("text").cast("long")).over(upto).alias("upto")).where(F.col("upto") <= most_bytes)
    rows = rows.join(F.broadcast(some.select("doc_id")), "doc_id")
    return [(r["text"].encode("utf-8", "surrogatepass"), r["y"]) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]


def _scores(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            got = [net.score((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()]
            yield batch.append_column("score", pa.array(got, pa.float64()))

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted added.

    The net is trained on ``labels`` (doc_id, quality) as in ``training_rows`` and
    sees nothing but the text's bytes.  Every text is scored whole; a null text
    counts as empty.  A document labelled twice learns from the lower label.  Null
    ids and labels other than 0 and 1 teach nothing; without labels, the score is
    0.5.  Repeated rows come out repeated, an empty table gives an empty result, and
    columns of ``docs`` named score or predicted are replaced."""
    bounded_batches(docs.sparkSession)
    net = train(training_rows(docs, labels, sample, most_bytes))
    rest, back = aside(docs, "text", new=("score", "predicted"))
    rest = rest.withColumn("text", F.col("text").cast("string"))
    kind = T.StructType([*rest.schema, T.StructField("score", T.DoubleType())])
    out = rest.mapInArrow(_scores(net), kind)
    return out.select(*back, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
