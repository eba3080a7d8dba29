"""Quality scores from a byte-level convolutional network written in numpy.

Bytes become short fixed codes; learned filters of eight bytes move over the text four at a time. The
greatest response of every filter is taken in overlapping chunks that cover the whole text, chunks are
combined by their mean, maximum and minimum, and a logistic layer makes one probability of them.
A repeated word answers few filters in a chunk, symbols and capitals answer their own.

Training: on the driver, by Adam on the exact gradient, from a bounded sample of labelled rows (the only
thing collected). Scoring: Python tasks over whole texts in blocks of bounded size; the network is a
few kilobytes. Rows are independent, so a lost executor costs its tasks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.tables import slices, texts

STEP = 4  # bytes between windows; a window is two steps
FILTERS = 32
BLOCK = 32  # windows whose maximum is taken first; a chunk is two neighbouring blocks
SEGMENT = 1 << 11  # blocks computed at a time
PAD = STEP * BLOCK
#: A text shorter than so many bytes is marked as such: few windows answer few filters.
SHORT = (32, 64, 128, 256)
FEATURES = 3 * FILTERS + len(SHORT)
#: Labelled rows that are learnt from at most.
SAMPLE_ROWS = 3000
#: Bytes of a text that is learnt from at most, so that the sample and a step of training are bounded too;
#: a longer one is left out of the sample, never of the scoring.
SAMPLE_BYTES = 32_768
EPOCHS, BATCH, RATE = 6, 48, 0.004


def _byte_codes() -> np.ndarray:
    """Fixed code of each byte: what kind of letter it is, and six random numbers."""
    b = np.arange(256)
    kinds = [
        (b >= 65) & (b <= 90),
        (b >= 97) & (b <= 122),
        (b >= 48) & (b <= 57),
        np.isin(b, [9, 10, 11, 12, 13, 32]),
        b >= 128,
    ]
    kinds.append((b > 32) & (b < 127) & ~(kinds[0] | kinds[1] | kinds[2]))
    codes = np.hstack([np.stack(kinds, 1), np.random.RandomState(5).normal(0, 0.5, (256, 6))])
    codes[0] = 0
    return codes.astype(np.float32)


CODES = _byte_codes()
WIDTH = CODES.shape[1] * STEP


@dataclass
class Network:
    """Two halves of the filters, their bias, the scale of the features, and the last layer."""

    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


class Batch:
    """Texts as one buffer of bytes; every text is padded with zeros to whole blocks."""

    def __init__(self, texts: list[str | None]) -> None:
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.blocks = np.array([len(c) // PAD + 1 for c in coded], np.int64)
        length = np.array([len(c) for c in coded])
        self.short = np.stack([length < n for n in SHORT], 1).astype(np.float32)
        parts = [c + bytes(n * PAD - len(c)) for c, n in zip(coded, self.blocks.tolist())]
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.start = np.cumsum(self.blocks) - self.blocks

    def steps(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of both halves of the windows of some blocks, one row a window.

        The second half is the next step, or zeros where the text ends.
        """
        rows = CODES[self.buffer[low * PAD : high * PAD + STEP]].reshape(-1, WIDTH)
        if high * PAD == len(self.buffer):
            rows = np.vstack([rows, np.zeros((1, WIDTH), np.float32)])
        ends = (self.start + self.blocks) * BLOCK - 1
        ends = ends[(ends >= low * BLOCK) & (ends < high * BLOCK)] - low * BLOCK
        after = rows[1:].copy()
        after[ends] = 0
        return rows[:-1], after

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each chunk's two blocks (a text of one block has one chunk), and chunks by text."""
        counts = np.maximum(self.blocks - 1, 1)
        text = np.repeat(np.arange(len(counts)), counts)
        left = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + self.start[text]
        right = np.minimum(left + 1, (self.start + self.blocks - 1)[text])
        return left, right, counts


def respond(net: Network, now: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Responses of the windows of whole blocks: (blocks, windows, filters)."""
    out = now @ net.first
    out += after @ net.second
    out += net.bias
    return out.reshape(-1, BLOCK, FILTERS)


def block_maxima(net: Network, batch: Batch) -> np.ndarray:
    total = int(batch.blocks.sum())
    out = np.empty((total, FILTERS), np.float32)
    for low in range(0, total, SEGMENT):
        high = min(low + SEGMENT, total)
        out[low:high] = respond(net, *batch.steps(low, high)).max(axis=1)
    return np.maximum(out, 0)


def pooled(maxima: np.ndarray, batch: Batch) -> np.ndarray:
    """Mean, maximum and minimum of the chunks of each text, and whether it is short."""
    left, right, counts = batch.chunks()
    chunk = np.maximum(maxima[left], maxima[right])
    at = np.cumsum(counts) - counts
    mean = np.add.reduceat(chunk, at) / counts[:, None]
    most, least = np.maximum.reduceat(chunk, at), np.minimum.reduceat(chunk, at)
    return np.hstack([mean, most, least, batch.short])


def probability(net: Network, features: np.ndarray) -> np.ndarray:
    z = ((features - net.shift) / net.scale) @ net.weights + net.offset
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -500, 500)))


def score_texts(net: Network, texts: list[str | None]) -> np.ndarray:
    """One probability of good quality per text; an empty text is a block of zeros."""
    batch = Batch(texts)
    return probability(net, pooled(block_maxima(net, batch), batch))


def _gradients(net: Network, batch: Batch, labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss, for first, second, bias, weights and offset."""
    now, after = batch.steps(0, int(batch.blocks.sum()))
    answers = respond(net, now, after)
    best = answers.argmax(axis=1)
    raw = np.take_along_axis(answers, best[:, None, :], 1)[:, 0]
    maxima = np.maximum(raw, 0)
    left, right, counts = batch.chunks()
    from_left = maxima[left] >= maxima[right]
    chunk = np.where(from_left, maxima[left], maxima[right])
    at = np.cumsum(counts) - counts
    mean = np.add.reduceat(chunk, at) / counts[:, None]
    most, least = np.maximum.reduceat(chunk, at), np.minimum.reduceat(chunk, at)
    features = np.hstack([mean, most, least, batch.short])
    scaled = (features - net.shift) / net.scale
    p = probability(net, features)
    error = ((p - labels) / len(labels)).astype(np.float32)
    d_features = np.outer(error, net.weights) / net.scale
    text = np.repeat(np.arange(len(counts)), counts)
    d_mean, d_most, d_least = np.split(d_features[:, : 3 * FILTERS], 3, axis=1)
    # equal extremes share their gradient
    d_chunk = (d_mean / counts[:, None])[text]
    for extreme, d in ((most, d_most), (least, d_least)):
        hit = chunk == extreme[text]
        d_chunk = d_chunk + hit * (d / np.add.reduceat(hit, at, dtype=np.int64))[text]
    d_block = np.zeros_like(maxima)
    np.add.at(d_block, left, np.where(from_left, d_chunk, 0))
    np.add.at(d_block, right, np.where(from_left, 0, d_chunk))
    d_block *= raw > 0
    window = best + (np.arange(len(best)) * BLOCK)[:, None]
    d_first, d_second = np.empty_like(net.first), np.empty_like(net.second)
    for f in range(FILTERS):
        live = np.flatnonzero(d_block[:, f])
        d = d_block[live, f]
        d_first[:, f] = d @ now[window[live, f]]
        d_second[:, f] = d @ after[window[live, f]]
    return [d_first, d_second, d_block.sum(axis=0), error @ scaled, error.sum(keepdims=True)]


def train(texts: list[str | None], labels: np.ndarray, seed: int = 7) -> Network:
    """A network for the labelled texts; without both labels, one that returns their mean."""
    rng = np.random.RandomState(seed)
    size = (WIDTH, FILTERS)
    first, second = (rng.normal(0, 1 / np.sqrt(WIDTH), size).astype(np.float32) for _ in "ab")
    bias = np.full(FILTERS, 0.5, np.float32)
    base = float(np.clip(labels.mean(), 0.02, 0.98)) if len(labels) else 0.5
    net = Network(
        first, second, bias,
        np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32),
        np.zeros(FEATURES, np.float32), np.array([np.log(base / (1 - base))], np.float32),
    )
    if len(set(labels.tolist())) < 2:
        return net
    some = [texts[i] for i in rng.permutation(len(texts))[:400]]
    batch = Batch(some)
    features = pooled(block_maxima(net, batch), batch)
    net.shift, net.scale = features.mean(0), features.std(0) + 0.05
    parts = [net.first, net.second, net.bias, net.weights, net.offset]
    rates = [RATE, RATE, RATE, 5 * RATE, 5 * RATE]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        slow = 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            t += 1
            grads = _gradients(net, Batch([texts[i] for i in own]), labels[own])
            for p, g, a, b, rate in zip(parts, grads, m, v, rates):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= slow * rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows never learnt from: the CRC-32 of the id as text is divisible by 5 (null: as empty)."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("")) if isinstance(doc_id, str) else doc_id
    return F.crc32(text.cast("binary")) % 5 == 0


def fit(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES
) -> Network:
    """Train on at most ``rows`` labelled rows that are not held out, chosen by a hash of the id.

    Half of them of each label; the last layer's offset then puts the labels' true shares back.
    A document with several labels counts as the worst of them. Labels 0 and 1 only. Rows of texts of more
    than ``most_bytes`` bytes are not learnt from, so at most ``rows * most_bytes`` bytes are collected.
    A null text is learnt from like an empty one; of repeated ids each row counts, up to ``rows``.
    """
    marks = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .where(~held_out())
    )
    counts = {r.quality: r.n for r in marks.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    good, bad = (marks.where(F.col("quality") == q).orderBy(*order).limit(rows // 2) for q in (1, 0))
    # at most ``rows`` rows of two numbers
    short = texts(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    own = short.join(F.broadcast(good.unionByName(bad)), "doc_id")
    learnt = own.orderBy(*order, "text").limit(rows).select("text", "quality").toPandas()
    marked = learnt["quality"].to_numpy(np.float64)
    net = train(learnt["text"].tolist(), marked)
    ones = marked.sum()
    if 0 < ones < len(marked):
        net.offset += np.log(counts[1] / counts[0]) - np.log(ones / (len(marked) - ones))
    return net


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row; a null text is scored like an empty one.

    A text of any length is scored whole, a bounded number of blocks at a time. Equal texts have equal
    scores, repeated rows and ids a row each; an empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = score_texts(shared.value, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"]
            )

    return texts(docs).mapInArrow(score, "doc_id long, score double")
