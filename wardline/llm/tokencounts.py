"""Token counts by a two-tier lookup on the map side.

Tier one is a table of the corpus's frequent pre-tokens with their lengths in tokens, packed, of a
fixed largest size, and broadcast. Tier two is the memory of a worker process, which encodes what the table
lacks. A count is the sum of the lengths of a text's pre-tokens, so no pre-token is shuffled.

The frequent ones come from all documents: each task keeps a bounded summary of counts (the least are
taken off everywhere when it is full, so whatever is frequent in a task stays), and summaries are
merged a fixed number at a time. They decide what is fast, never what is counted.

Recovery: rows are independent; a lost task builds its summary or its memory again.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.pieces import Pieces, chunk_parts, loaded, together
from wardline.llm.tables import slices, stored, texts

#: Pre-tokens in the table, and those that a summary counts; longer ones than this are in neither.
FREQUENT = 65_536
SUMMARY = 131_072
LONGEST = 64
#: Pre-tokens that a worker remembers; beyond it the memory starts afresh.
MEMORY = 500_000
#: Summaries merged by one task.
FAN_IN = 32


class Summary:
    """Counts of the frequent words of a stream in bounded memory (Misra and Gries, in batches)."""

    def __init__(self, size: int = SUMMARY) -> None:
        self.size, self.counts = size, Counter()

    def add(self, words: Iterable[str]) -> None:
        self.counts.update(words)
        if len(self.counts) > 2 * self.size:
            self.cut()

    def merge(self, packed: bytes) -> None:
        words, counts = unpack(packed)
        for w, n in zip(words, counts):
            self.counts[w] += n
        if len(self.counts) > 2 * self.size:
            self.cut()

    def cut(self) -> None:
        """Take the count of the first word beyond the size from all; keep what is left over."""
        if len(self.counts) <= self.size:
            return
        least = np.fromiter(self.counts.values(), np.int64, len(self.counts))
        off = int(-np.partition(-least, self.size)[self.size])
        self.counts = Counter({w: n - off for w, n in self.counts.items() if n > off})

    def packed(self) -> bytes:
        self.cut()
        return pack(self.counts)


def pack(values: dict[str, int]) -> bytes:
    """Words and numbers as compressed bytes; chunks hold no NUL at their borders, so lengths go along."""
    words = [w.encode() for w in values]
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    numbers = np.fromiter(values.values(), "<i8", len(words))
    head = np.array([len(words)], "<u4").tobytes()
    return zlib.compress(head + sizes.tobytes() + numbers.tobytes() + b"".join(words), 1)


def unpack(packed: bytes) -> tuple[list[str], list[int]]:
    raw = zlib.decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)) + 4 + 12 * n
    numbers = np.frombuffer(raw, "<i8", n, 4 + 4 * n).tolist()
    starts = [4 + 12 * n, *ends[:-1].tolist()] if n else []
    return [raw[a:b].decode() for a, b in zip(starts, ends.tolist())], numbers


def frequent_words(docs: DataFrame, size: int = FREQUENT) -> list[str]:
    """The frequent pre-tokens of all ``docs``: at most ``size``, of at most ``LONGEST`` characters."""
    spark = docs.sparkSession

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Summary(2 * size)
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                for found in chunk_parts(text or ""):
                    kept.add(found)
        kept.counts = Counter({w: n for w, n in kept.counts.items() if len(w) <= LONGEST})
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([kept.packed()], pa.binary())],
            names=["part", "summary"],
        )

    def merge(table: pa.Table) -> pa.Table:
        kept = Summary(2 * size)
        for packed in table.column("summary"):
            kept.merge(packed.as_py())
        first = pc.min(table.column("part")).as_py()
        return pa.table({"part": [first // FAN_IN], "summary": [kept.packed()]}, schema)

    schema = pa.schema([("part", pa.int64()), ("summary", pa.binary())])
    column = docs.select(F.col("text").cast("string").alias("text"))
    found = stored(column.mapInArrow(summarise, "part long, summary binary"), "summaries")
    parts = found.agg(F.max("part")).first()[0]
    while parts:
        group = F.floor(F.col("part") / FAN_IN).cast("long")
        merged = found.withColumn("group", group).groupBy("group")
        found = stored(merged.applyInArrow(merge, "part long, summary binary"), "summaries")
        parts //= FAN_IN
    last = found.first()
    words, counts = unpack(bytes(last.summary)) if last else ([], [])
    order = sorted(zip(counts, words), key=lambda x: (-x[0], x[1]))[:size]
    return sorted(w for _, w in order)


class Lengths:
    """Lengths of the frequent pre-tokens, and of those that a worker has met besides."""

    def __init__(self, pieces: Pieces, words: list[str], lengths: list[int], memory: int = MEMORY) -> None:
        self.pieces, self.memory = pieces, memory
        self.table = dict(zip(words, lengths))
        self.known = dict(self.table)

    def learn(self, found: list[list[str]]) -> None:
        """Encode what neither tier knows, all at once."""
        if len(self.known) > len(self.table) + self.memory:
            self.known = dict(self.table)
        new = list(set().union(*found).difference(self.known))
        if new:
            self.known.update(zip(new, map(len, self.pieces.encode(new))))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; all short ones together, a long one in parts."""
        out = [0] * len(texts)
        for at, found in together(texts):
            self.learn(found)
            length = self.known.__getitem__
            for i, words in zip(at, found):
                out[i] += sum(map(length, words))
        return out


@lru_cache(maxsize=1)
def lengths_of(model: bytes, table: bytes) -> Lengths:
    """Both tiers of a worker process; later tasks go on with its memory."""
    return Lengths(loaded(model), *unpack(table))


def count_tokens(docs: DataFrame, model: bytes, words: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` as (doc_id, n_bytes, n_tokens) under the piece vocabulary ``model``.

    ``model`` is the content of the model file (fixed size, sent to the tasks once); ``words`` are
    the pre-tokens of the table, by default ``frequent_words(docs)``. Null and empty texts have no
    bytes and no tokens. A text of any length is cut and counted a bounded number of pre-tokens at a time; a
    pre-token of any length is encoded whole. Repeated rows and ids give a row each; an empty table
    gives none; other columns are ignored, whatever their names.
    """
    words = frequent_words(docs) if words is None else words
    known = dict(zip(words, map(len, loaded(model).encode(words))) if words else ())
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model, pack(known)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = lengths_of(*shared.value)
        for part in slices(batches):
            found = part.column("text")
            counts = lengths.counts(found.to_pylist())
            size = pc.binary_length(found).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), size, pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
