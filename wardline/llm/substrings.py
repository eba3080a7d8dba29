"""Removal of repeated word sequences: documents parsed into factors of indexed reference blocks.

Every document is cut into reference blocks by content: a block is the run of windows (``window`` words
each) that share their anchor, the least hash of ``GRAM`` consecutive words in the window. Equal windows
have the same anchor at the same place, wherever they stand, so one index by anchor finds them all. All
blocks of all documents are indexed, and each is looked up among the blocks that start earlier (smaller
id, or earlier in the same document). A block equal to an earlier one is a piece of a factor; blocks that
share the anchor but not all their words, as at the ends of a common passage, are looked up window by
window. Every piece knows its line: where its source lies relative to itself. From the left, pieces that
follow each other on one line are joined into one factor, which ends where the next piece stands on
another line or is no repetition. Factors of at least ``window`` words are removed.

This is the relative Lempel-Ziv parse with blocks as its alphabet: a source is the first occurrence of a
block rather than the longest match of all references, and windows across the boundary of two factors
are looked up like any others, so no repeated window is missed whatever the choice of sources.

Blocks travel as 64-bit hashes, not as words; a task keeps only the first of equal blocks it reads (the
others are repetitions at once), so a passage in a third of all documents is a few rows per task. Where a
task itself sees an anchor with several blocks, as at the ends of such a passage, it hands on their
windows, keyed by window, and one mark for the anchor: no anchor gathers more rows than there are
chunks. An anchor and a block's hash are compared together. Pieces and boundary windows are stored in
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.tables import slices, stored, texts
from wardline.llm.words import PLAIN, Words, mix, seeded

#: Words of an anchor.
GRAM = 5
#: Blocks or windows that a task compares before it passes the first of each on.
CHUNK = 300_000
#: Stands for a null doc_id: the largest id there is.
LAST_ID = 2**63 - 1
#: What a place is: a block, the mark of an anchor with several blocks, a window, a repetition.
BLOCK, MARK, WINDOW, AGAIN = range(4)
#: ``place`` packs the first word (upper 48 bits), the number of windows and the kind (a byte each), so
#: that it sorts by word and rows stay narrow.
PLACES = "`group` long, `hash` long, id long, tag long, place long"
FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))
START, COUNT, KIND = "place >> 16", "(place >> 8) & 255", "place & 255"


def anchors(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor word) of every block, windows by first word."""
    grams, span = words.runs(GRAM), window - GRAM + 1
    whole = words.whole(window)
    if not len(whole):
        return (np.empty(0, np.int64),) * 4
    # the least hash of each window, its offset in the lowest bits: equal hashes, leftmost first
    bits = int(span).bit_length()
    least = (grams >> np.uint64(bits)) << np.uint64(bits)
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[: len(least) - step], least[step:] + np.uint64(step))
        reach += step
    starts = np.flatnonzero(whole)
    anchor = starts + (least[starts] & np.uint64(2**bits - 1)).astype(np.int64)
    text = words.text_of()[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(starts)) - 1
    return text[begin], starts[begin], starts[last], anchor[begin]


def block_hashes(words: Words, first, last, anchor, window: int) -> np.ndarray:
    """Hash of all words of each block and of its anchor's place; its end windows overlap."""
    if not len(first):
        return np.empty(0, np.uint64)
    runs = words.runs(window)
    shape = ((last - first) * 64 + (anchor - first)).astype(np.uint64)
    return mix(runs[first] ^ seeded(runs[last] + shape, 3))


class Places:
    """Columns of places: group, hash, id, tag, start, number of windows."""

    def __init__(self, *columns: np.ndarray) -> None:
        self.columns = columns

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, which: np.ndarray) -> Places:
        return Places(*(c[which] for c in self.columns))

    def sorted(self) -> tuple[Places, np.ndarray, np.ndarray, np.ndarray]:
        """By sequence and place; where a new sequence begins, what repeats an earlier place, and its line."""
        group, hashed, ids, tag, start, _ = self.columns
        order = np.lexsort((start, tag, ids, hashed, group))
        out = self.take(order)
        group, hashed, ids, tag, start, _ = out.columns
        new = np.ones(len(out), bool)
        new[1:] = (group[1:] != group[:-1]) | (hashed[1:] != hashed[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(out) else new.astype(np.int64)
        # the same place twice is one document read twice, not a repetition
        again = (ids != ids[head]) | (tag != tag[head]) | (start != start[head])
        return out, new, again, ids[head] ^ tag[head] ^ ((start[head] - start) << 16)

    def batch(self, kind: int | np.ndarray, line: np.ndarray | None = None) -> pa.RecordBatch:
        """As rows. A window is dealt by its own hash, a repetition by its place; its hash is its line."""
        group, hashed, ids, tag, start, n = self.columns
        kinds = np.broadcast_to(np.asarray(kind, np.int64), len(self))
        group = np.where(kinds == WINDOW, seeded(group ^ mix(hashed), 5), group)
        group = np.where(kinds == AGAIN, seeded(ids.view(np.uint64) ^ start.astype(np.uint64), 6), group)
        if line is not None:
            hashed = np.where(kinds == AGAIN, line.view(np.uint64), hashed)
        place = (start.astype(np.int64) << 16) | (n.astype(np.int64) << 8) | kinds
        columns = [group.view(np.int64), hashed.view(np.int64), ids, tag, place]
        names = ["group", "hash", "id", "tag", "place"]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def window_places(places: Places) -> pa.RecordBatch:
    """Windows that a task hands on: the first of each, and the repetitions among them."""
    out, _, again, line = places.sorted()
    return out.batch(np.where(again, AGAIN, WINDOW), line)


class Chunk:
    """Blocks gathered by a task, with the hashes of their windows."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, places: Places, windows: np.ndarray) -> None:
        self.parts.append((*places.columns, windows))
        self.rows += len(places)

    def flush(self) -> Iterator[pa.RecordBatch]:
        *columns, windows = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.rows = [], 0
        n = columns[-1]
        blocks = Places(*columns)
        # where the windows of each block begin travels along in place of their number
        out, new, again, line = Places(*columns[:-1], np.cumsum(n) - n).sorted()
        at = out.columns[-1]
        group = out.columns[0]
        n = blocks.columns[-1][np.searchsorted(np.cumsum(blocks.columns[-1]), at, "right")]
        out.columns = (*out.columns[:-1], n)
        # groups of several blocks
        border = np.ones(len(out), bool)
        border[1:] = group[1:] != group[:-1]
        number = np.cumsum(border) - 1
        several = (np.bincount(number, weights=new) > 1)[number] if len(out) else border
        yield out.take(again).batch(AGAIN, line[again])
        yield out.take(~again & ~several).batch(BLOCK)
        marks = out.take(border & several)
        zero = np.zeros(len(marks), np.int64)
        yield Places(
            marks.columns[0], zero.astype(np.uint64), zero, zero, zero, zero
        ).batch(MARK)
        opened = np.flatnonzero(~again & several)
        count = n[opened]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        spread = np.repeat(opened, count)
        group, _, ids, tag, start, _ = out.take(spread).columns
        yield window_places(
            Places(group, windows[at[spread] + step], ids, tag, start + step, np.ones(len(step), np.int32))
        )


def _keys(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column("id").to_numpy(), part.column("tag").to_numpy()


def blocks(rows: DataFrame, window: int) -> DataFrame:
    """Places of the blocks of (id, tag, text), or of their windows, reduced by chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for part in slices(batches):
            words = Words(part.column("text").to_pylist(), PLAIN, False)
            text, first, last, anchor = anchors(words, window)
            if not len(text):
                continue
            hashed = block_hashes(words, first, last, anchor, window)
            ids, tags = _keys(part)
            places = Places(
                words.runs(GRAM)[anchor], hashed, ids[text], tags[text],
                first - words.first[text], last - first + 1,
            )
            # blocks cover every window once, in order
            chunk.add(places, words.runs(window)[words.whole(window)])
            if chunk.rows >= CHUNK:
                yield from chunk.flush()
        if chunk.rows:
            yield from chunk.flush()

    return rows.mapInArrow(cut, PLACES)


def judge(places: DataFrame) -> DataFrame:
    """``places`` with ``again`` (an equal sequence stands earlier), its ``line``, and ``open`` (a block, the
    first of its kind, whose anchor has another one, or a mark). Marks are dropped.

    Dealt by anchor for blocks and by sequence for windows; repetitions only pass through.
    """
    kind = F.expr(KIND)
    own = F.struct("id", "tag", "place")
    same = Window.partitionBy("group", "hash").orderBy("id", "tag", "place")
    around = Window.partitionBy("group")
    judged = (
        places.repartition("group")
        .withColumn("head", F.first(own).over(same))
        .withColumn("low", F.min("hash").over(around))
        .withColumn("high", F.max("hash").over(around))
    )
    again = (kind == AGAIN) | (F.col("head") != own)
    several = F.col("low") != F.col("high")
    shift = F.shiftleft(F.shiftright("head.place", 16) - F.shiftright("place", 16), 16)
    line = F.col("head.id").bitwiseXOR(F.col("head.tag")).bitwiseXOR(shift)
    return judged.where(kind != MARK).select(
        "group", "hash", "id", "tag", "place",
        again.alias("again"), F.when(kind == AGAIN, F.col("hash")).otherwise(line).alias("line"),
        ((kind == BLOCK) & ~again & several).alias("open"),
    )


def boundary_windows(rows: DataFrame, window: int) -> DataFrame:
    """Every window of the open blocks of (id, tag, text, open): its anchor's and its own hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text").to_pylist(), PLAIN, False)
            grams, runs = words.runs(GRAM), words.runs(window)
            text, first, last, anchor = anchors(words, window)
            ids, tags = _keys(part)
            opened = part.column("open")
            at = np.repeat(np.arange(part.num_rows), np.diff(opened.offsets.to_numpy()))
            wanted = opened.flatten().to_numpy(zero_copy_only=False) + words.first[at]
            # a block is known by its first window
            block = np.searchsorted(first, wanted)
            count = last[block] - first[block] + 1
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(first[block], count) + step
            of = np.repeat(text[block], count)
            yield window_places(
                Places(
                    np.repeat(grams[anchor[block]], count), runs[start], ids[of], tags[of],
                    start - words.first[of], np.ones(len(start), np.int32),
                )
            )

    return rows.mapInArrow(cut, PLACES)


def repeated_spans(rows: DataFrame, window: int) -> DataFrame:
    """(id, tag, spans): first words, numbers and lines of windows that stand earlier, by document."""
    is_window = F.expr(KIND) == WINDOW
    judged = judge(blocks(rows, window))
    judged = stored(judged.where(F.col("again") | F.col("open") | is_window), "judged-blocks")
    opened = judged.where("open").groupBy("id", "tag").agg(
        F.collect_set(F.expr(START)).alias("open")
    )
    more = boundary_windows(rows.join(opened, ["id", "tag"]), window)
    waiting = judged.where(is_window & ~F.col("again")).select(more.columns)
    # what is a repetition already needs no second look
    found = judged.where("again").select("id", "tag", "place", "line")
    edges = judge(more.unionByName(waiting)).where("again").select("id", "tag", "place", "line")
    edges = stored(edges, "judged-windows")
    span = F.struct(F.expr(START).alias("start"), F.expr(COUNT).cast("int").alias("n"), "line")
    return found.unionByName(edges).groupBy("id", "tag").agg(F.collect_set(span).alias("spans"))


def factors_of(spans: list[dict], window: int) -> list[tuple[int, int]]:
    """(first word, words) of the factors of a document, from the left.

    A piece goes on with the factor before it if it starts at the window after it and lies on its line: then
    both are one earlier passage. A place that was met twice has one of its lines.
    """
    out: list[tuple[int, int]] = []
    next_window, line = -1, None
    for span in sorted(spans, key=lambda s: (s["start"], s["line"])):
        start, n = span["start"], span["n"]
        if start < next_window:
            continue
        if start == next_window and span["line"] == line:
            first, words = out[-1]
            out[-1] = first, words + n
        else:
            out.append((start, n - 1 + window))
        next_window, line = start + n, span["line"]
    return [f for f in out if f[1] >= window]


def tag_of(digest: Column, salt: int) -> Column:
    """What tells texts of one id apart: 64 bits of the text's digest, mixed anew for every salt."""
    return F.xxhash64(digest, F.lit(salt))


def telling_salt(rows: DataFrame) -> int:
    """The first salt under which no two texts of one id, by their whole digests, share a tag.

    ``rows``: (id, digest). Only digests are compared; a second round is needed once in 2^64 pairs of
    texts of one id.
    """
    for salt in range(100):
        clash = (
            rows.withColumn("tag", tag_of(F.col("digest"), salt))
            .groupBy("id", "tag")
            .agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
            .where(F.col("low") != F.col("high"))
        )
        if clash.isEmpty():
            return salt
    raise RuntimeError("too many texts of one id to tell them apart by 64 bits")


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, text, n_words, n_removed, factors) of every row of ``docs`` without repeated windows.

    A word goes if a window of ``window`` consecutive words over it stands earlier too: in a
    document of smaller id, or earlier in the same one. All windows are judged on the input. The
    words that stay are joined by one space. ``factors``: (start, words) of the removed passages, each of which
    stands earlier as a whole; they may overlap by less than a window. A null or empty text has no words. Rows of one doc_id
    with different texts are ordered by a hash of the text; rows equal in both are one document and
    get the same result. A null doc_id counts as the largest id. A text of any length is cut whole
    by one task; an empty table gives no rows; other columns are ignored.
    """
    if not 2 * GRAM <= window <= 60:
        raise ValueError("a window holds 10 to 60 words")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = texts(docs).select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), digest.alias("digest"), "text", "doc_id"
    )
    salt = telling_salt(stored(rows.select("id", "digest"), "text-digests"))
    rows = rows.withColumn("tag", tag_of(F.col("digest"), salt)).drop("digest")
    spans = repeated_spans(rows.select("id", "tag", "text"), window)
    joined = rows.join(spans, ["id", "tag"], "left").select("doc_id", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept, counts, gone, factors = [], [], [], []
            columns = part.column("text").to_pylist(), part.column("spans").to_pylist()
            for text, spans in zip(*columns):
                words = (text or "").encode().split()
                counts.append(len(words))
                factors.append(factors_of(spans or [], window))
                if factors[-1]:
                    stays = np.ones(len(words), bool)
                    for start, n in factors[-1]:
                        stays[start : start + n] = False
                    words = list(compress(words, stays.tolist()))
                kept.append(b" ".join(words))
                gone.append(counts[-1] - len(words))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array([[{"start": s, "words": n} for s, n in f] for f in factors], FACTORS),
                ],
                names=["doc_id", "text", "n_words", "n_removed", "factors"],
            )

    return joined.mapInArrow(
        apply,
        "doc_id long, text string, n_words long, n_removed long, factors array<struct<start:int,words:int>>",
    )
