"""Benchmark passages in documents: a prefix-filtered set join, verified word by word.

A document contains an item's window of consecutive words only if it contains every shingle of the
window, so a prefix of one shingle is necessary: the rarest by document frequency. Rare shingles
are joined; the shingle's place in the window gives the only possible start (positional bound), the
words that are left give the length bound; what passes is compared word by word.

Documents are scanned once. A filter of fixed size (one bit per slot of the benchmark's shingles)
keeps most shingles of the documents from leaving their task; more items make it let more through,
nothing is lost. Candidates are stored by row with the few words around each shingle, so texts are
never shuffled. The join is salted on the documents' side: one passage in a third of all rows is
dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.tables import slices, stored, texts
from wardline.llm.words import FOLDED, Words

FILTER_BITS = 24
SALTS = 16

CANDIDATE = "shingle: bigint, place: int, lead: int, around: string"
_ARROW_CANDIDATE = pa.struct(
    [("shingle", pa.int64()), ("place", pa.int32()), ("lead", pa.int32()), ("around", pa.string())]
)


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item_id, words, n, shingles): every window of every item; a short item is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = part.column("item_id").to_pylist()
            words = Words(part.column("text").to_pylist(), FOLDED, True)
            out = []
            for item, first, count in zip(ids, words.first.tolist(), words.counts.tolist()):
                n = min(window, count)
                if not n:
                    continue
                size = min(shingle, n)
                own = words.words(first, first + count)
                hashes = words.runs(size)[first : first + count - size + 1].view(np.int64).tolist()
                for s in range(count - n + 1):
                    text = b" ".join(own[s : s + n]).decode()
                    out.append((item, text, n, hashes[s : s + n - size + 1]))
            columns = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["item_id", "words", "n", "shingles"],
            )

    own = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    return own.mapInArrow(cut, "item_id long, words string, n int, shingles array<long>")


def shingle_filter(windows: DataFrame, bits: int) -> bytes:
    """One bit per slot that a shingle of the benchmark falls into: 2**bits bits at any size."""
    slots = windows.select(F.explode("shingles").alias("s")).select(
        F.pmod("s", F.lit(2**bits)).cast("int").alias("slot")
    )
    found = slots.groupBy("slot").count().select("slot").toPandas()["slot"].to_numpy()
    flags = np.zeros(2**bits, bool)
    flags[found] = True
    return np.packbits(flags).tobytes()


def candidates(
    docs: DataFrame,
    packed: bytes,
    sizes: list[int],
    window: int,
    bits: int,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(row, doc_id, n_words, found): shingles that pass the filter, with the words around them.

    The columns named in ``carry`` follow.
    """
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for part in slices(batches):
            words = Words(part.column("text").to_pylist(), FOLDED, True)
            of, first = words.text_of(), words.first
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for size in sizes:
                hashes = words.runs(size)
                hit = flags[(hashes & np.uint64(2**bits - 1)).astype(np.int64)]
                for at in np.flatnonzero(hit & words.whole(size)).tolist():
                    text = of[at]
                    low, high = int(first[text]), int(first[text + 1])
                    # a window holds at most so many words before and after the shingle
                    more = window - size if size == max(sizes) else 0
                    begin, end = max(low, at - more), min(high, at + size + more)
                    found[text].append(
                        {
                            "shingle": int(hashes[at].view(np.int64)),
                            "place": at - low,
                            "lead": at - begin,
                            "around": b" ".join(words.words(begin, end)).decode(),
                        }
                    )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column("doc_id"),
                    pa.array(words.counts, pa.int64()),
                    pa.array(found, pa.list_(_ARROW_CANDIDATE)),
                    *(part.column(c) for c in carry),
                ],
                names=["row", "doc_id", "n_words", "found", *carry],
            )

    rows = texts(docs, *carry).withColumn("row", F.monotonically_increasing_id())
    kinds = dict(rows.dtypes)
    schema = f"row long, doc_id long, n_words long, found array<struct<{CANDIDATE}>>"
    return rows.mapInArrow(scan, schema + "".join(f", `{c}` {kinds[c]}" for c in carry))


def rarest_shingles(windows: DataFrame, scanned: DataFrame) -> DataFrame:
    """(words, n, shingle, offset): each window's rarest shingle by document frequency.

    A window whose shingles are not all found occurs nowhere and is left out.
    """
    seen = scanned.select(F.explode(F.array_distinct("found.shingle")).alias("shingle"))
    frequency = seen.groupBy("shingle").agg(F.count("*").alias("df"))
    distinct = windows.select("words", "n", "shingles").dropDuplicates(["words"])
    tokens = distinct.select("words", "n", F.posexplode("shingles").alias("offset", "shingle"))
    return (
        tokens.join(frequency, "shingle", "left")
        .groupBy("words", "n")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("p"))
        .where(F.col("p.df") > 0)
        .select("words", "n", "p.shingle", "p.offset")
    )


def occurrences(scanned: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row, start, n, words): every place where a window really stands."""
    salted = scanned.select("row", F.explode("found").alias("c")).select(
        "row", "c.*", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    )
    copies = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    around = F.split("around", " ")
    # the optimiser may test in any order, so the slice must be legal for every row
    first = F.greatest(F.col("lead") - F.col("offset") + 1, F.lit(1))
    own = F.array_join(F.slice(around, first, F.col("n")), " ")
    return (
        salted.join(copies, ["shingle", "salt"])
        .where(F.col("lead") >= F.col("offset"))
        .where(F.col("lead") - F.col("offset") + F.col("n") <= F.size(around))
        .where(own == F.col("words"))
        .select("row", (F.col("place") - F.col("offset")).alias("start"), "n", "words")
    )


def covered(spans: str):
    """Number of words under any of the (start, n) of a sorted array."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("upto"))

    def add(a, s):
        end = s["start"] + s["n"]
        more = end - F.greatest(a["upto"], s["start"])
        return F.struct(
            (a["words"] + F.greatest(more, F.lit(0))).alias("words"),
            F.greatest(a["upto"], end).alias("upto"),
        )

    return F.aggregate(spans, zero, add)["words"].cast("long")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shingle: int = 3,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) and the columns in ``carry`` of every row of ``docs``.

    ``spans``: sorted (start, n) in words of all window occurrences; ``n_hit``: words under any of
    them; ``items``: distinct item ids with an occurring window, sorted as strings. A null text has
    no words; an item without words has no window. Occurrences of an item with a null id hit words
    but are in no list. Repeated rows, and items that share windows, count each on their own. A text of any
    length is scanned whole by one task; an empty table gives no rows; other columns are ignored.
    """
    windows = stored(item_windows(benchmark, window, shingle), "windows")
    # an item of fewer words than a shingle is one shingle of its own length
    short = windows.where(F.col("n") < shingle).select("n").distinct().collect()
    sizes = sorted({shingle, *(r.n for r in short)})
    packed = shingle_filter(windows, FILTER_BITS)
    scanned = stored(candidates(docs, packed, sizes, window, FILTER_BITS, carry), "candidates")
    hits = stored(occurrences(scanned, rarest_shingles(windows, scanned)), "occurrences")
    spans = hits.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans")
    )
    # a passage in a third of all documents is dealt over the salts
    dealt = hits.select("row", "words").distinct()
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    owners = windows.select("words", "item_id").distinct()
    owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    items = (
        dealt.join(owners, ["words", "salt"])
        .where(F.col("item_id").isNotNull())
        .groupBy("row")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    none = F.array().cast("array<struct<start:int,n:int>>")
    return (
        scanned.select("row", "doc_id", "n_words", *carry)
        .join(spans, "row", "left")
        .join(items, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce(covered("spans"), F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("spans", none).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            *carry,
        )
    )
