"""Two tokenizers aligned byte by byte, and corpus-wide counts of the token pairs that overlap.

Chunks of text (see ``pieces``) are aligned once per worker: both tokenizers end a token at both of a
chunk's ends, so groups and links of a text are those of its chunks, one after the other.

The pair counts are an external sort. A task gathers (pair, document) records up to a fixed number, sorts
them, and hands on one zstd run per radix partition of the first side's ids. Runs hold their pairs
in the order of that side with the number of documents of each, the documents apart from them. Runs of
a partition are merged a fixed number at a time by a heap over their blocks until one is left, in whose
order all pairs of an id stand together, so its highest count is known as soon as they have passed. Then
every run meets the totals of its partition and streams the contributions of its pairs back to
its documents.

A pair is once in a run however many documents hold it, and runs are dealt out evenly within a partition:
a hot token makes no group larger. Recovery: runs and totals are stored in the shared folder.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm.bpe import byte_symbols
from wardline.llm.pieces import MARK, Pieces, spelled, together
from wardline.llm.tables import slices, stored, texts

#: Radix partitions of the ids of side A.
PARTITIONS = 16
#: Records of a run, pairs of a block, and runs merged by one task.
RUN_RECORDS = 4_000_000
BLOCK_PAIRS = 32_768
FAN_IN = 32
#: Chunks and links that a worker remembers; beyond it the memory starts afresh.
MEMORY = 400_000
MEMORY_LINKS = 10_000_000
#: Longer chunks are encoded on their own, in time that does not grow with their square.
LONG = 500
#: Bits of a document's place in its run.
PLACE = 20

# Fixed value: how the byte-level vocabulary cuts texts before merging.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


class ByteBpe:
    """A byte-level vocabulary by the JSON text of its file; special tokens count as plain text."""

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)["model"]
        vocab: dict[str, int] = model["vocab"]
        of_symbol = {s: b for b, s in enumerate(byte_symbols())}
        spelled = {t: bytes(map(of_symbol.__getitem__, t)) for t in vocab}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))):
            raise ValueError("ids do not follow the order of merges")
        self.size = max(vocab.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(spelled[token])
        ranks = {spelled[t]: i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_str(spec)
        self.whole.encode_special_tokens = True
        self.whole.no_truncation()
        self.whole.no_padding()

    def encode(self, found: list[str]) -> np.ndarray:
        """Ids of the (spelled) chunks, one after the other."""
        out: list[int] = []
        run: list[str] = []
        for c in found:
            if len(c) > LONG or c[-1].isspace():
                out += self.fast.encode_ordinary("".join(run))
                out += self.whole.encode(c, add_special_tokens=False).ids
                run = []
            else:
                run.append(c)
        out += self.fast.encode_ordinary("".join(run))
        return np.array(out, np.int64)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind=np.int64) -> None:
        self.size, self.data = 0, np.empty(1024, kind)

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.resize(self.data, max(end, 2 * len(self.data)))
        self.data[self.size : end] = values
        self.size = end

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.data[at]


class Aligner:
    """Both vocabularies and the alignments of the chunks met so far."""

    def __init__(self, spec: str, model: bytes) -> None:
        self.a, self.b = ByteBpe(spec), Pieces(model)
        self.b_lengths = np.array(list(map(len, self.b.bytes)), np.int64)
        self.each = math.ceil(self.a.size / PARTITIONS)
        #: links are numbered by side A first, its radix partitions one after the other
        self.codes = PARTITIONS * self.each * len(self.b_lengths)
        if self.codes.bit_length() + PLACE > 63:
            raise ValueError("too many pairs of ids for 64 bits")
        text = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.a_inner, self.a_last = text(self.a.size, ","), text(self.a.size, "|")
        self.b_inner, self.b_last = text(len(self.b_lengths), ","), text(len(self.b_lengths), ";")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.n_links, self.first = (Grown() for _ in range(5))
        self.links = Grown()

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a % PARTITIONS * self.each + a // PARTITIONS) * len(self.b_lengths) + b

    def learn(self, found: list[list[str]]) -> None:
        """Align the chunks that are not known yet; one that side B changes gets -1 tokens."""
        new = list(set().union(*found).difference(self.known))
        if not new:
            return
        coded = self.b.encode(new)
        texts = list(map(spelled, new))
        raw = list(map(str.encode, texts))
        piece = self.b.bytes.__getitem__
        if b"".join(map(piece, chain.from_iterable(coded))) != b"".join(raw):
            changed = {i for i, (r, ids) in enumerate(zip(raw, coded)) if b"".join(map(piece, ids)) != r}
            for i in changed:
                self._keep([new[i]], [""], *(np.array([x]) for x in (-1, -1, 0, 0)), np.empty(0, np.int64))
            rest = [i for i in range(len(new)) if i not in changed]
            new, texts, raw, coded = ([xs[i] for i in rest] for xs in (new, texts, raw, coded))
            if not new:
                return
        a = self.a.encode(texts)
        b = np.fromiter(chain.from_iterable(coded), np.int64)
        a_end, b_end = np.cumsum(self.a.lengths[a]), np.cumsum(self.b_lengths[b])
        ends = np.cumsum(list(map(len, raw)))
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        if not np.isin(ends, both, assume_unique=True).all():
            raise ValueError("a token crosses chunks")
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        # links: from the token of B over the first byte of A's to the one over its last
        a_start = a_end - self.a.lengths[a]
        low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_end, a_end)
        wide = high - low + 1
        at = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide - low, wide)
        links = self.code(np.repeat(a, wide), b[at])
        # groups as text: all of A's tokens, then all of B's
        out = np.empty(len(a) + len(b), object)
        groups = np.arange(len(both) + 1)
        a_before, b_before = np.searchsorted(a_group, groups), np.searchsorted(b_group, groups)
        last = np.append(a_group[1:] != a_group[:-1], True)
        out[np.arange(len(a)) + b_before[a_group]] = np.where(last, self.a_last[a], self.a_inner[a])
        last = np.append(b_group[1:] != b_group[:-1], True)
        out[np.arange(len(b)) + a_before[b_group + 1]] = np.where(last, self.b_last[b], self.b_inner[b])
        # tokens of both sides, groups and links up to the end of each chunk
        a_upto, b_upto = (np.searchsorted(e, ends, "right") for e in (a_end, b_end))
        both_upto = np.searchsorted(both, ends, "right")
        links_upto = np.append(0, np.cumsum(wide))[a_upto]
        upto = [0, *(a_upto + b_upto).tolist()]
        out = out.tolist()
        shown = ["".join(out[x:y]) for x, y in zip(upto, upto[1:])]
        counts = (np.diff(x, prepend=0) for x in (a_upto, b_upto, both_upto, links_upto))
        self._keep(new, shown, *counts, links)

    def _keep(self, new, shown, n_a, n_b, n_groups, n_links, links) -> None:
        for c in new:
            self.known[c] = len(self.known)
        self.shown += shown
        self.first.extend(self.links.size + np.cumsum(n_links) - n_links)
        for kept, more in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links)):
            kept.extend(more)
        self.links.extend(links)

    def align(self, found: list[list[str]]) -> tuple[np.ndarray, list[list[str]], np.ndarray, np.ndarray]:
        """By list of chunks: (n_a, n_b, n_groups, n_links; n_a -1 where B changes bytes), texts of groups; links
        and the list that holds each."""
        if len(self.known) > MEMORY or self.links.size > MEMORY_LINKS:
            self.clear()
        self.learn(found)
        known = self.known.__getitem__
        at = [list(map(known, cs)) for cs in found]
        flat = np.fromiter(chain.from_iterable(at), np.int64)
        ends = np.cumsum([0, *map(len, at)])
        of = np.repeat(np.arange(len(at)), np.diff(ends))
        figures = []
        for kept in (self.n_a, self.n_b, self.n_groups, self.n_links):
            figures.append(np.diff(np.append(0, np.cumsum(kept[flat]))[ends]))
        changed = np.unique(of[self.n_a[flat] < 0])
        if len(changed):
            stay = ~np.isin(of, changed)
            flat, of = flat[stay], of[stay]
            figures = [np.where(np.isin(np.arange(len(at)), changed), x, f) for x, f in zip((-1, 0, 0, 0), figures)]
        wide = self.n_links[flat]
        spots = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide - self.first[flat], wide)
        text = self.shown.__getitem__
        shown = [list(map(text, x)) for x in at]
        return np.stack(figures), shown, self.links[spots], np.repeat(of, wide)


@lru_cache(maxsize=1)
def loaded(spec: str, model: bytes) -> Aligner:
    """The aligner of a worker process; later tasks go on with its memory."""
    return Aligner(spec, model)


def _column(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes each, after a byte that says how many."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - (w == 8)))
    return bytes([width]) + len(values).to_bytes(4, "little") + values.astype(f"<u{width}").tobytes()


def _columns(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        width, n = raw[at], int.from_bytes(raw[at + 1 : at + 5], "little")
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 5).astype(np.int64))
        at += 5 + width * n
    return out


def to_run(blocks: Iterable[tuple[np.ndarray, ...]]) -> bytes:
    """Blocks of columns, the first one ascending, as zstd frames with their lengths."""
    pack = zstandard.ZstdCompressor(level=3).compress
    out = []
    for codes, *more in blocks:
        frame = pack(_column(np.diff(codes, prepend=0)) + b"".join(map(_column, more)))
        out += [len(frame).to_bytes(4, "little"), frame]
    return b"".join(out)


def from_run(run: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """The blocks of a run, one after the other."""
    unpack, at = zstandard.ZstdDecompressor().decompress, 0
    while at < len(run):
        n = int.from_bytes(run[at : at + 4], "little")
        steps, *more = _columns(unpack(run[at + 4 : at + 4 + n]))
        yield np.cumsum(steps), *more
        at += 4 + n


def in_blocks(*columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    for a in range(0, len(columns[0]), BLOCK_PAIRS):
        yield tuple(c[a : a + BLOCK_PAIRS] for c in columns)


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of all runs in order with the sums of their counts, by a heap over the runs' blocks.

    The heap gives the block that ends first; up to its end nothing else can come, so what all blocks hold
    up to there is added up and passed on.
    """
    sources = [from_run(r) for r in runs]
    open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def refill(i: int) -> None:
        block = next(sources[i], None)
        if block is not None:
            open_[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(sources)):
        refill(i)
    while heap:
        end = heap[0][0]
        codes, counts = [], []
        for i, (c, n) in open_.items():
            upto = int(np.searchsorted(c, end, "right"))
            if upto:
                codes.append(c[:upto])
                counts.append(n[:upto])
                open_[i] = c[upto:], n[upto:]
        while heap and heap[0][0] == end:
            i = heapq.heappop(heap)[1]
            del open_[i]
            refill(i)
        flat = np.concatenate(codes)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        yield flat[first], np.add.reduceat(np.concatenate(counts)[order], first)


def with_best(
    blocks: Iterable[tuple[np.ndarray, np.ndarray]], pairs_of_id: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Add whether a count is the highest of its id of side A; holds back one id's pairs at a time."""
    rest = np.empty(0, np.int64), np.empty(0, np.int64)

    def judged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = codes // pairs_of_id
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(ids))))
        return codes, counts, (counts == most).astype(np.int64)

    for codes, counts in blocks:
        codes, counts = np.concatenate((rest[0], codes)), np.concatenate((rest[1], counts))
        ids = codes // pairs_of_id
        done = int(np.searchsorted(ids, ids[-1]))
        if done:
            yield judged(codes[:done], counts[:done])
        rest = codes[done:], counts[done:]
    if len(rest[0]):
        yield judged(*rest)


_DOC = [("run", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64())]
_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
_RUN = [("radix", pa.int32()), ("pairs", pa.binary()), ("docs", pa.binary())]
_MAPPED = pa.schema(
    [*_DOC, *((f, pa.int64()) for f in _FIGURES), ("groups_sha256", pa.string()), *_RUN]
)
_MAPPED_DDL = (
    "run long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, radix int, pairs binary, docs binary"
)


class Records:
    """(pair, document) records of a run with the number of links, up to a fixed number."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.size = 0

    def add(self, codes: np.ndarray, places: np.ndarray) -> None:
        keys, n = np.unique((codes << PLACE) | places, return_counts=True)
        self.keys.append(keys)
        self.links.append(n)
        self.size += len(keys)

    def run(self, codes_of_radix: int) -> Iterator[tuple[int, bytes, bytes]]:
        """By radix partition: the pairs with their numbers of documents; documents and links of each."""
        if not self.size:
            return
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        # a text that came in parts has a record of a pair in several of them
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        links = np.add.reduceat(np.concatenate(self.links)[order], first)
        codes, places = keys[first] >> PLACE, keys[first] & ((1 << PLACE) - 1)
        start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        pairs, docs = codes[start], np.diff(np.append(start, len(codes)))
        steps = np.diff(places, prepend=0)
        steps[start] = places[start]
        radix = pairs // codes_of_radix
        edges = np.searchsorted(radix, np.arange(PARTITIONS + 1))
        start = np.append(start, len(codes))
        pack = zstandard.ZstdCompressor(level=3).compress
        for r, (x, y) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            if x < y:
                a, b = start[x], start[y]
                held = pack(_column(steps[a:b]) + _column(links[a:b]))
                yield r, to_run(in_blocks(pairs[x:y], docs[x:y])), held


def _mapped(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and, whenever enough records have come, one per radix partition of their run."""
    aligner = loaded(*shared.value)
    codes_of_radix = aligner.codes // PARTITIONS
    run = TaskContext.get().partitionId() << PLACE
    records, place = Records(), 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for radix, pairs, docs in records.run(codes_of_radix):
            row = {"run": run, "radix": radix, "pairs": pairs, "docs": docs}
            yield pa.RecordBatch.from_pylist([row], _MAPPED)

    for part in slices(batches):
        ids = part.column("doc_id").to_pylist()
        found = [t if t and MARK not in t else "" for t in part.column("text").to_pylist()]
        figures = np.zeros((4, len(found)), np.int64)
        digests = [hashlib.sha256() for _ in found]
        ends = [""] * len(found)
        for at, cut in together(found):
            more, shown, links, of = aligner.align(cut)
            at = np.array(at)
            gone = at[more[0] < 0]
            figures[:, at] += more
            figures[0, gone] = -(1 << 60)
            for i, strings in zip(at.tolist(), shown):
                if strings:
                    digests[i].update((ends[i] + "".join(strings[:-1])).encode())
                    ends[i] = strings[-1]
            records.add(links, at[of] + place)
        changed = figures[0] < 0
        if changed.any():
            figures[:, changed] = 0
            # parts of a text before the one that gave it away
            lost = np.flatnonzero(changed) + place
            for k, keys in enumerate(records.keys):
                stay = ~np.isin(keys & ((1 << PLACE) - 1), lost)
                records.keys[k], records.links[k] = keys[stay], records.links[k][stay]
            records.size = sum(map(len, records.keys))
        shas = []
        for digest, end, n in zip(digests, ends, figures[0]):
            digest.update(end[:-1].encode())
            shas.append(digest.hexdigest() if n else "")
        yield pa.RecordBatch.from_pydict(
            {
                "run": [run] * len(ids),
                "place": range(place, place + len(ids)),
                "doc_id": ids,
                **dict(zip(_FIGURES, figures)),
                "groups_sha256": shas,
                **{name: [None] * len(ids) for name, _ in _RUN},
            },
            _MAPPED,
        )
        place += len(ids)
        if records.size >= RUN_RECORDS or place + 1024 >= 1 << PLACE:
            yield from flushed()
            run, records, place = run + 1, Records(), 0
    yield from flushed()


def _totals(runs: DataFrame, n_runs: int, pairs_of_id: int) -> DataFrame:
    """(radix, totals): one run per partition of all pairs with their counts, the highest marked."""
    schema = pa.schema([("radix", pa.int32()), ("run", pa.int64()), ("pairs", pa.binary())])

    def one_of(table: pa.Table) -> pa.Table:
        held = to_run(merged([x.as_py() for x in table.column("pairs")]))
        first = table.slice(0, 1)
        return pa.table([first.column("radix"), first.column("group"), [held]], schema)

    def last_of(table: pa.Table) -> pa.Table:
        blocks = merged([x.as_py() for x in table.column("pairs")])
        first = table.slice(0, 1)
        held = to_run(with_best(blocks, pairs_of_id))
        return pa.table([first.column("radix"), first.column("group"), [held]], schema)

    left = runs.select("radix", "run", "pairs")
    while True:
        groups = math.ceil(n_runs / FAN_IN)
        dealt = left.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)))
        meet = dealt.groupBy("radix", "group")
        merge = last_of if groups == 1 else one_of
        left = stored(meet.applyInArrow(merge, "radix int, run long, pairs binary"), "totals")
        if groups == 1:
            return left.select("radix", F.col("pairs").alias("totals"))
        n_runs = groups


def _returned(left: pa.Table, right: pa.Table) -> pa.Table:
    """What the totals of a partition add to the documents of the given runs."""
    schema = pa.schema([("run", pa.int64()), ("place", pa.int32()), ("best", pa.int64()), ("sum", pa.int64())])
    if not left.num_rows:
        return schema.empty_table()
    totals = [np.concatenate(c) for c in zip(*from_run(right.column("totals")[0].as_py()))]
    out = []
    for run, pairs, docs in zip(*(left.column(c) for c in ("run", "pairs", "docs"))):
        steps, links = _columns(zstandard.ZstdDecompressor().decompress(docs.as_py()))
        codes, n = (np.concatenate(c) for c in zip(*from_run(pairs.as_py())))
        at = np.searchsorted(totals[0], codes)
        start = np.cumsum(n) - n
        reach = np.cumsum(steps)
        places = reach - np.repeat(reach[start] - steps[start], n)
        best, sums = (np.zeros(int(places.max()) + 1, np.int64) for _ in range(2))
        np.add.at(sums, places, np.repeat(totals[1][at], n) * links)
        np.add.at(best, places, np.repeat(totals[2][at], n) * links)
        held = np.flatnonzero(sums)
        out.append(
            pa.table([pa.array(np.full(len(held), run.as_py())), held.astype(np.int32), best[held], sums[held]], schema)
        )
    return pa.concat_tables(out)


def align_documents(docs: DataFrame, spec: str, model: bytes) -> DataFrame:
    """Rows of ``docs`` as (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    ``spec`` is the JSON text of a byte-level vocabulary (side A, over a blank and the text), ``model`` the
    content of a piece vocabulary's file (side B); both are of fixed size. Groups are cut where tokens of
    both sides end; links are pairs of tokens with a common byte; the count of a pair of ids is the
    number of rows that hold it linked; ``n_best`` counts the links whose pair no other of its A id
    exceeds.

    Null and empty texts, and texts that side B spells otherwise (with a blank mark in them), have no
    tokens: zeros and an empty digest. A text of any length is aligned a bounded number of chunks at a
    time; a chunk of any length whole. Repeated rows count as rows, null and repeated ids too; an
    empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((spec, model))
    mapped = texts(docs).mapInArrow(lambda batches: _mapped(shared, batches), _MAPPED_DDL)
    mapped = stored(mapped, "runs")
    runs = mapped.where("radix is not null").select("run", "radix", "pairs", "docs")
    figures = mapped.where("radix is null").select("run", "place", "doc_id", *_FIGURES, "groups_sha256")
    n_runs = runs.agg(F.count_distinct("run")).first()[0]
    zero = F.lit(0).cast("long")
    if not n_runs:
        back = figures.select("run", "place", zero.alias("best"), zero.alias("sum")).limit(0)
    else:
        totals = _totals(runs, n_runs, Pieces(model).model.get_piece_size())
        salts = math.ceil(n_runs / FAN_IN)
        dealt = runs.withColumn("salt", F.pmod(F.xxhash64("run"), F.lit(salts)))
        copies = totals.withColumn("salt", F.explode(F.sequence(zero, F.lit(salts - 1).cast("long"))))
        meet = dealt.groupBy("radix", "salt").cogroup(copies.groupBy("radix", "salt"))
        back = meet.applyInArrow(_returned, "run long, place int, best long, sum long")
    sums = back.groupBy("run", "place").agg(F.sum("best").alias("best"), F.sum("sum").alias("sum"))
    return figures.join(sums, ["run", "place"], "left").select(
        "doc_id",
        *_FIGURES,
        F.coalesce("best", zero).alias("n_best"),
        F.coalesce("sum", zero).alias("count_sum"),
        "groups_sha256",
    )
