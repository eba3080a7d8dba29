"""BPE encoding by a depth-first walk over the trie of distinct words.

The encoding of a prefix is the encoding of a shorter prefix plus one last token, and that last
token is unique: the one vocabulary suffix whose pairing with the shorter prefix's last token
survives the merge order. So a trie node needs one state, its last token, and words that share a
prefix share the states along it. Words are visited in sorted order, which is the depth-first
order of their trie; only the current path is held.

Recovery: rows are independent, every task builds its own word memory, nothing is stored.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wardline.llm.tables import slices, texts

#: Words (with their encodings) that a worker remembers; beyond it the memory starts afresh.
WORD_MEMORY = 400_000
PAIR_MEMORY = 1_000_000

# White space of the vocabulary's normaliser, and its word pattern.
SPACE = "\t-\r \x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
# Characters that str.split() takes for white space and the normaliser does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, by the rule of byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary with word ends, and the words met so far."""

    def __init__(self, spec: str) -> None:
        tokenizer = json.loads(spec)
        model = tokenizer["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.rank: dict[tuple[int, int], int] = {}
        # by token: rank of the merge that makes it, its left and its right half
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((left, right), rank)
            self.made.setdefault(whole, (rank, left, right))
        # only what merges can make (or a single symbol) may be a last token
        usable = {
            t: i for t, i in self.vocab.items() if i in self.made or len(t.removesuffix(self.end)) == 1
        }
        self.inner = {t: i for t, i in usable.items() if not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end): i for t, i in usable.items() if t.endswith(self.end)}
        self.longest = max(map(len, (*self.inner, *self.final)))
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.pattern = regex.compile(WORD)
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.split_special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, reverse=True))) + ")"
        )

    def survives(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` stay apart when their letters are merged from scratch.

        Takes the merges back from the last to the first: at no moment may the two tokens that
        meet at the boundary have had a merge due before the next one that was really made.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        key, due, good = (a, b), float("inf"), True
        while True:
            if self.rank.get((a, b), due) < due:
                good = False
                break
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                break
            if made_b is not None and (made_a is None or made_b[0] >= made_a[0]):
                # equal merges run from the left, so one at the boundary would come first
                due, b = min(due, made_b[0] + 1), made_b[1]
            else:
                due, a = min(due, made_a[0]), made_a[2]
        if len(self.pairs) >= PAIR_MEMORY:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct word (in byte symbols), walking their trie depth-first."""
        found: dict[str, tuple[int, ...]] = {}
        # by depth, along the current path: last token and encoding of the prefix
        last: list[int] = [-1]
        codes: list[tuple[int, ...]] = [()]
        inner, final, longest = self.inner.get, self.final.get, self.longest
        known, survives = self.pairs.get, self.survives
        before = ""
        for word in sorted(set(words)):
            n = len(word)
            shared, limit = 0, min(len(last) - 1, n - 1)
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], codes[shared + 1 :]
            for depth in range(shared + 1, n + 1):
                vocab = inner if depth < n else final
                # of all suffixes that are tokens exactly one fits
                for start in range(depth - longest if depth > longest else 0, depth):
                    token = vocab(word[start:depth])
                    if token is None:
                        continue
                    if start:
                        fits = known((last[start], token))
                        if not (survives(last[start], token) if fits is None else fits):
                            continue
                        code = (*codes[start], token)
                    else:
                        code = (token,)
                    break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                if depth < n:
                    last.append(token)
                    codes.append(code)
            found[word] = code
            before = word
        return found

    def remember(self, chunks: set[str]) -> None:
        """Encode the chunks (text between white space) that are not known yet."""
        new = chunks - self.words.keys()
        if len(self.words) + len(new) > WORD_MEMORY:
            self.words.clear()
            new = chunks
        pieces = {
            c: (c,) if c.isascii() and c.isalpha() else self.pattern.findall(c) for c in new
        }
        spelled = {
            p: p if p.isascii() and p.isalpha() else "".join(map(self.symbols.get, p.encode()))
            for ps in pieces.values()
            for p in ps
        }
        codes = self.encode_words(spelled.values())
        for c, ps in pieces.items():
            ids = codes[spelled[ps[0]]] if len(ps) == 1 else [i for p in ps for i in codes[spelled[p]]]
            shown = " ".join([self.tokens[i] for i in ids])
            self.words[c] = struct.pack(f"<{len(ids)}I", *ids), shown

    def chunks(self, text: str) -> list[str]:
        """Normalised text cut at white space; no word of the pattern crosses a cut."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in NOT_SPACE):
            return [c for c in self.spaces.split(text) if c]
        return text.split()

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """By text: packed little-endian ids, and their decoded text (see ``decode``).

        All texts' new words go through one trie walk. Special tokens are cut out first.
        """
        cut = [self.split_special.split(t) if "<|" in t else [t] for t in texts]
        parts = [
            [p if p in self.special else self.chunks(p) for p in parts] for parts in cut
        ]
        new: set[str] = set()
        for chunks in (p for ps in parts for p in ps if not isinstance(p, str)):
            new.update(chunks)
        self.remember(new)
        words, out = self.words.__getitem__, []
        for ps in parts:
            ids, shown = [], []
            for p in ps:
                if isinstance(p, str):
                    ids.append(struct.pack("<I", self.special[p]))
                    shown.append(p)
                elif p:
                    pairs = list(map(words, p))
                    ids.extend([i for i, _ in pairs])
                    shown.extend([s for _, s in pairs])
            out.append((b"".join(ids), " ".join(shown)))
        return out

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; what the vocabulary's library returns without a decoder."""
        ids = struct.unpack(f"<{len(packed) // 4}I", packed)
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def loaded(spec: str) -> WordBpe:
    """The vocabulary of a worker process; later tasks go on with its word memory."""
    return WordBpe(spec)


def encode_documents(docs: DataFrame, spec: str) -> DataFrame:
    """Rows of ``docs`` as (doc_id, ids, decoded): packed unsigned 32-bit ids, decoded text.

    ``spec`` is the JSON text of a vocabulary (fixed size; sent to the tasks once). A null text
    counts as empty; an empty text has no ids and decodes to an empty text. Every row gives one
    row, repeated ones included; other columns are ignored. A text of any length is encoded whole by one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for part in slices(batches):
            found = part.column("text").to_pylist()
            codes = bpe.encode([t or "" for t in found])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([ids for ids, _ in codes], pa.binary()),
                    pa.array([shown for _, shown in codes], pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    return texts(docs).mapInArrow(encode, "doc_id long, ids binary, decoded string")
