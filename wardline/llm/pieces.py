"""Texts cut into chunks that a piece vocabulary encodes independently of each other.

A chunk is white space followed by what stands up to the next blank or line feed. No piece holds a
blank or a line feed after another character, so the pieces of a text are those of its chunks, one
after the other, and equal chunks need to be encoded once. A chunk of one blank and a word is
written as the word alone, which a plain split gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import sentencepiece

# White space by the Unicode property, the blank that the vocabulary writes, and of
# both those that may follow a letter inside a piece.
MARK = "▁"
_MAY_FOLLOW = "\t\x0b-\r\x85\xa0  -     　" + MARK
_WHITE = " \n" + _MAY_FOLLOW
CHUNK = re.compile(
    rf"[{_WHITE}]*+[^{_WHITE}]++(?:[{_MAY_FOLLOW}][{_WHITE}]*+[^{_WHITE}]++)*+(?:[{_MAY_FOLLOW}][{_WHITE}]*+\Z)?+"
    rf"|[{_WHITE}]++"
)
_ODD = re.compile(f"[{_MAY_FOLLOW}]")
#: Chunks of a text that are held at a time.
CHUNKS_AT_A_TIME = 100_000


def _written(chunk: str) -> str:
    return chunk[1:] if chunk[0] == " " and len(chunk) > 1 and chunk[1] not in _WHITE else chunk


def spelled(chunk: str) -> str:
    """The text that a chunk stands for."""
    return chunk if chunk[0] in " \n" else " " + chunk


def _plain(text: str) -> bool:
    """Whether white space is single blanks and line feeds between words."""
    return not (
        "  " in text
        or "\n\n" in text
        or " \n" in text
        or "\n " in text
        or text[0] in " \n"
        or text[-1] in " \n"
        or _ODD.search(text)
    )


def chunks(text: str) -> list[str]:
    """Chunks of ``text`` after the blank that the vocabulary puts before it; none if it is empty."""
    if not text:
        return []
    if _plain(text):
        return text.replace("\n", " \n").split(" ")
    return list(map(_written, CHUNK.findall(" " + text)))


def chunk_parts(text: str, size: int = CHUNKS_AT_A_TIME) -> Iterator[list[str]]:
    """The chunks of a text of any length, a bounded number at a time."""
    if len(text) <= size:
        if text:
            yield chunks(text)
        return
    part: list[str] = []
    for found in CHUNK.finditer(" " + text):
        part.append(_written(found.group()))
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part


def together(texts: list[str | None]) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Numbers of texts and their chunks: all short ones at once, each long one in parts of its own."""
    short = [i for i, t in enumerate(texts) if t and len(t) <= CHUNKS_AT_A_TIME]
    if short:
        yield short, [chunks(texts[i]) for i in short]
    for i, t in enumerate(texts):
        if t and len(t) > CHUNKS_AT_A_TIME:
            for part in chunk_parts(t):
                yield [i], [part]


class Pieces:
    """A piece vocabulary with byte fallback, by the bytes of its model file."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        self.bytes: list[bytes] = []
        for i in range(size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
                continue
            self.bytes.append(piece.replace(MARK, " ").encode())
            if not (self.model.is_control(i) or self.model.is_unknown(i)):
                inside = piece.lstrip(MARK)
                if MARK in inside or " " in piece or ("\n" in piece and len(piece) > 1):
                    raise ValueError(f"piece {piece!r} crosses chunks")
        self.blank = self.model.piece_to_id(MARK)

    def encode(self, found: list[str]) -> list[list[int]]:
        """Ids of each chunk."""
        # the library puts a blank of its own before each: it stands for the chunk's first blank
        white = {i: c for i, c in enumerate(found) if c[0] in " \n"}
        if white:
            found = found.copy()
            for i, c in white.items():
                found[i] = c.removeprefix(" ")
        codes = self.model.encode(found, num_threads=1)
        for i, c in white.items():
            if c == " ":
                codes[i] = [self.blank]
            elif c[0] == "\n":
                if codes[i][0] != self.blank:
                    raise ValueError("a piece joins a blank and a line feed")
                del codes[i][0]
        return codes


@lru_cache(maxsize=2)
def loaded(model: bytes) -> Pieces:
    """The vocabulary of a worker process."""
    return Pieces(model)
