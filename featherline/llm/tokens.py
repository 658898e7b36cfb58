"""Token identifiers of whole texts with public tokenizer files.

A text is cut at blanks that the tokenizer itself never looks across, and the identifiers
of a part are kept by the worker, so that a repeated word costs one look-up.  New parts of
ASCII and Latin letters alone, on whose classes and cases all Unicode tables agree, are
cut into pieces here, for the library's model, and a word with marks behind it shares what
is kept of the word; all others go through the whole library as they are.  Only speed depends
on what is kept: at most `CACHED_BYTES`, of parts of at most `CACHED_LENGTH` characters
each, in two generations.  What is met again while it is of the older one becomes of the
younger one; when that is full, the older one goes.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

CACHED_BYTES, CACHED_LENGTH = 128 << 20, 64
ENTRY_BYTES = 160  # of a dictionary entry, its key and its value, besides their contents
#: Characters of a text that are cut into parts at a time.
SLICE = 1 << 20
_UNSURE = re.compile("[\x1c-\x1f\x85]").search  # white space to Python alone, or not to all
_BLANK = re.compile(r"(?<!\s) (?!\s)")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_LATIN = re.compile(rf"[\n\x21-\x7e{_LETTERS}]+\Z").match
#: The patterns of the two files, as far as Latin parts without white space inside but line feeds go.
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_PIECES = re.compile(rf"{_SUFFIXES}|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+").findall
BLANK_PIECES = re.compile(rf"{_SUFFIXES}| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n{_LETTERS}0-9]+|\n+(?!.)|\n").findall


class Kind(NamedTuple):
    """How a tokenizer cuts: its pieces of a Latin part, what it sees before a part, and whether it lower-cases."""

    pieces: Callable[[str], list[str]]
    lead: str
    lower: bool


#: White space is dropped; composition and lower-casing do not look across it.
WORDS = Kind(WORD_PIECES, "", True)
#: One blank stands at the beginning of a token, and the pattern looks ahead only within white
#: space: a blank between two characters that are none begins a token.
BLANKS = Kind(BLANK_PIECES, " ", False)


class Parts(dict):
    """Identifiers by part; those of a missing part are made."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, part: str) -> bytes:
        return self.make(part)


class BlankEdge(Exception):
    """A part that is empty, or begins or ends with white space."""


class Encoder:
    """Little-endian unsigned 32-bit identifiers of whole texts.

    With `added` the file's added tokens keep their own identifiers, else they are ordinary text.
    """

    def __init__(self, path: str, kind: Kind, added: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        if any(x.normalized or x.single_word or x.lstrip or x.rstrip or x.content.split() != [x.content] for x in tokens):
            raise ValueError(f"added tokens that are not plain texts: {path}")
        self.marks = {x.content[0] for x in tokens}
        self.tokenize = self.tokenizer.model.tokenize
        self.kind = kind
        # The byte-level alphabet: printable characters stand for themselves, the others follow from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: chr(256 + i) for i, b in enumerate(hidden)}
        latin = [c for c in map(chr, range(256)) if c in " \n" or _LATIN(c)]
        self.letters = {ord(c): "".join(letters.get(b, chr(b)) for b in c.encode()) for c in latin}
        # Parts of two pieces at most, whatever the kind: letters, and other characters behind them.
        first = "".join(re.escape(c) for c in latin if c.isalpha() and c not in self.marks)
        behind = "".join(re.escape(c) for c in latin if not (c.isalnum() or c.isspace() or c in self.marks))
        self.word = re.compile(rf"([{first}]+)([{behind}]*)\Z").match
        self.lead = kind.lead.translate(self.letters)
        self.edges = False
        self._age({})

    def _age(self, older: dict[str, bytes]) -> None:
        self.known, self.older, self.known_pieces, self.used = Parts(self._part), older, Parts(self._piece), 0

    def _ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _model(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(piece.translate(self.letters))]).tobytes()

    def _word(self, word: str) -> bytes:
        """Identifiers of letters alone, in lower case where the kind asks for it."""
        if word.isascii():
            return array("I", [t.id for t in self.tokenize(self.lead + word)]).tobytes()
        return self._model(self.kind.lead + word)

    def _piece(self, piece: str) -> bytes:
        ids = self._model(piece)
        if len(piece) <= CACHED_LENGTH:
            self.known_pieces[piece] = ids
            self.used += ENTRY_BYTES + 2 * len(piece) + len(ids)
        return ids

    def _part(self, part: str) -> bytes:
        """Identifiers of a part that is not of the younger generation."""
        ids = self.older.get(part)
        if ids is None:
            _, lead, lower = self.kind
            if found := self.word(part):
                first, behind = found.groups()
                if lower:
                    first = first.lower()
                ids = self._word(part) if first == part else self.known[first]
                if behind:
                    ids += self.known_pieces[behind]
            elif lead and (not part or part[0].isspace() or part[-1].isspace()):
                if not self.edges:
                    raise BlankEdge
                return self._other(part)  # only parts that neither begin nor end with white space are kept
            else:
                ids = self._other(part)
        if len(part) <= CACHED_LENGTH:
            self.known[part] = ids
            self.used += ENTRY_BYTES + 2 * len(part) + len(ids)
        return ids

    def _other(self, part: str) -> bytes:
        pieces, lead, lower = self.kind
        if _LATIN(part) and self.marks.isdisjoint(part):
            return b"".join(map(self.known_pieces.__getitem__, pieces(part.lower() if lower else lead + part)))
        return self._ids([lead + part])[0]

    def _behind(self, text: str) -> tuple[str, bytes]:
        """With a blank before all other parts, the first part, which has none; and the identifiers of the others."""
        if not self.kind.lead:
            parts = re.split(r"[ \t\n\r]", text) if _UNSURE(text) else text.split()
            return "", b"".join(map(self.known.__getitem__, parts))
        first, *parts = text.split(" ")
        self.edges = first[-1:].isspace()
        try:
            if not self.edges:
                return first, b"".join(map(self.known.__getitem__, parts))
        except BlankEdge:
            self.edges = True
        first, *parts = _BLANK.split(text)
        return first, b"".join(map(self.known.__getitem__, parts))

    def _slices(self, text: str) -> Iterator[str]:
        first = 0
        while first < len(text):
            found = _BLANK.search(text, first + SLICE) if len(text) - first > SLICE else None
            last = found.start() if found else len(text)
            yield text[first:last]
            first = last

    def _many(self, texts: list[str]) -> list[bytes]:
        firsts, out = zip(*map(self._behind, texts)) if texts else ((), ())
        if self.used > CACHED_BYTES // 2:
            self._age(self.known)
        return list(map(bytes.__add__, self._ids(list(firsts)), out)) if self.kind.lead else list(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The identifiers of each text; texts of some megabytes in all are best at a time."""
        if all(len(text) <= SLICE for text in texts):
            return self._many(texts)
        return [b"".join(self._many([part])[0] for part in self._slices(text)) for text in texts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def word_encoder(path: str, added: bool) -> Encoder:
    """For files that compose, lower-case and drop white space, whose tokens never cross it."""
    encoder = Encoder(path, WORDS, added)
    if encoder.encode("a b") != b"".join(encoder._ids(["a\t \n b\r"])):
        raise ValueError(f"not a tokenizer that drops white space: {path}")
    return encoder


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> Encoder:
    """For byte-level files without a normalizer; added tokens keep their own identifiers."""
    encoder = Encoder(path, BLANKS, True)
    tokenizer = encoder.tokenizer
    if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.pre_tokenizer.add_prefix_space:
        raise ValueError(f"not a byte-level tokenizer: {path}")
    return encoder
