"""Ids of whole texts by public tokenizers, looked up word by word.

A text is cut at blanks between words, where the tokenizers never merge across. The words of a window of rows that are
not remembered yet are tokenised together, as one text, and its ids dealt back to them by their bytes; what is
remembered per worker is bounded. What a vocabulary must fulfil for this is checked when it is loaded; one that fails
the check is applied to whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a generation whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 150_000, 64
#: U+2581 stands for a blank in pieces.
BAR = "▁"
#: One blank between two characters that are no white space: the splitter of byte-level BPE starts a new word before it.
BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Characters before this one are Latin letters and signs of old.
LATIN = "\u0250"
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: str) -> list[str]:
    """`text` cut at the blanks between words, these blanks left out; parts are not empty unless the text is."""
    parts = text.split(" ")
    even = "" not in parts and not any(c in text and (" " + c in text or c + " " in text) for c in SPACES)
    return parts if even else BLANK.split(text)


class Words:
    """Values of words, found for many words at once and remembered in two generations of bounded size."""

    def __init__(self, find: Callable[[list[str]], Iterable]):
        self.find, self.known, self.older = find, {}, {}

    def __call__(self, texts: list[list[str]]) -> list[list]:
        """The values of the words of each text."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        get = self.known.get
        values = [list(map(get, parts)) for parts in texts]
        open_texts = [i for i, v in enumerate(values) if None in v]
        unknown = list({p for i in open_texts for p, v in zip(texts[i], values[i]) if v is None})
        again = {p: v for p, v in zip(unknown, map(self.older.get, unknown)) if v is not None}
        new = [p for p in unknown if p not in again]
        self.known.update(again)
        self.known.update(zip(new, self.find(new) if new else ()))
        for i in open_texts:
            values[i] = list(map(get, texts[i]))
        for p in new:
            if len(p) > LONGEST:
                del self.known[p]
        return values


def dealt(parts: list[str], encode: Callable[[str], Iterable[int]], sizes: np.ndarray, mark: str = " ") -> list[bytes] | None:
    """Ids (little-endian uint32 bytes) of each mark + part, from the ids of all of them together.

    None if the bytes of ids and parts do not tally.
    """
    ids = np.asarray(encode("".join([mark + p for p in parts])), "<u4")
    ends = np.cumsum(sizes[ids])
    wanted = np.cumsum([len(p.encode()) + len(mark.encode()) for p in parts])
    cuts = np.searchsorted(ends, wanted) + 1
    if not len(ends) or cuts[-1] != len(ids) or not np.array_equal(ends[cuts - 1], wanted):
        return None
    data, at = ids.tobytes(), (4 * cuts).tolist()
    return [data[i:k] for i, k in zip([0, *at], at)]


def alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = sorted({*range(256)} - shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE of a tokenizers file; special strings inside texts are ordinary text."""

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        shape = json.loads(self.tokenizer.to_str())
        splitter = shape["pre_tokenizer"] or {}
        self.by_word = (shape["normalizer"] is None and splitter.get("type") == "ByteLevel" and splitter["use_regex"]
                        and not splitter["add_prefix_space"])
        known, shown = self.tokenizer.get_vocab(with_added_tokens=False), alphabet()
        byte = {c: b for b, c in shown.items()}
        #: Bytes of each id; ids without bytes are special and never occur.
        self.bytes: list[bytes] = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            if all(c in byte for c in token):
                self.bytes[i] = bytes(byte[c] for c in token)
        self.sizes = np.array([len(b) for b in self.bytes])
        # A merge of ranks gives the ids of the listed merges if every token alone is one id: within the borders of a
        # token the smaller merges have left exactly the two parts of its own merge.
        plain = {b: i for i, b in enumerate(self.bytes) if b}
        alone = self.tokenizer.model.tokenize
        self.ranked = None
        if self.by_word and all(len(t := alone("".join(map(shown.get, b)))) == 1 and t[0].id == i for b, i in plain.items()):
            import tiktoken
            from public_tokenizers import PATTERN

            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def words(self, parts: list[str]) -> list[bytes]:
        """Ids of each " " + part; Latin words by ranks, where splitters of any age agree on what a letter is."""
        out = dict.fromkeys(parts)
        latin = [p for p in parts if p and max(p) < LATIN and not p[0].isspace() and not p[-1].isspace()] if self.ranked else []
        out.update(zip(latin, (latin and dealt(latin, self.ranked.encode_ordinary, self.sizes)) or ()))
        return [np.array(self._ids(" " + p), "<u4").tobytes() if ids is None else ids for p, ids in out.items()]


def fields(message: bytes):
    """(field number, integer or bytes) of a protocol buffer message."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[i]
            value, shift, i = value | (byte & 127) << shift, shift + 7, i + 1
            if byte < 128:
                return value, i

    i = 0
    while i < len(message):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = message[i:i + size], i + size
        yield tag >> 3, value


class Pieces:
    """A sentencepiece model, and what can be read from its file: its normaliser, the pieces' bytes, where words may be cut."""

    #: A message that switches the normaliser off; fields of a later message win.
    BARE = bytes([3 << 3 | 2, 8, 2 << 3 | 2, 0, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
    #: Kinds of pieces in the file.
    OWN, BYTE, NORMAL = 4, 6, 1

    def __init__(self, file: str):
        import sentencepiece

        with open(file, "rb") as f:
            raw = f.read()
        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=raw + self.BARE)
        parts = list(fields(raw))
        kinds = [(p[1].decode(), p.get(3, self.NORMAL)) for p in (dict(fields(v)) for k, v in parts if k == 1)]
        self.normalizer = dict(fields(b"".join(v for k, v in parts if k == 3)))
        #: The blank stands behind words, not before them.
        self.suffix = any(dict(fields(v)).get(24) for k, v in parts if k == 2)
        self.own = [p for p, kind in kinds if kind == self.OWN]
        #: Pieces as bytes of normalised text, and with blanks in place of U+2581; control and unknown pieces are empty.
        self.raw = [bytes([int(p[3:5], 16)]) if kind == self.BYTE else p.encode() if kind in (self.NORMAL, self.OWN) else b"" for p, kind in kinds]
        self.bytes = [b if kind == self.BYTE else b.replace(BAR.encode(), b" ") for b, (_, kind) in zip(self.raw, kinds)]
        spelt = [p for p, kind in kinds if kind in (self.NORMAL, self.OWN)]
        #: No piece goes on behind a word with the bar of the next one, so no merge crosses that border.
        self.by_word = not self.suffix and not any(BAR in p.lstrip(BAR) for p in spelt)
        self.sizes = np.array([len(b) for b in self.raw])
        #: The normaliser only adds the leading blank and writes bars for blanks.
        n = self.normalizer
        self.plain = not n.get(2) and bool(n.get(3, 1)) and not n.get(4, 1) and bool(n.get(5, 1)) and not self.own

    def words(self, parts: list[str]) -> list[bytes]:
        """Ids of each word of normalised text behind a bar."""
        even = [p for p in parts if p and p[0] != BAR and p[-1] != BAR]
        out = dict.fromkeys(parts) | dict(zip(even, (even and dealt(even, self.bare.encode, self.sizes, BAR)) or ()))
        return [np.array(self.bare.encode(BAR + p), "<u4").tobytes() if ids is None else ids for p, ids in out.items()]


_LOADED: dict[tuple, object] = {}


def loaded(kind, file):
    """One tokenizer per worker and file."""
    if (kind, file) not in _LOADED:
        _LOADED[kind, file] = kind(file)
    return _LOADED[kind, file]


def windows(batches, column: str = "text", most: int = 1 << 20):
    """Slices of the batches with about `most` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        first = filled = 0
        for i, n in enumerate(sizes.tolist()):
            if i > first and filled + n > most:
                yield batch.slice(first, i - first)
                first, filled = i, 0
            filled += n
        if first < batch.num_rows:
            yield batch.slice(first)
