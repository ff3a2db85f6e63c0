"""Packing token sequences by minimum bin slack.

Every input partition packs its own documents in windows of rows, so nothing is shuffled. Documents of more than a
sequence give their full sequences first; what remains of each document is an item. For each sequence the longest item
left is taken, and a bitset subset-sum over the multiset of remaining lengths finds the choice that fills the rest
closest to capacity (one Python integer holds the reachable sums; doubling the counts keeps one shift per power of
two; the choice is read back length by length). What is missing then is cut from the longest item left. The last items
of a window fill sequences whose sizes are powers of two, which need no padding, so no sequence is padded at all.

The ids are those of the named tokenizer, followed by `END`. Pieces of white-space delimited text are tokenised once
per worker and remembered in a cache of bounded size: the tokenizer never merges across white space. The strings of the
vocabulary's special tokens inside a text are read as the tokenizer reads them when loaded: as these tokens; texts that may
hold one, and all texts if the vocabulary cuts words by other rules than `RULES`, are tokenised whole.

Defined cases: null or empty text is the single id `END`; rows that repeat are packed each for itself; a null doc_id
is kept; texts of any length are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from rillwave.llm.common import table

END = 2
CAPACITY = 4096
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 600_000
#: Documents packed together; bounds a task's memory, not what is packed.
WINDOW = 2000

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


#: The normaliser and splitter for which words may be tokenised one by one.
RULES = ({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
         {"type": "Sequence", "pretokenizers": [
             {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
             {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids(dict):
    """Ids (little-endian uint32 bytes) of a piece of text without ASCII blanks or line ends."""

    #: An apostrophe-free piece that ends in a letter or digit may lose its tail: both parts tokenise as they did together.
    PARTS = re.compile(r"([^']*[^\W_])([.,!#$%&*;:?)]+)")
    #: Letters before this point are composed, and their lower case is the same everywhere.
    LATIN = "\u0250"
    #: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 in order.
    SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
    ALPHABET = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - SHOWN))}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shape = json.loads(self.tokenizer.to_str())
        self.by_word = (shape["normalizer"], shape["pre_tokenizer"]) == RULES
        special = shape["added_tokens"]
        #: First two characters of the special tokens; a text without them holds none.
        self.heads = {t["content"][:2] for t in special}
        self.by_word &= not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in special)

    def word(self, low: str) -> bytes:
        """Ids of a run of lower-case Latin letters: one token of the splitter, so only the merges are left to do."""
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.ALPHABET)
        ids = [t.id for t in self.model.tokenize(low)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        low = piece.lower()
        if piece.isalpha() and low.isalpha() and max(piece + low) < self.LATIN:
            ids = self.word(low) if piece == low else self[low]
        elif (m := self.PARTS.fullmatch(piece)) and m[1][-1].lower().isalpha():
            ids = self[m[1]] + self[m[2]]
        elif piece.isascii() and piece != low:
            ids = self[low]
        else:
            ids = self.whole(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        if not self.by_word or any(h in text for h in self.heads):
            return self.whole(text) + END_BYTES
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) + END_BYTES


END_BYTES = END.to_bytes(4, "little")
_KNOWN: dict[str, Ids] = {}


def token_ids(path: str) -> Ids:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _KNOWN:
        _KNOWN[path] = Ids(path)
    return _KNOWN[path]


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The multiset of lengths (with at most counts[length] of each) whose sum is nearest to `room` from below."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, chunk = left - take, chunk * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token of every document once; none needs padding."""
    sequences, items = [], {}
    for doc, n in enumerate(lengths):
        full = n // capacity
        sequences += [[(doc, k * capacity, capacity)] for k in range(full)]
        if n % capacity:
            items.setdefault(n % capacity, []).append((doc, full * capacity))
    left = sum(n * len(v) for n, v in items.items())

    def taken(n: int) -> tuple[int, int, int]:
        doc, start = items[n].pop()
        if not items[n]:
            del items[n]
        return doc, start, n

    while left:
        size = capacity if left >= capacity else 1 << (left.bit_length() - 1)
        room, row = size, []
        longest = max(items)
        if longest <= room:
            row.append(taken(longest))
            room -= longest
        for n in fullest({n: len(v) for n, v in items.items()}, room) if room else ():
            row.append(taken(n))
            room -= n
        if room:                                  # nothing fits exactly: cut what is missing from the longest left
            doc, start, n = taken(max(items))
            row.append((doc, start, room))
            items.setdefault(n - room, []).append((doc, start + room))
        sequences.append(row)
        left -= size
    return sequences


def _pieces(docs: pd.DataFrame, ids: Ids, first: int) -> tuple[pd.DataFrame, int]:
    tokens = [ids.of(t if isinstance(t, str) else "") for t in docs["text"]]
    packed = pack([len(t) // 4 for t in tokens])
    rows = []
    for k, row in enumerate(packed):
        at = 0
        for doc, start, n in row:
            rows.append((doc, start, n, zlib.crc32(memoryview(tokens[doc])[4 * start:4 * (start + n)]),
                         len(tokens[doc]) // 4, first + k, at))
            at += n
    out = pd.DataFrame(rows, columns=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    out.insert(0, "doc_id", docs["doc_id"].array.take(out.pop("doc")) if len(out) else pd.Series([], dtype="Int64"))
    return out, first + len(packed)


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece of a document in a sequence of at most `CAPACITY` tokens."""
    path = path or vocabulary()

    def packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, number = token_ids(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = pd.DataFrame({"doc_id": batch.column(0).to_pandas(integer_object_nulls=True).astype("Int64"),
                                 "text": batch.column(1).to_pandas()})
            for i in range(0, len(rows), WINDOW):
                out, number = _pieces(rows.iloc[i:i + WINDOW].reset_index(drop=True), ids, number)
                yield pa.RecordBatch.from_pandas(out, schema=_ARROW, preserve_index=False)

    return docs.select("doc_id", "text").mapInArrow(packer, SCHEMA)


_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def op8_packing(spark, sf_dir):
    """All documents packed into sequences without padding."""
    return pieces(table(spark, sf_dir, "documents"))
