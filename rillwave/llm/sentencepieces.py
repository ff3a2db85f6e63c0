"""Sentencepiece encoding that knows the source bytes of every piece, and decoding.

The model file carries its normaliser as a compiled character map: a double-array trie of source strings and the texts
that replace them. At each place of a text the longest source string wins; what no string covers is copied character
by character. The source bytes behind each byte of the result are recorded on the way, also through the removal of
extra white space, the added leading blank and the bar that stands for blanks. The merges then run on the normalised
text (the same model with its normaliser switched off), word by word where no piece crosses a word border, and each
piece's bytes are projected back: a piece covers the source of its first to its last byte. Copied bytes map to
themselves, so a byte piece covers one byte; all bytes of a replacement map to the whole string it replaces; the added
leading blank and the begin and end ids cover nothing.

Decoding is the library's.

Defined cases: null text is empty; an empty text is the begin and end id alone; rows that repeat are encoded each for
itself; a null doc_id is kept; texts of any length are read whole; an empty table gives no rows; extra columns are
ignored. A map's replacement that itself holds several blanks in a row loses the extra ones. Models that put the blank
behind a word are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwave.llm import tokens
from rillwave.llm.common import table
from rillwave.llm.tokens import BAR, Pieces

VOCABULARY = "piece_bpe_32k.model"


class CharacterMap:
    """The compiled map: four bytes of trie size, the trie's units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.texts = blob[4 + size:]

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << (unit >> 6 & 8)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest source string that begins at `at`, and its replacement; length 0 if there is none."""
        best, node = (0, b""), self._children(self.units[0]) if self.units else 0
        for i in range(at, len(data) if self.units else at):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            unit = self.units[node]
            node ^= self._children(unit)
            if unit >> 8 & 1:
                text = self.units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.texts[text:self.texts.index(0, text)]
        return best

    def begins(self, char: str) -> bool:
        """Whether any source string begins with `char`."""
        node = self._children(self.units[0]) if self.units else 0
        for byte in char.encode():
            node ^= byte
            if node >= len(self.units) or self.units[node] & 0x800000FF != byte:
                return False
            node ^= self._children(self.units[node])
        return True


class Normalizer:
    """Longest-prefix normalisation with the source bytes of every byte of its result."""

    def __init__(self, given: dict[int, int | bytes], kept: list[str] = ()):
        """`given` are the fields of the model's normaliser."""
        self.map = CharacterMap(given.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(given.get(k, 1)) for k in (3, 4, 5))
        #: Symbols of the user's own are copied as they are.
        self.kept = re.compile("|".join(map(re.escape, sorted(kept, key=len, reverse=True)))) if kept else None
        self.starts = lru_cache(maxsize=1 << 20)(lambda c: self.map.begins(c) or any(s.startswith(c) for s in kept))

    def _mapped(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the map, and begin and end in the source of each."""
        source = text.encode()
        whole = np.frombuffer(source, np.uint8)
        change = [c for c in set(text) if self.starts(c)]
        if not change:
            at = np.arange(len(whole))
            return whole, at, at + 1
        out, begin, end = [], [], []

        def copied(b: int, e: int):
            out.append(whole[b:e])
            begin.append(np.arange(b, e))
            end.append(np.arange(b + 1, e + 1))

        char = byte = done = 0                       # place in characters and in bytes, and the end of what is out
        for hit in re.finditer("[" + re.escape("".join(change)) + "]", text):
            if hit.start() < char:
                continue
            byte += len(text[char:hit.start()].encode())
            char = hit.start()
            if self.kept and (own := self.kept.match(text, char)):
                byte, char = byte + len(own[0].encode()), own.end()
                continue
            n, new = self.map.longest(source, byte)
            if n:
                copied(done, byte)
                out.append(np.frombuffer(new, np.uint8))
                begin.append(np.full(len(new), byte))
                end.append(np.full(len(new), byte + n))
                char += len(source[byte:byte + n].decode())
                byte = done = byte + n
        copied(done, len(whole))
        return np.concatenate(out), np.concatenate(begin), np.concatenate(end)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        data, begin, end = self._mapped(text)
        blank = data == 32
        if self.squeeze and len(data):
            solid = np.flatnonzero(~blank)
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            keep[solid[-1] + 1 if len(solid) else 0:] = False
            data, begin, end, blank = data[keep], begin[keep], end[keep], blank[keep]
        if not len(data):
            return b"", begin, end
        if self.prefix:
            data, blank = np.concatenate([[32], data]), np.concatenate([[True], blank])
            begin, end = np.concatenate([begin[:1], begin]), np.concatenate([begin[:1], end])
        if not self.escape:
            return data.astype(np.uint8).tobytes(), begin, end
        times = np.where(blank, len(BAR.encode()), 1)
        return data.astype(np.uint8).tobytes().replace(b" ", BAR.encode()), begin.repeat(times), end.repeat(times)


class Encoder:
    """ids of whole texts with their spans in the source."""

    PARTS = re.compile(f"{BAR}+[^{BAR}]*|[^{BAR}]+")

    def __init__(self, file: str):
        self.pieces = p = tokens.loaded(Pieces, file)
        if p.suffix:
            raise ValueError("models with the blank behind words are not supported")
        self.normalize = Normalizer(p.normalizer, p.own)
        self.words = tokens.Words(lambda parts: p.words(parts))
        self.edges = [np.array([i] if i >= 0 else [], np.int64) for i in (p.model.bos_id(), p.model.eos_id())]

    def _ids(self, texts: list[str]) -> list[bytes]:
        """ids of normalised texts; word by word where each word stands behind one bar."""
        even = [bool(t) and self.pieces.by_word and t[0] == BAR != t[-1] and BAR + BAR not in t for t in texts]
        found = self.words([t[1:].split(BAR) if e else [] for t, e in zip(texts, even)])
        return [b"".join(f) if e else np.array(self.pieces.bare.encode(t), "<u4").tobytes() for t, e, f in zip(texts, even, found)]

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text its ids, with begin and end id, and begin and end of each in the UTF-8 bytes of the text."""
        normal = [self.normalize(t) for t in texts]
        out = []
        for text, (data, begin, end), packed in zip(texts, normal, self._ids([n[0].decode() for n in normal])):
            ids = np.frombuffer(packed, "<u4").astype(np.int64)
            sizes = self.pieces.sizes[ids]
            if sizes.sum() != len(data):             # unknown pieces: their length is that of the text they stand for
                sizes = np.array([len(p.surface.encode()) for p in self.pieces.bare.encode(data.decode(), out_type="immutable_proto").pieces])
            last = np.cumsum(sizes)
            b, e = (begin[last - sizes], end[last - 1]) if len(ids) else (begin, end)
            edge = [np.full(len(x), at) for x, at in zip(self.edges, (0, len(text.encode())))]
            out.append(tuple(np.concatenate(x) for x in ((self.edges[0], ids, self.edges[1]), (edge[0], b, edge[1]), (edge[0], e, edge[1]))))
        return out


# ---- on Spark

SCHEMA = "doc_id bigint, ids array<int>, begins array<int>, ends array<int>, decoded string"


def encoded(docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id, ids, begins, ends (source bytes of each id) and the text that the ids decode to."""
    file = file or tokens.path(VOCABULARY)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.loaded(Encoder, file)
        for window in tokens.windows(batches):
            rows = encoder([t or "" for t in window.column("text").to_pylist()])
            columns = []
            for values in zip(*rows):
                offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32))))
            texts = encoder.pieces.model.decode([ids.tolist() for ids, _, _ in rows], num_threads=1)
            yield pa.RecordBatch.from_arrays([window.column("doc_id"), *columns, pa.array(texts, pa.string())],
                                             names=["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, SCHEMA)


def ids_sha256(ids: pd.Series) -> pd.Series:
    """SHA-256 of ids as little-endian unsigned 32-bit integers."""
    return ids.map(lambda v: hashlib.sha256(np.asarray(v, "<u4").tobytes()).hexdigest())


def op13_sentencepiece(spark, sf_dir):
    """Every document encoded and decoded again: number and digest of its ids, digest of the decoded text."""
    return encoded(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.pandas_udf(ids_sha256, "string")("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
