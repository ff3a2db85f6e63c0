"""Alignment of two tokenizers' ids over the same bytes, by merge-path partitioning.

A text is encoded by A (byte-level BPE, over " " + text) and by B (sentencepiece, which adds the blank). Where both
spell the same bytes, the places where a token of A and a token of B end together cut them into groups.

The ascending ends of A and of B, over all documents of a window of rows, are the two inputs of one merge. Diagonals of
the merge path at equal distances are found by binary search, all of them at once: piece number p begins where p * PIECE
ends have been passed in both inputs together. Pieces are therefore equal work, however long a document is or how
unevenly A and B cut it, and independent: each emits the ends that both of its stretches hold. A pair of equal ends
which a diagonal parts goes to the earlier piece. What a piece leaves open at its border is stitched: a group runs from
the last common end of any earlier piece to the next one. Every document ends with a common end, so no group crosses
documents.

Links and their counts: tokens have at least one byte, so a group's last ids are the only ones of it whose ranges end
together. Counts over the corpus are added before their shuffle. They come back to the documents by chunks: a window's
distinct pairs meet the counts, and the window's documents then look them up in the pairs of their own chunk, so that
what is joined is one row per pair and chunk, and no key holds more than a window.

Defined cases: null or empty texts, texts that A or B spells differently (such as those with U+2581) and texts with
no tokens give zeros and an empty digest; strings of special tokens are plain text; rows that repeat are aligned each
for itself and counted each; a null doc_id is kept; texts of any length are read whole; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwave.llm import tokens
from rillwave.llm.common import stored, table
from rillwave.llm.tokens import ByteLevel, Pieces

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ends of A and B together that a piece of the merge path holds.
PIECE = 8192


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of `a` the merge of `a` and `b` has passed after `at` steps (a before b where they are equal)."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        more = (low < high) & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(at - mid - 1, 0, len(b) - 1)])
        low, high = np.where(more, mid + 1, low), np.where(more, high, mid)
    return low


def pieces(a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    """The merge path in pieces of `size` steps, as stretches [i, k) of `a` and [j, l) of `b`."""
    at = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    i = diagonals(a, b, at) if len(a) and len(b) else np.minimum(at, len(a))
    j = at - i
    parted = (i > 0) & (j < len(b))
    parted[parted] = a[i[parted] - 1] == b[j[parted]]
    j = j + parted
    return list(zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist()))


def common_ends(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in `a` and in `b` (both ascending, without repeats) of the ends that both hold, piece by piece."""
    in_a, in_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, k, j, l in pieces(a, b, size):
        if i < k and j < l:
            place = np.searchsorted(b[j:l], a[i:k])
            hit = np.flatnonzero(b[j:l][np.minimum(place, l - j - 1)] == a[i:k])
            in_a.append(i + hit)
            in_b.append(j + place[hit])
    return np.concatenate(in_a), np.concatenate(in_b)


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, files: tuple[str, str]):
        self.a, self.b = tokens.loaded(ByteLevel, files[0]), tokens.loaded(Pieces, files[1])
        self.b_sizes = np.array([len(x) for x in self.b.bytes])
        self.words = tokens.Words(self._words)
        self.by_word = self.a.by_word and self.b.by_word and self.b.plain
        #: Decimal ids with the sign behind them: within a side, at its end, and at the end of the group.
        self.shown = np.array([str(i) + sign for t in (self.a, self.b) for i in range(len(t.bytes)) for sign in ",|;"], object)

    def _spelt(self, text: str, a: bytes, b: bytes) -> bool:
        """Whether the ids of A and of B spell the text, each with at least one byte."""
        wanted = text.encode()
        return all(all(found := [t.bytes[i] for i in np.frombuffer(ids, "<u4").tolist()]) and b"".join(found) == wanted
                   for t, ids in ((self.a, a), (self.b, b)))

    def _words(self, parts: list[str]) -> list[tuple[bytes, bytes] | bool]:
        """ids of A and of B of each word behind its blank; False where they spell other bytes."""
        both = list(zip(self.a.words(parts), self.b.words([p.replace(" ", tokens.BAR) for p in parts])))
        if self._spelt("".join([" " + p for p in parts]), *map(b"".join, zip(*both))):
            return both
        return [ids if self._spelt(" " + p, *ids) else False for p, ids in zip(parts, both)]

    def _whole(self, text: str) -> list[tuple[bytes, bytes] | bool]:
        a = np.array(self.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, "<u4").tobytes()
        b = np.array(self.b.model.encode(text), "<u4").tobytes()
        return [(a, b) if self._spelt(" " + text, a, b) else False]

    def ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids of A and B of each text; none where they do not spell " " + text."""
        given = [t if t and tokens.BAR not in t else "" for t in texts]
        found = self.words([tokens.words(t) if t else [] for t in given]) if self.by_word else [self._whole(t) if t else [] for t in given]
        none = (b"", b"")
        sides = [tuple(map(b"".join, zip(*f))) if f and False not in f else none for f in found]
        return [tuple(np.frombuffer(s, "<u4").astype(np.int64) for s in two) for two in sides]

    def __call__(self, texts: list[str | None]) -> dict[str, list]:
        """n_a, n_b, groups (as text) and links (A's id in the upper, B's in the lower half) of each text."""
        both = self.ids(texts)
        a, b = (np.concatenate([x[side] for x in both] or [np.zeros(0, np.int64)]) for side in (0, 1))
        n_a, n_b = ([len(x[side]) for x in both] for side in (0, 1))
        last_a, last_b = common_ends(np.cumsum(self.a.sizes[a]), np.cumsum(self.b_sizes[b]))
        # A's tokens of a group, then B's: a token's group decides where it stands
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        code = np.concatenate([a, b + len(self.a.bytes)])
        sign = np.zeros(len(code), np.int8)
        sign[last_a], sign[len(a) + last_b] = 1, 2
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        shown = self.shown[3 * code[order] + sign[order]].tolist()
        links = a[last_a] << 32 | b[last_b]
        ends = np.cumsum([0, *map(sum, zip(n_a, n_b))]).tolist()
        cuts = np.searchsorted(last_a, np.cumsum([0, *n_a]))
        return {"n_a": n_a, "n_b": n_b, "groups": ["".join(shown[i:k])[:-1] for i, k in zip(ends, ends[1:])], "links": links, "cuts": cuts}


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, groups string, links array<bigint>, chunk bigint"


def aligned(docs: DataFrame, a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """Per document n_a, n_b, its groups as text (`a1,a2|b1;...`), its links, and the window it was aligned in."""
    files = a_file or tokens.path(A_FILE), b_file or tokens.path(B_FILE)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = tokens.loaded(Aligner, files)
        for number, window in enumerate(tokens.windows(batches)):
            found = aligner(window.column("text").to_pylist())
            links = pa.ListArray.from_arrays(pa.array(found["cuts"].astype(np.int32)), pa.array(found["links"]))
            chunk = TaskContext.get().partitionId() << 32 | number
            yield pa.RecordBatch.from_arrays(
                [window.column("doc_id"), pa.array(found["n_a"], pa.int64()), pa.array(found["n_b"], pa.int64()),
                 pa.array(found["groups"], pa.string()), links, pa.array(np.full(window.num_rows, chunk, np.int64))],
                names=["doc_id", "n_a", "n_b", "groups", "links", "chunk"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(align, ALIGNED)


def link_counts(links: DataFrame) -> DataFrame:
    """pair, n, best: how many links hold each pair, and whether no pair of its B id has more."""
    counts = links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    counts = stored(counts.withColumn("b", b))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of the documents of one chunk."""
    known = pairs["pair"].to_numpy()
    order = np.argsort(known)
    n, best = pairs["n"].to_numpy()[order], pairs["best"].to_numpy()[order]
    lists = docs["links"].combine_chunks()
    at = np.searchsorted(known[order], lists.flatten().to_numpy())
    cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[cuts])
    names = [c for c in docs.column_names if c not in ("links", "chunk")]
    return pa.table([*[docs[c] for c in names], pa.array(total(best[at].astype(np.int64))), pa.array(total(n[at]))],
                    names=[*names, "n_best", "count_sum"])


def scored(links: DataFrame) -> DataFrame:
    """n_best and count_sum beside the columns of a stored table with `links` and `chunk`, these two left out."""
    met = links.select("chunk", F.explode("links").alias("pair")).distinct().join(link_counts(links), "pair")
    met = met.select(F.col("chunk").alias("of"), "pair", "n", "best")
    kept = [f"{c} {t}" for c, t in links.dtypes if c not in ("links", "chunk")]
    return (links.groupBy("chunk").cogroup(met.groupBy("of"))
            .applyInArrow(_looked_up, ", ".join([*kept, "n_best bigint", "count_sum bigint"])))


def op11_alignment(spark, sf_dir):
    """Byte-level and sentencepiece tokens of every document aligned; counts of linked ids over the corpus."""
    own = stored(aligned(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_a", "n_b", F.size("links").cast("long").alias("n_groups"), F.size("links").cast("long").alias("n_links"),
        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"), "links", "chunk"))
    return scored(own).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
