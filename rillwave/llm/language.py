"""Language identification by error-correcting output codes.

Every language gets a codeword of `BITS` bits. One binary classifier per bit scores hashed byte n-grams: the
log-ratio of an n-gram's frequency under the languages whose bit is 1 to that under those whose bit is 0, averaged
over the text's n-grams. The counts behind it are sums over all training rows, added up in the tasks before a
shuffle, so training needs no sample. A second pass measures, per language and bit, how often the classifier is right;
decoding weighs each bit's loss by that and takes the nearest codeword. A text whose two nearest codewords lie within
`AMBIGUOUS` of each other is flagged.

Defined cases: null, empty and letter-less texts are `und` with score 0; training rows need text with a letter and a
lang; without any training row every text is `und`; ties go to the language that comes first in code-point order;
repeated rows are judged alike; texts are read whole; extra columns are kept by `with_language`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import table

#: Size of the hashed n-gram table, lengths of n-grams, bits of a codeword.
SLOTS = 1 << 14
ORDERS = (1, 2, 3, 4)
BITS = 15
#: Sharpness of the averaged log-ratio, pseudo-count, and the gap of losses below which two languages are too close.
SHARPNESS = 4.0
PSEUDO = 0.5
AMBIGUOUS = 0.02
#: Bytes of text that are turned into n-grams at once.
CHUNK = 1 << 20
#: Sums of a language are added up in blocks of this many slots, each by a task of its own.
BLOCK = 1 << 10

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def histograms(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts, a row per text. Only letters count; whatever stands between words is one blank."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        for at in range(0, len(raw), CHUNK):
            b = _FOLD[raw[at:at + CHUNK]]
            b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
            b = np.concatenate([[32], b, [32]]).astype(np.uint32)
            h = np.zeros(len(b), np.uint32)
            for n in range(1, max(ORDERS) + 1):
                h = (h[:len(b) - n + 1] * np.uint32(0x01000193)) ^ (b[n - 1:] + np.uint32(n << 8))
                if n in ORDERS and len(h):
                    slot = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOTS.bit_length() + 1)
                    out[i] += np.bincount(slot, minlength=SLOTS)
    return out


def codewords(languages: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """A +-1 matrix whose rows lie far apart: the best of random codes without constant columns; fixed by the seed."""
    if languages < 2:
        return np.ones((languages, 1))
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(2000):
        code = np.where(rng.random((languages, bits)) < 0.5, 1.0, -1.0)
        constant = np.abs(code.sum(0)) == languages
        code[0, constant] *= -1
        apart = min(int((code[i] != code[j]).sum()) for i in range(languages) for j in range(i))
        if apart > most:
            best, most = code, apart
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray            # languages x bits
    slopes: np.ndarray          # slots x bits
    weights: np.ndarray         # languages x bits, each row sums to 1

    def outputs(self, hist: np.ndarray) -> np.ndarray:
        return np.tanh(SHARPNESS * (hist @ self.slopes) / np.maximum(hist.sum(1, keepdims=True), 1.0))

    def losses(self, outputs: np.ndarray) -> np.ndarray:
        """Weighted loss of each text to each codeword, between 0 and 1."""
        return ((1 - outputs[:, None, :] * self.code[None]) / 2 * self.weights[None]).sum(2)


def _judge(model: Model, texts: pd.Series) -> pd.DataFrame:
    n = len(texts)
    pred, score, gap = np.full(n, "und", object), np.zeros(n), np.zeros(n)
    fit = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
    for at in range(0, len(fit), 256):
        some = fit[at:at + 256]
        loss = model.losses(model.outputs(histograms([texts.iloc[i] for i in some])))
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(some))
        best = loss[rows, order[:, 0]]
        pred[some] = np.array(model.languages, object)[order[:, 0]]
        score[some] = np.clip(1 - best, 0, 1)
        gap[some] = loss[rows, order[:, 1]] - best if len(model.languages) > 1 else 1.0
    return pd.DataFrame({"lang_pred": pred, "score": score, "margin": gap, "ambiguous": (pred != "und") & (gap < AMBIGUOUS)})


def _labelled(docs: DataFrame) -> DataFrame:
    """Rows to learn from: a language, and a doc_id outside the fold that is held out (remainder 2)."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("text", "lang")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _summed(docs: DataFrame, width: int, of) -> dict[str, np.ndarray]:
    """Per language, the sum over all rows of `of(texts)` (rows x width).

    A task sends one row per language and block of slots that is not zero; blocks are added up apart from each other, so a
    language that holds most rows is no single task's work.
    """
    schema = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("part", pa.binary())])

    def packed(total: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
        keys = list(total)
        return pa.RecordBatch.from_pydict({"lang": [k for k, _ in keys], "block": [b for _, b in keys],
                                           "part": [total[k].astype("<f8").tobytes() for k in keys]}, schema=schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = [(t, k) for t, k in zip(some["text"].to_pylist(), some["lang"].to_pylist()) if has_letter(t)]
                if rows:
                    values, langs = of([t for t, _ in rows]), np.array([k for _, k in rows], object)
                    for lang in dict.fromkeys(langs):
                        total[lang] = total.get(lang, 0) + values[langs == lang].sum(0, dtype=np.float64)
        parts = {(k, at // BLOCK): v[at:at + BLOCK] for k, v in total.items() for at in range(0, width, BLOCK)}
        yield packed({k: v for k, v in parts.items() if v.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, block, part in zip(*(batch[c].to_pylist() for c in schema.names)):
                total[lang, block] = total.get((lang, block), 0) + np.frombuffer(part, "<f8")
        yield packed(total)

    shape = "lang string, block int, part binary"
    out: dict[str, np.ndarray] = {}
    for r in docs.mapInArrow(sums, shape).repartition("lang", "block").mapInArrow(add, shape).collect():   # languages x blocks
        part = np.frombuffer(bytes(r["part"]), "<f8")
        out.setdefault(r["lang"], np.zeros(width))[r["block"] * BLOCK:r["block"] * BLOCK + len(part)] = part
    return out


def fit(docs: DataFrame) -> Model:
    """Learn from text and lang of all rows that may be learnt from."""
    train = _labelled(docs)
    counts = _summed(train, SLOTS, histograms)
    languages = tuple(sorted(counts))
    if not languages:
        return Model((), np.ones((0, 1)), np.zeros((SLOTS, 1)), np.ones((0, 1)))
    code = codewords(len(languages))
    share = np.stack([counts[k] / counts[k].sum() for k in languages])      # each language counts alike
    total = sum(v.sum() for v in counts.values())
    slopes = np.zeros((SLOTS, code.shape[1]))
    for b in range(code.shape[1]):
        one, none = (share[code[:, b] == s] for s in (1, -1))
        floor = PSEUDO / total
        slopes[:, b] = np.log(one.mean(0) + floor if len(one) else np.full(SLOTS, floor)) - np.log(
            none.mean(0) + floor if len(none) else np.full(SLOTS, floor))
    even = Model(languages, code, slopes.astype(np.float32), np.full(code.shape, 1 / code.shape[1]))
    right = _summed(train, code.shape[1] + 1, lambda texts: np.column_stack(
        [even.outputs(histograms(texts)) > 0, np.ones(len(texts))]).astype(np.float64))
    weights = np.stack([np.where(code[i] > 0, s[:-1], s[-1] - s[:-1]) / s[-1] for i, s in ((i, right[k]) for i, k in enumerate(languages))])
    weights = np.maximum(weights, 1e-6)
    return Model(languages, code, even.slopes, weights / weights.sum(1, keepdims=True))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with __language: lang_pred, score, margin, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)                 # slots x bits, whatever the input's size

    @F.pandas_udf("lang_pred string, score double, margin double, ambiguous boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return _judge(shared.value, texts)

    return docs.withColumn("__language", judge(F.col("text")))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, ambiguous for every row."""
    rows = with_language(docs.select("doc_id", "text", "lang"), fit(docs))
    return rows.select("doc_id", held_out().alias("held_out"), "__language.*")


def accepted(docs: DataFrame) -> DataFrame:
    """Documents in a known language; `und` ones go. A text between two languages is still one of a language and stays."""
    rows = with_language(docs, fit(docs))
    return rows.where(F.col("__language.lang_pred") != "und").drop("__language")


def op1_language_id(spark, sf_dir):
    """Language of every document."""
    return identified(table(spark, sf_dir, "documents"))
