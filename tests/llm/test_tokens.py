"""Alignment, hard negatives and sentencepiece encoding against brute force and the libraries themselves."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rillwave.llm import alignment, hardneg, sentencepieces, tokens

DOCS = "doc_id long, text string, chunk long, links string, groups string"
SIGNS = ["hello", "world", "don't", "  ", "\n", "\t", "é", "漢字", "😀", "ﬁ", "\x00", "foo.", "bar,", "<|endoftext|>", "</s>", "<0x41>", " ", " ",
         "\x1c", "123", "4", "▁", "'s", "_", " ", "'"]


def mixed_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


# ---- SQL-free judges

class Judge:
    """Both libraries applied to whole texts, tokens compared one by one."""

    def __init__(self):
        self.a = Tokenizer.from_file(tokens.path(alignment.A_FILE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokens.path(alignment.B_FILE))
        self.byte = {c: b for b, c in tokens.alphabet().items()}

    def a_bytes(self, i):
        return bytes(self.byte[c] for c in self.a.id_to_token(i))

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return [], [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if not b"".join(map(self.a_bytes, a)) == (" " + text).encode() == b"".join(map(self.b_bytes, b)):
            return [], [], []
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        out, before = [], 0
        for end in sorted({*ends[0]} & {*ends[1]}):
            out.append(tuple([i for i, e in zip(ids, side) if before < e <= end] for ids, side in zip((a, b), ends)))
            before = end
        return a, b, out

    def rows(self, docs):
        found = [(i, *self.groups(t)) for i, t in docs]
        counts = Counter((ga[-1], gb[-1]) for *_, g in found for ga, gb in g)
        best = {}
        for (_, b), n in counts.items():
            best[b] = max(best.get(b, 0), n)
        for i, a, b, g in found:
            links = [(ga[-1], gb[-1]) for ga, gb in g]
            shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
            yield (i, len(a), len(b), len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                   hashlib.sha256(shown.encode()).hexdigest() if shown else "")


@pytest.fixture(scope="module")
def judge():
    return Judge()


# ---- alignment

def test_alignment_equals_brute_force(spark, judge, monkeypatch, tmp_path):
    docs = [(i, t) for i, t in enumerate(mixed_texts(1, 300))] + [(None, "hello world"), (7, "hello world"), (7, "hello world"), (900, None),
                                                                  (901, ""), (902, "▁"), (903, "the end\n" * 400), (904, "a" * 2000)]
    monkeypatch.setattr(alignment, "table", lambda s, d, n: spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], DOCS).repartition(5))
    got = alignment.op11_alignment(spark, "")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, judge.rows(docs)))


def test_alignment_of_no_rows(spark, monkeypatch):
    monkeypatch.setattr(alignment, "table", lambda s, d, n: spark.createDataFrame([], DOCS))
    assert alignment.op11_alignment(spark, "").collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8192])
def test_pieces_of_the_merge_path(size):
    rng = np.random.default_rng(size)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        parts = alignment.pieces(a, b, size)
        assert all(k - i + l - j <= size + 1 for i, k, j, l in parts)
        assert [x for i, k, _, _ in parts for x in range(i, k)] == list(range(len(a)))
        assert [x for *_, j, l in parts for x in range(j, l)] == list(range(len(b)))
        in_a, in_b = alignment.common_ends(a, b, size)
        assert a[in_a].tolist() == b[in_b].tolist() == sorted({*a.tolist()} & {*b.tolist()})


def test_words_keep_the_ids_of_whole_texts(judge, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    aligner = alignment.Aligner((tokens.path(alignment.A_FILE), tokens.path(alignment.B_FILE)))
    assert aligner.a.ranked and aligner.by_word
    for seed in range(20):
        texts = mixed_texts(100 + seed, 40)
        for t, (a, b) in zip(texts, aligner.ids(texts)):
            assert (a.tolist(), b.tolist()) == judge.groups(t)[:2], t


# ---- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, row long, v string, place int"


def vector_rows(kind, n=400):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        v = rng.integers(-4, 5, 3) / 4 if kind == "ties" else rng.normal(size=6) * (1, 5, .2, .1, .1, .1)
        rows.append((i, v.tolist(), int(rng.integers(0, 3)) if i % 2 else 1))
    v = rows[0][1]
    return rows + [(None, v, 1), (500, None, 1), (501, [], 1), (502, [None, *v[1:]], 1), (503, [float("nan"), *v[1:]], 1), (504, v, None),
                   (600, [float("inf"), *v[1:]], 1), (700, [1.0], 1), (701, [1.0], 2), (800, [0.0] * len(v), 1), (3, v, 2), (3, v, 2), (100, v, 0)]


@pytest.mark.parametrize("kind", ["ties", "normal"])
def test_hard_negatives_equal_sql(spark, monkeypatch, kind):
    monkeypatch.setattr(hardneg, "POINTS", 64)
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in vector_rows(kind)], VECTORS)
    monkeypatch.setattr(hardneg, "table", lambda s, d, n: frame)
    got = hardneg.op12_hard_negatives(spark, "")
    embeddings = frame.select("vec_id", "embedding", "label").toArrow()  # noqa: F841
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = duckdb.sql(f"SELECT {', '.join(names)} FROM ({hardneg.OP12_SQL})").fetchall()
    assert got.columns == names and len(want) > 20
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_hard_negatives_of_few_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    every = lambda i: i % 100 == 0
    assert hardneg.mined(frame([]), every).collect() == []
    assert hardneg.mined(frame([(0, [1.0], 1)]), every).collect() == []
    two = hardneg.mined(frame([(0, [1.0], 1), (1, [2.0], 1), (2, [1.7], 2), (3, [3.0], 2)]), every).collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, 2, 256 * 512, 256 * 435)]


def test_threshold_search_stops_early_and_is_exact():
    rng = np.random.default_rng(5)
    points = np.floor(256 * rng.normal(size=(4000, 6)) * (8, 2, .1, .1, .1, .1)).astype(np.int64)
    ids = rng.permutation(4000)
    lists = hardneg.Lists(ids, np.zeros(4000), points, float(np.abs(points).max()))
    everything, shares = [(int(np.iinfo(np.int64).min), int(np.iinfo(np.int64).max))], []
    for q in points[:50]:
        [(got, scores)], n = lists.search(q, np.ones(4000, bool), everything, 5)
        truth = points @ q
        best = np.lexsort((ids, -truth))[:5]
        assert got.tolist() == ids[best].tolist() and scores.tolist() == truth[best].tolist()
        shares.append(n / 4000)
    assert np.mean(shares) < 0.5


def test_scores_beyond_doubles_are_exact():
    points = np.array([[2**40, 1], [2**40, 2], [-2**62, 0]])
    lists = hardneg.Lists(np.arange(3), np.zeros(3), points, float(2**40))
    [(ids, scores)], _ = lists.search(np.array([2**20, 1]), np.ones(3, bool), [(-2**63, 2**63 - 1)], 3)
    assert ids.tolist() == [1, 0, 2] and scores.tolist() == [2**60 + 2, 2**60 + 1, -2**63]


# ---- sentencepiece

def test_sentencepiece_round_trip(spark, judge, monkeypatch):
    docs = [(i, t) for i, t in enumerate(mixed_texts(2, 300))] + [(None, "a b"), (5, "a b"), (5, "a b"), (900, None), (901, ""), (902, "né \n" * 50_000)]
    monkeypatch.setattr(sentencepieces, "table", lambda s, d, n: spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], DOCS).repartition(5))
    want = []
    for i, t in docs:
        ids = judge.b.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(judge.b.decode(ids).encode()).hexdigest()))
    got = sentencepieces.op13_sentencepiece(spark, "")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    assert sentencepieces.encoded(spark.createDataFrame([], DOCS)).collect() == []


def test_spans_tile_the_source(judge):
    encoder = sentencepieces.Encoder(tokens.path(sentencepieces.VOCABULARY))
    texts = mixed_texts(3, 500)
    for text, (ids, begin, end) in zip(texts, encoder(texts)):
        source = text.encode()
        assert ids.tolist() == judge.b.encode(text, add_bos=True, add_eos=True)
        inner = [source[b:e] for b, e in zip(begin[1:-1], end[1:-1])]
        assert b"".join(inner) == source
        for n, (i, own) in enumerate(zip(ids[1:-1].tolist(), inner)):
            spelt = judge.b_bytes(i).replace(b" ", "▁".encode())
            own = own.replace(b" ", "▁".encode())
            assert spelt == (own if n else "▁".encode() + own)


@pytest.fixture(scope="module")
def folding(tmp_path_factory):
    """The same pieces behind the library's own compiled map of compatibility forms, which also squeezes white space."""
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    with open(tokens.path(sentencepieces.VOCABULARY), "rb") as f:
        raw = f.read()
    spec = b"".join(v for k, v in tokens.fields(rules) if k == 3)
    size, n = b"", len(spec)
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    file = tmp_path_factory.mktemp("model") / "folding.model"
    file.write_bytes(raw + bytes([3 << 3 | 2]) + size + bytes([n]) + spec + bytes([3 << 3 | 2, 2, 4 << 3, 1]))
    return str(file)


def test_compiled_map_is_followed(folding):
    library = sentencepiece.SentencePieceProcessor(model_file=folding)
    encoder = sentencepieces.Encoder(folding)
    rng = random.Random(4)
    signs = "abc  \n\tzé▁漢😀ﬁ①㌀ｱ　é​ﷺÅ\x01é"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text, (ids, begin, end) in zip(texts, encoder(texts)):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        assert (begin <= end).all() and (np.diff(begin[1:-1]) >= 0).all() and end.max(initial=0) <= len(text.encode())


def test_replaced_bytes_map_to_the_whole_source(folding):
    encoder = sentencepieces.Encoder(folding)
    data, begin, end = encoder.normalize(" x ﬁ  é")
    assert data.decode() == "▁x▁fi▁é"
    at = data.decode().encode().index(b"fi")
    assert begin[at:at + 2].tolist() == [3, 3] and end[at:at + 2].tolist() == [6, 6]
    assert begin[:3].tolist() == end[:3].tolist() == [1, 1, 1] and (begin[-2:].tolist(), end[-2:].tolist()) == ([8, 9], [9, 10])
