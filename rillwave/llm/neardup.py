"""Near duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A document is its set of distinct `WIDTH`-word shingles. Equal sets are one class from the start, so copies cost one
signature and one comparison. A class's signature has `SLOTS` slots of 16 bits; two sets with similarity 0.85 differ in
15 % of the slots, and pairs up to `RADIUS` differing slots are guaranteed to meet: the signature is cut into `CHUNKS`
chunks of four slots, and by the pigeonhole principle (RADIUS = CHUNKS + LOOSE - 1) either one of the first LOOSE chunks
differs in at most one slot or one of the others in none. One error is enumerated by leaving out each slot in turn. At
0.85 the chance of more than RADIUS differing slots is below 1e-5.

Links are confirmed on full sets. First every class is compared with the least class of each of its buckets; what is
then still apart in a bucket is compared pair by pair, in blocks of `BLOCK` classes, so no bucket meets in one task.
There a wider signature (`WIDE` slots of 4 bits) and the sizes decide which pairs go on to the full sets: first likely
links (at most `LIKELY` slots differ, which is the mean at 0.85), of which each task sends no more than connect its
classes, then, between the components so found, all up to `WIDE_RADIUS`, four standard deviations beyond that mean.
Pairs inside a component that is already linked are left out: they can change nothing.

Defined cases: null, empty and word-less texts have an empty set and are linked with nothing; a text of fewer than
WIDTH words is one shingle; rows that repeat or share a doc_id fall into classes like all others; a null doc_id is
never the smallest of a component that has another; an empty table gives no rows; extra columns are kept by
`deduplicated`, ignored by `linked`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwave.llm.common import stored, table
from rillwave.llm.components import components
from rillwave.llm.shingles import Signer, digest, mixed, shingle_set

WIDTH = 3
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
SLOTS, CHUNKS, LOOSE, RADIUS = 64, 16, 8, 23
WIDE, WIDE_RADIUS, LIKELY = 2048, 351, 288
BLOCK = 2048
#: Buckets up to this size are compared together; pairs compared at once; members of buckets that share a task.
SMALL, PAIRS, SHARED = 32, 1 << 16, 10_000

_DIFFERENT = np.array([((x & 15) > 0) + ((x >> 4) > 0) for x in range(256)], np.uint8)


def _batches(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


def _profiles(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
                        ("signature", pa.binary())])

    def run(batches):
        sign = Signer(SLOTS)
        for batch in batches:
            for some in _batches(batch, 500):
                known, out = {}, []
                for text in some["text"].to_pylist():
                    shingles = shingle_set(text, width)
                    key = digest(shingles)
                    if key not in known:
                        known[key] = (sign(shingles) >> np.uint64(48)).astype("<u2").tobytes() if len(shingles) else b""
                    out.append((len(shingles), key, known[key]))
                n, keys, signatures = zip(*out)
                yield pa.RecordBatch.from_arrays([some["doc_id"].cast(pa.int64()), some["text_hash"], pa.array(n, pa.int64()),
                                                  pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], schema=schema)
    return run


def _keys(batches):
    """Bucket keys of each class: four-slot chunks, and three-slot parts of the loose chunks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch["node"].to_numpy()
        slots = np.frombuffer(b"".join(batch["signature"].to_pylist()), "<u2").reshape(len(node), SLOTS).astype(np.uint64)
        keys = bucket_keys(slots)
        yield pa.RecordBatch.from_arrays([pa.array(keys.T.reshape(-1).view(np.int64)), pa.array(np.tile(node, keys.shape[1]))],
                                         names=["key", "node"])


def bucket_keys(slots: np.ndarray) -> np.ndarray:
    """rows x (5 for no chunk: LOOSE * 4 + CHUNKS - LOOSE) keys; a key also tells its chunk and left-out slot."""
    per, keys = SLOTS // CHUNKS, []
    for c in range(CHUNKS):
        chunk = slots[:, c * per:(c + 1) * per]
        for out in (range(per) if c < LOOSE else [None]):
            k = np.full(len(slots), c * 8 + (7 if out is None else out), np.uint64)
            for j in range(per):
                if j != out:
                    k = mixed(k + chunk[:, j] + np.uint64(1))
            keys.append(k)
    return np.stack(keys, axis=1)


def _close_sizes(a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _hamming(pairs: DataFrame) -> DataFrame:
    """Pairs whose signatures lie within RADIUS."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2").reshape(-1, SLOTS) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= RADIUS))
    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(node, shingles, wide): full sets and wide signatures of the classes in `needed` (node, first, digest)."""
    def run(batches):
        sign = Signer(WIDE, seed=13)
        for batch in batches:
            for some in _batches(batch, 200):
                out = []
                for text, node, key in zip(*(some[c].to_pylist() for c in ("text", "node", "digest"))):
                    shingles = shingle_set(text, width)
                    if digest(shingles) == key:
                        low = (sign(shingles) & np.uint64(15)).astype(np.uint8)
                        out.append((node, shingles.astype("<u8").tobytes(), (low[::2] << 4 | low[1::2]).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))],
                                                     names=["node", "shingles", "wide"])
    return (docs.select("doc_id", "text").join(needed, F.col("doc_id").eqNullSafe(F.col("first")))
            .select("node", "digest", "text").mapInArrow(run, "node bigint, shingles binary, wide binary"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that are similar enough on their full sets."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["xa"].to_pylist(), batch["xb"].to_pylist()):
                both = np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True).size
                keep.append(100 * both >= PERCENT * ((len(x) + len(y)) // 8 - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"x{c}")) for c in "ab")
    return (pairs.join(a, "a").join(b, "b").select("a", "b", "xa", "xb")
            .mapInArrow(run, "a bigint, b bigint"))


def _joining(x, y) -> list[int]:
    """Places of the pairs that connect what the pairs before them do not."""
    root: dict[int, int] = {}

    def find(v):
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = up
        return v

    out = []
    for i, (p, q) in enumerate(zip(x.tolist(), y.tolist())):
        if (p := find(p)) != (q := find(q)):
            root[q] = p
            out.append(i)
    return out


def _apart(members: DataFrame, groups: int, likely: bool) -> DataFrame:
    """Pairs of one bucket that are not linked yet and may be similar.

    `members`: key, parts (blocks of the bucket), node, label, n, signature, wide. Small buckets share a task; the
    blocks of a large one meet two by two. A pair that shares several buckets comes from the first of them only.
    """
    crowd = F.col("parts") > 1
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    ranged = (members.withColumn("part", part)
              .withColumn("grp", F.when(crowd, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups))))
              .withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
                  F.when(crowd, F.least("part", j)).otherwise(-1).alias("i"), F.when(crowd, F.greatest("part", j)).otherwise(-1).alias("j"))))))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["key"].to_numpy(), kind="stable")))
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        key, node, label, n, part = (rows[c].to_numpy() for c in ("key", "node", "label", "n", "part"))
        slots = np.frombuffer(b"".join(rows["signature"].to_pylist()), "<u2").reshape(len(node), SLOTS)
        wide = np.frombuffer(b"".join(rows["wide"].to_pylist()), np.uint8).reshape(len(node), WIDE // 2)
        keys = bucket_keys(slots.astype(np.uint64))
        at = (keys == key.view(np.uint64)[:, None]).argmax(1)      # which of a row's keys this bucket is
        found = []

        def judge(x, y):
            for test in (lambda: label[x] != label[y],
                         lambda: 100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]),
                         lambda: (keys[x] == keys[y]).argmax(1) == at[x],
                         lambda: (slots[x] != slots[y]).sum(1) <= RADIUS,
                         lambda: _DIFFERENT[wide[x] ^ wide[y]].sum(1, dtype=np.int32) <= (LIKELY if likely else WIDE_RADIUS)):
                keep = test()
                x, y = x[keep], y[keep]
            found.append((np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), label[x], label[y]))

        if i != j:
            left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
            for x in left:
                judge(np.full(len(right), x), right)
        else:
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(begin, len(key)))
            for m in np.unique(size[size > 1]):
                own = begin[size == m]
                if m > SMALL:
                    for b in own:
                        for x in range(b, b + m - 1):
                            judge(np.full(b + m - 1 - x, x), np.arange(x + 1, b + m))
                    continue
                x, y = np.triu_indices(m, 1)
                step = max(1, PAIRS // len(x))
                for k in range(0, len(own), step):
                    judge((own[k:k + step, None] + x).ravel(), (own[k:k + step, None] + y).ravel())
        a, b, p, q = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        if likely:
            a, b = (c[_joining(p, q)] for c in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return (ranged.select("grp", "pair.i", "pair.j", "key", "part", "node", "label", "n", "signature", "wide")
            .groupBy("grp", "i", "j").applyInArrow(compare, "a bigint, b bigint"))


def linked(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n_shingles, group (a label of the component; null without words), component_id, kept."""
    rows = stored(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _profiles(width), "doc_id bigint, text_hash bigint, n bigint, digest binary, signature binary"))
    classes = stored(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"),
                                                               F.first("signature").alias("signature"))
                     .withColumn("node", F.monotonically_increasing_id()))
    signed = classes.select("node", "signature", "n")
    keys = signed.select("node", "signature").mapInArrow(_keys, "key bigint, node bigint")
    crowds = keys.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("members")).where("members > 1")
    crowded = stored(keys.join(crowds, "key"))
    sets = stored(_sets(docs, crowded.select("node").distinct().join(classes.select("node", "first", "digest"), "node"), width))

    stars = crowded.where("node != center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    a, b = (signed.select(F.col("node").alias(c), F.col("signature").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    near = _hamming(stars.join(a, "a").join(b, "b").where(_close_sizes("na", "nb")))
    edges = stored(_confirmed(near, sets))
    labels = components(edges)

    groups = max(1, crowded.count() // SHARED)
    for likely in (True, False):
        tagged = crowded.join(labels, "node", "left").select("key", "node", "members", F.coalesce("label", "node").alias("label"))
        open_keys = tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        members = (tagged.join(open_keys, "key").join(signed, "node").join(sets.select("node", "wide").dropDuplicates(["node"]), "node")
                   .withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int")))
        edges = stored(edges.union(_confirmed(_apart(members, groups, likely).distinct(), sets)))
        labels = stored(components(edges))

    named = classes.select("node", "digest", "first").join(labels, "node", "left").withColumn("group", F.coalesce("label", "node"))
    smallest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    member = named.join(smallest, "group").select("digest", "group", "component_id")
    out = rows.join(member, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "group", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """`docs` with one row of each group of near duplicates; rows without words all stay."""
    found = stored(linked(docs, width))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    chosen = (found.where("kept and group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
              .select("k.*", F.lit(True).alias("__one"))
              .union(found.where("group is null").select("doc_id", "text_hash", F.lit(False)).distinct())
              .select(name.alias("__id"), F.col("text_hash").alias("__hash"), "__one"))
    keyed = docs.withColumn("__id", name).withColumn("__hash", F.xxhash64("text"))
    from pyspark.sql import Window

    copy = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__one"))
    return (keyed.join(chosen, ["__id", "__hash"]).withColumn("__copy", copy).where("__copy = 1 or not __one")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def op5_near_duplicates(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
n AS (SELECT r, doc_id, count(*) AS n FROM sh GROUP BY r, doc_id),
inter AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
edges AS (SELECT a, b FROM inter JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(r, t) AS (SELECT r, r FROM words UNION SELECT reach.r, edges.b FROM reach JOIN edges ON reach.t = edges.a),
comp AS (SELECT reach.r, min(words.doc_id) AS component_id FROM reach JOIN words ON reach.t = words.r GROUP BY reach.r)
SELECT words.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, words.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM words JOIN comp USING (r) LEFT JOIN n USING (r)
"""
