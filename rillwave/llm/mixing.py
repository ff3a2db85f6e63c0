"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source, sources get targets in proportion to their weights (no target above `most` times the
source), and each document is emitted floor(rate) times plus once more when its hash-seeded draw falls below the
fraction of the rate. A source has `DRAWS` candidate seeds; the one whose draws bring its words nearest to the target
is used, so small sources with a few large documents come near their targets as well. Every draw u is a pure function
of seed, draw number, doc_id and text: reruns, retries and other partitionings agree. Equal rows share u and are spread
evenly: number j of them takes its further copy if ceil((j + 1) * fraction - u) exceeds ceil(j * fraction - u), which has
the probability of the fraction for each of them and is u < fraction for a row without equals.

Defined cases: null or word-less text has size 0; the null source is a source of its own, last in order; rows with equal
or null ids draw by their texts; an empty table gives no rows; extra columns are passed by (`mixed`, where only rows that
are equal in all columns count as equal) or ignored (`takes`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwave.llm.common import stored, word_count

#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is repeated beyond this.
MOST = 3
#: Candidate seeds per source; a multiple of four, as one digest holds four draws.
DRAWS = 16
#: Further copies of equal rows that one row unfolds into.
CHUNK = 1000


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def draws(doc_id: Column, text_digest: Column, seed: int, n: int = DRAWS) -> Column:
    """`n` uniform numbers in [0, 1) per document: 32-bit words of MD5 digests."""
    digests = [F.md5(F.concat_ws(":", F.lit(seed), F.lit(i), F.coalesce(doc_id.cast("string"), F.lit("null")), text_digest)
                     .cast("binary")) for i in range(n // 4)]
    return F.array(*[F.conv(F.substring(d, 8 * w + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
                     for d in digests for w in range(4)])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, excess over `most` x size shared out again.

    `sizes` has one row per source. Filling up by weight until nothing overflows is a water level: in order of
    cap / weight, the level is what is left over the weights that are left, at the first source it does not overflow.
    """
    everything, rising = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = (sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
               .withColumn("cap", F.lit(most) * F.col("source_size"))
               .withColumn("ratio", F.col("cap").cast("double") / F.col("weight")))
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    levels = weighed.withColumn("level", level)
    water = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return levels.select("source", "source_size",
                         F.least(F.col("cap").cast("double"), water * F.col("weight")).alias("target"))


def plan(sized: DataFrame, seed: int, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source_size, target, whole copies, fraction and the number of the draw to use."""
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
                   F.lit(float(most)))
    rated = stored(per_source.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
                   .withColumn("fraction", F.col("rate") - F.col("whole")))
    equal = sized.groupBy("source", "doc_id", "digest", "size").agg(F.count("*").alias("n"))
    drawn = (equal.join(rated, equal["source"].eqNullSafe(rated["source"]))
             .select(rated["source"], "size", "n", "source_size", "target", "whole", "fraction",
                     draws(F.col("doc_id"), F.col("digest"), seed).alias("u")))
    extra = [F.sum(F.col("size") * F.ceil(F.col("n") * F.col("fraction") - F.col("u")[j])).alias(f"extra{j}") for j in range(DRAWS)]
    off = [F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"extra{j}") - F.col("target")).alias("off"),
                    F.lit(j).alias("draw")) for j in range(DRAWS)]
    return stored(drawn.groupBy("source", "source_size", "target", "whole", "fraction").agg(*extra)
                  .select("source", "source_size", "target", "whole", "fraction", F.least(*off)["draw"].alias("draw")))


def draw(seed: int) -> Column:
    """The draw of a document that its source uses, beside the columns of `plan`."""
    return F.element_at(draws(F.col("doc_id"), F.col("digest"), seed), F.col("draw") + 1)


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with their `number` among those of the same key, from 0; `row` must be stored.

    A key's rows are counted per part of the table and numbered within it, so no task holds more of a key than a part has.
    """
    parted = rows.withColumn("part", F.shiftright("row", 33))
    cells = parted.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = cells.withColumn("before", before).where("before > 0").select("part", "before", *[F.col(k).alias(f"of_{k}") for k in key])
    within = F.row_number().over(Window.partitionBy(*key, "part").orderBy("row")) - 1
    same = [F.col("part") == F.col("of_part"), *[F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key]]
    return (parted.withColumn("within", within).join(later.withColumnRenamed("part", "of_part"), same, "left")
            .select(*rows.columns, (F.col("within") + F.coalesce("before", F.lit(0))).alias("number")))


def takes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken (copies x size) of every row."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest(F.col("text")).alias("digest"))
                   .withColumn("row", F.monotonically_increasing_id()))
    p = plan(sized, seed).withColumnRenamed("source", "of_source")
    until = lambda j: F.ceil(j * F.col("fraction") - F.col("u"))
    one = until(F.col("number") + 1) - until(F.col("number"))
    return (numbered(sized, ["source", "doc_id", "digest", "size"]).join(p, F.col("source").eqNullSafe(F.col("of_source")))
            .withColumn("u", draw(seed))
            .select("doc_id", "size", "source_size", "target", ((F.col("whole") + one) * F.col("size")).cast("long").alias("taken")))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; all columns stay.

    Rows that are equal in all columns give their whole copies in place; the further ones are counted and given by one
    of them, in chunks that other tasks unfold.
    """
    whole_row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"})
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest(F.col("text")).alias("digest"),
                               F.md5(whole_row.cast("binary")).alias("whole_row")))
    names = ("whole", "fraction", "draw")
    p = plan(sized, seed).select(F.col("source").alias("__source"), *names)
    repeated = stored(sized.groupBy("whole_row").agg(F.count("*").alias("n")).where("n > 1"))
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source",
                       digest(F.col("text")).alias("digest"), F.md5(whole_row.cast("binary")).alias("whole_row"))
    known = (rows.join(p, F.col("source").eqNullSafe(F.col("__source"))).join(repeated, "whole_row", "left")
             .withColumn("u", draw(seed)))
    alone = F.when(F.col("n").isNull() & (F.col("u") < F.col("fraction")), 1).otherwise(0)
    unfold = lambda df, n: df.withColumn("copy", F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
    in_place = unfold(known, F.col("whole") + alone).select(*columns)
    further = (known.where("n IS NOT NULL").groupBy("whole_row")
               .agg(F.first("row").alias("row"), F.ceil(F.first("n") * F.first("fraction") - F.first("u")).alias("more")).where("more > 0")
               .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("more") - 1) / CHUNK))))
               .repartition("whole_row", "chunk"))
    return in_place.union(unfold(further, F.least(F.lit(CHUNK), F.col("more") - F.col("chunk") * CHUNK)).select(*columns))


def op10_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    from rillwave.llm.common import table
    return takes(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH sized AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS number, CAST(coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM per),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM per) - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
      / CAST((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT max(level) FROM l WHERE level <= ratio) * weight) AS target FROM l),
rated AS (SELECT *, least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END, 3.0::DOUBLE) AS rate FROM t),
parts AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS fraction FROM rated),
drawn AS (SELECT s.doc_id, s.source, s.size, s.number, p.source_size, p.target, p.whole, p.fraction, j,
      CAST(('0x' || substr(md5('0:' || CAST(j // 4 AS VARCHAR) || ':' || coalesce(CAST(s.doc_id AS VARCHAR), 'null') || ':' || s.digest), CAST(8 * (j % 4) + 1 AS BIGINT), 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
      FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source, range({DRAWS}) AS g(j)),
one AS (SELECT *, ceil((number + 1) * fraction - u) - ceil(number * fraction - u) AS one FROM drawn),
off AS (SELECT source, j, abs(any_value(whole) * any_value(source_size) + sum(one * size) - any_value(target)) AS off
      FROM one GROUP BY source, j),
best AS (SELECT source, j FROM off QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, j) = 1)
SELECT d.doc_id, d.size, d.source_size, d.target,
       CAST((d.whole + d.one) * d.size AS BIGINT) AS taken
FROM one d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.j = b.j
"""
