"""The given parquet tables seen as biosignal data.

* recording ``E``: each embedding row is 32 consecutive samples of two channels at 128 Hz
* recording ``wearable``: each embedding row is 16 consecutive samples of four channels at 256 Hz
* monitor tracks: one per event type, time = event_id seconds
* sessions: events of one user in event order
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FS = 128.0
LIVE_FS = 256.0
LIVE_CHANNELS = ("TP9", "AF7", "AF8", "TP10")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(key: str, recording: str) -> Column:
    """Recording id that stays a column: a bare literal would be folded away from join keys."""
    return F.when(F.col(key).isNotNull(), F.lit(recording))


def _blocks(spark: SparkSession, sf_dir: str, recording: str, channels: tuple[str, ...]) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    width = 64 // len(channels)
    parts = [F.struct(F.lit(c).alias("channel"),
                      F.transform(F.slice("embedding", 1 + i * width, width).cast("array<double>"),
                                  lambda v: v * 100.0).alias("uv"))
             for i, c in enumerate(channels)]
    return (emb.select("vec_id", F.explode(F.array(*parts)).alias("p"))
            .select(_named("vec_id", recording).alias("recording_id"), "p.channel",
                    (F.col("vec_id") * width).alias("start_ix"), "p.uv"))


def recording_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, "E", ("A", "B"))


def wearable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, "wearable", LIVE_CHANNELS)


def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample clock of ``E``: one row per sample."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    return (ids.select(F.explode(F.sequence(F.col("vec_id") * 32, F.col("vec_id") * 32 + 31)).alias("sample_ix"))
            .select(_named("sample_ix", "E").alias("recording_id"), "sample_ix",
                    (F.col("sample_ix") / F.lit(FS)).alias("t")))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(_named("event_id", "E").alias("recording_id"), _named("event_id", "E").alias("case_id"), F.col("event_type").alias("tname"),
                     F.col("event_id").alias("row_ix"), F.col("event_id").cast("double").alias("t"), "value")


def instant(df: DataFrame, column: str) -> Column:
    """A timestamp column as points in time; one without a zone is read as UTC, whatever zone the session has."""
    c = F.col(column)
    return F.to_timestamp(F.concat(c.cast("string"), F.lit("Z"))) if dict(df.dtypes)[column] == "timestamp_ntz" else c


def prop_k() -> Column:
    """The integer k of the props JSON."""
    return F.get_json_object("props", "$.k").cast("long")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_of(table(spark, sf_dir, "events"))


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows as an unbounded table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return sessions_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
                       .option("maxFilesPerTrigger", 1).parquet(sf_dir))


def sessions_of(ev: DataFrame) -> DataFrame:
    """Events as live windows: one session per user, features by plain arithmetic on value and k."""
    k = prop_k().cast("double")
    v = F.col("value")
    bar = F.log(v + 1.0)
    muscle = F.log(v + k / 10.0 + 1.0)
    alpha = F.lit(1.0) / (F.lit(1.0) + v / 50.0)

    def channel(shift: float) -> Column:
        return F.struct((alpha + shift * k / 1000.0).alias("alpha_rel"),
                        (bar + shift * k / 100.0).alias("beta_alpha_ratio"),
                        (muscle + shift).alias("muscle_tension"))

    per = F.create_map(*[x for i, c in enumerate(LIVE_CHANNELS) for x in (F.lit(c), channel(float(i)))])
    ok = F.col("event_type") != "error"
    feats = {"alpha_rel": alpha, "theta_rel": F.lit(1.0) / (F.lit(2.0) + v / 40.0),
             "beta_alpha_ratio": bar, "muscle_tension": muscle, "frontal_asymmetry": k / 50.0 - 1.0}
    return ev.select(F.col("user_id").cast("string").alias("session_id"),
                     F.col("event_id").cast("double").alias("t"), ok.alias("ok"),
                     *[F.when(ok, c).alias(n) for n, c in feats.items()], F.when(ok, per).alias("channels"))
