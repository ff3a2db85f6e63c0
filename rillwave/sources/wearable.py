"""Wearable replay: CSV with one microvolt column per channel, stored or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..model import GuardError, LiveConfig
from .recordings import in_file_order

_CLOCK = ("timestamp", "time", "t")


def pick_channels(header: list[str], cfg: LiveConfig) -> list[str]:
    """Configured channels in configured order; without any match the first columns stand in."""
    names = [h for h in header if h.strip().lower() not in _CLOCK]
    by_name = {h.strip(): h for h in names}
    wanted = [by_name[c] for c in cfg.channels if c in by_name] or names[:len(cfg.channels)]
    if len(wanted) != len(cfg.channels):
        raise GuardError(f"file provides {len(wanted)} of {len(cfg.channels)} configured channels")
    return wanted


def read_wearable_csv(spark: SparkSession, path: str, cfg: LiveConfig, session_id: str, block: int = 1024) -> DataFrame:
    """BLOCKS of one replay file; time is the sample counter, clock columns are ignored."""
    header = spark.read.option("header", True).csv(path).columns
    wanted = pick_channels(header, cfg)
    schema = T.StructType([T.StructField(h, T.DoubleType() if h in wanted else T.StringType()) for h in header])
    rows = in_file_order(spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path))
    cols = [F.col(f"`{h}`").alias(f"c{i}") for i, h in enumerate(wanted)]
    packed = (rows.groupBy(F.floor(F.col("sample_ix") / block).cast("long").alias("_b"))
              .agg(F.sort_array(F.collect_list(F.struct("sample_ix", *cols))).alias("_s")))
    parts = [F.struct(F.lit(c).alias("channel"), F.col(f"_s.c{i}").alias("uv")) for i, c in enumerate(cfg.channels)]
    return (packed.select(F.col("_s")[0]["sample_ix"].alias("start_ix"), F.explode(F.array(*parts)).alias("p"))
            .select(F.lit(session_id).alias("recording_id"), "p.channel", "start_ix", "p.uv"))


def chunks(blocks: DataFrame, cfg: LiveConfig) -> DataFrame:
    """Blocks -> stream chunks (session_id, start_ix, uv channel-major) for the streaming detector."""
    at = [F.max(F.when(F.col("channel") == c, F.col("uv"))) for c in cfg.channels]
    return (blocks.where(F.col("channel").isin(*cfg.channels)).groupBy(F.col("recording_id").alias("session_id"), "start_ix")
            .agg(F.array(*at).alias("uv")))


def chunk_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Streaming source over a folder of parquet chunk files."""
    schema = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("start_ix", T.LongType()),
                           T.StructField("uv", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
