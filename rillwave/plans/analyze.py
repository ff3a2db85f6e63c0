"""The offline analysis: blocks in, epoch verdicts and per-channel features out."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.kernels import SPECTRAL_COLUMNS
from ..functions.scalars import depth_proxy, epochs_column
from ..model import RDI_COMPONENTS, RESERVED_NUMERICS, SOI_COMPONENTS, GuardError, QualityPolicy
from ..operators import coupling, epochs as E, quality, spectral
from ..session import cut_lineage

HISTORY_S = 60.0


@dataclass
class Analysis:
    """Lazy results: ``epochs`` one row per epoch, ``features`` per epoch and channel, ``pairs`` per site pair."""

    blocks: DataFrame
    epochs: DataFrame
    features: DataFrame
    pairs: DataFrame | None
    fs: float
    epoch_n: int
    epoch_s: float
    policy: QualityPolicy
    line_hz: float | None

    def wide(self, channels: list[str]) -> DataFrame:
        """One row per epoch with ``<channel>__<feature>`` columns; the channel list is given, never discovered."""
        values = [*SPECTRAL_COLUMNS, "auto_bicoherence_squared_60s", "bis_proxy_uncalibrated"]
        packed = self.features.groupBy("recording_id", "epoch_ix").pivot("channel", channels).agg(F.first(F.struct(*values)))
        cols = [F.col(f"`{c}`.{v}").alias(epochs_column(c, v)) for c in channels for v in values]
        out = self.epochs.join(packed.select("recording_id", "epoch_ix", *cols), ["recording_id", "epoch_ix"], "left")
        if self.pairs is not None:
            from ..model import PLV_SITE_PAIRS
            names = [f"pair_{a}_{b}__alpha_plv" for a, b in PLV_SITE_PAIRS]
            plv = self.pairs.groupBy("recording_id", "epoch_ix").pivot("pair", names).agg(F.first("plv"))
            out = out.join(plv, ["recording_id", "epoch_ix"], "left")
        return out

    def counts(self) -> DataFrame:
        """Per recording: samples, complete / accepted / rejected epochs and the unused tail."""
        tally = self.epochs.groupBy("recording_id").agg(
            F.count("*").alias("complete_epochs"), F.count_if("accepted").alias("accepted_epochs"),
            F.count_if(~F.col("accepted")).alias("rejected_epochs"))
        return (E.lengths(self.blocks).withColumn("unused_tail_samples", F.col("samples") % self.epoch_n)
                .join(tally, "recording_id", "left").na.fill(0, ["complete_epochs", "accepted_epochs", "rejected_epochs"]))

    def summary(self, metadata: dict, channels: list[str]) -> dict:
        """Summary document of a single recording."""
        c = self.counts().first()
        if not c or not c["complete_epochs"]:
            raise GuardError("recording is shorter than one complete epoch")
        return {
            "use": "research_only", "clinical_validation": "not_established", "classification": "indeterminate",
            "SOI": None, "RDI": None,
            "index_reason": "raw-signal analysis supplies neither the ten components nor a documented 24-hour awake baseline",
            "recording_context": metadata.get("recording_context", "unspecified"), "sample_rate_hz": self.fs,
            "samples": c["samples"], "channels": channels, "epoch_s": self.epoch_s, "complete_epochs": c["complete_epochs"],
            "accepted_epochs": c["accepted_epochs"], "rejected_epochs": c["rejected_epochs"],
            "unused_tail_samples": c["unused_tail_samples"], "quality_policy": asdict(self.policy), "notch_hz": self.line_hz,
            "bicoherence": {"estimator": "mean_squared_auto_bicoherence", "history_s": HISTORY_S, "subsegment_s": 2,
                            "overlap": 0.5, "f1_f2_hz": [5, 15]},
            "montage": {"sensor": metadata.get("sensor", {}), "scalp_locations": metadata.get("channel_locations", {}),
                        "reference_verified": metadata.get("reference_verified") is True},
            "components_required": {"SOI": list(SOI_COMPONENTS), "RDI": list(RDI_COMPONENTS)},
            "provenance": metadata,
        }


def analyze(blocks: DataFrame, fs: float, epoch_s: float = 4.0, line_hz: float | None = None,
            policy: QualityPolicy = QualityPolicy(), numerics: DataFrame | None = None, flags: DataFrame | None = None,
            require_sqi: bool = False, sites: DataFrame | None = None, starts: DataFrame | None = None,
            channels: int | None = None) -> Analysis:
    """Quality-controlled spectral, bicoherence and phase-locking features of recordings with one rate.

    ``numerics``: sample-aligned monitor values (recording_id, sample_ix, name, value); ``flags``:
    see ``assess_epochs``; ``sites``: verified electrode sites; ``starts`` (recording_id, start_s);
    ``channels``: channels of every recording (default: those that each recording's blocks hold).
    Raw signal is shuffled once for the epochs and once, with a 60 s halo, for the histories; all
    other exchanges carry one small row per epoch and channel. The epoch figures are computed
    right away and kept in the shared folder.
    """
    n = E.epoch_samples(fs, epoch_s)
    if line_hz is not None and not 0 < line_hz < fs / 2:
        raise GuardError("notch frequency must be positive and below Nyquist")
    cut = E.cut(blocks, n)
    # verdicts, histories and features all start here: keep the figures, never redo the signal work
    per = cut_lineage(spectral.epoch_features(cut, fs, line_hz))
    aux = None if numerics is None else quality.wide_numerics(quality.numeric_stats(numerics, n))
    channels = quality.channel_counts(blocks) if channels is None else channels
    verdict = quality.assess_epochs(per, aux, policy, flags, require_sqi, channels=channels)

    piece = coupling.piece_length(n, fs, HISTORY_S)
    stats = per if piece == n else quality.signal_stats(E.cut(blocks, piece))
    aux_piece = aux if piece == n or numerics is None else quality.wide_numerics(quality.numeric_stats(numerics, piece))
    past = quality.assess_histories(stats, round(HISTORY_S * fs) // piece, aux_piece, policy, flags, require_sqi,
                                    channels=channels)
    good = (past.where(F.col("accepted") & (F.size("warnings") == 0) & ((F.col("epoch_ix") + 1) * piece % n == 0))
            .select("recording_id", (F.floor((F.col("epoch_ix") + 1) * piece / n) - 1).cast("long").alias("epoch_ix"),
                    F.lit(True).alias("_past_ok")))
    bic = coupling.history_bicoherence(blocks, fs, n, HISTORY_S)

    recorded = [f"recorded_{c.lower()}" for c in RESERVED_NUMERICS] if numerics is not None else []
    begin = F.lit(0.0)
    if starts is not None:
        verdict, begin = verdict.join(starts, "recording_id", "left"), F.coalesce(F.col("start_s"), F.lit(0.0))
    epochs = verdict.select(
        "recording_id", "epoch_ix", *E.epoch_times(begin, fs, n, epoch_s), "accepted",
        F.array_join("reasons", ";").alias("quality_reasons"), F.array_join("warnings", ";").alias("quality_warnings"),
        "sqi_min", "emg_max_db", F.lit(None).cast("double").alias("soi"), F.lit(None).cast("double").alias("rdi"),
        F.lit("indeterminate").alias("classification"), *recorded)
    keep = ["recording_id", "epoch_ix"]
    accepted = verdict.where("accepted").select(*keep)
    features = (per.join(accepted, keep, "left_semi").select(*keep, "channel", *SPECTRAL_COLUMNS)
                .join(bic, [*keep, "channel"], "left").join(good, keep, "left")
                .withColumn("auto_bicoherence_squared_60s", F.when(F.col("_past_ok"), F.col("bicoherence")))
                .withColumn("bis_proxy_uncalibrated", depth_proxy(F.col("sef95_hz"), F.col("spectral_entropy"), F.col("delta_relative_power")))
                .drop("bicoherence", "_past_ok"))
    pairs = None
    if sites is not None:
        pairs = coupling.pair_phase_locking(cut, sites, fs).join(accepted, keep, "left_semi")
    return Analysis(blocks, epochs, features, pairs, fs, n, epoch_s, policy, line_hz)


def analyze_recording(rec, epoch_s: float = 4.0, line_hz: float | None = None, policy: QualityPolicy = QualityPolicy()) -> Analysis:
    """Analysis of one CSV ``Recording`` with the flags of its own sidecar."""
    numerics, f, spark = rec.numerics(), rec.flags(), rec.frame.sparkSession
    flags = spark.createDataFrame([(rec.metadata["recording_id"], f["sqi"], f["emg"], f["require_sqi"])],
                                  "recording_id string, has_sqi boolean, has_emg boolean, require_sqi boolean")
    starts = rec.frame.where("sample_ix = 0").select("recording_id", F.col("time_s").alias("start_s"))
    n = len(rec.channels)
    if numerics is None:
        return analyze(rec.blocks(), rec.fs, epoch_s, line_hz, policy, None, None, f["require_sqi"], rec.sites(), starts, n)
    return analyze(rec.blocks(), rec.fs, epoch_s, line_hz, policy, numerics, flags, False, rec.sites(), starts, n)
