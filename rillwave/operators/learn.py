"""Leave-one-subject-out linear SVMs, fitted together: one pass over the table serves every fold.

A fold per subject and a model per class pair would mean thousands of separate fits, each of many
passes. Here a pass computes the gradient and curvature of *all* models inside the tasks, the
sums are reduced by Spark, and the driver updates a few small vectors. The number of passes does
not depend on the number of subjects.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..model import GROUP_NAMES, GuardError
from . import guards, labelled

_STEPS = (1.0, 0.5, 0.2, 0.05)            # step lengths judged in the same pass
_WIDTHS = (4.0, 1.0, 0.3, 0.1, 0.03, 0.01)   # the hinge corner is rounded ever less
#: A model counts as settled when a full step promises at most this share of its loss.
SETTLED = 1e-4


@dataclass
class Fold:
    """Training view that leaves out one subject (or nobody): scaler and balanced class weights."""

    held_out: str | None
    mean: np.ndarray
    sd: np.ndarray
    weight: np.ndarray          # per class


def folds_of(table: DataFrame, label: str, features: list[str], subject: str, whole: bool = False) -> tuple[list[str], list[Fold]]:
    """Classes and folds from one aggregate row per (subject, class); scalers never see the held-out subject."""
    aggs = [F.count("*").alias("n")] + [x for i, f in enumerate(features)
                                        for x in (F.avg(f).alias(f"m{i}"), F.var_pop(f).alias(f"v{i}"))]
    rows = table.groupBy(subject, label).agg(*aggs).collect()
    classes, subjects = sorted({r[label] for r in rows}), sorted({r[subject] for r in rows})
    who = np.array([subjects.index(r[subject]) for r in rows])
    cls = np.array([classes.index(r[label]) for r in rows])
    n = np.array([r["n"] for r in rows], dtype=float)
    m = np.array([[r[f"m{i}"] for i in range(len(features))] for r in rows])
    v = np.array([[r[f"v{i}"] for i in range(len(features))] for r in rows])

    def fold(left_out: int | None) -> Fold:
        use = np.ones(len(n), dtype=bool) if left_out is None else who != left_out
        counts = np.bincount(cls[use], weights=n[use], minlength=len(classes))
        if (counts == 0).any():
            raise GuardError("a held-out fold lacks a training class; collect labels across more subjects")
        w = n[use, None]
        mean = (w * m[use]).sum(axis=0) / w.sum()
        sd = np.sqrt((w * (v[use] + (m[use] - mean) ** 2)).sum(axis=0) / w.sum())
        return Fold(None if left_out is None else subjects[left_out], mean, np.where(sd > 0, sd, 1.0),
                    counts.sum() / (len(classes) * counts))

    return classes, [fold(None)] if whole else [fold(i) for i in range(len(subjects))]


def _soft_hinge(z: np.ndarray, width: float):
    """Value, slope and curvature of the hinge with a parabola of the given width at its corner.

    On the straight part the curvature of the usual quadratic bound keeps steps finite.
    """
    flat, bend = z <= 0, (z > 0) & (z < width)
    value = np.where(flat, 0.0, np.where(bend, z * z / (2 * width), z - width / 2))
    return value, np.where(flat, 0.0, np.where(bend, z / width, 1.0)), np.where(bend, 1.0 / width, np.where(flat, 0.0, 0.5 / np.maximum(z, width)))


def _pass(table: DataFrame, label: str, features: list[str], subject: str, classes: list[str], folds: list[Fold],
          tries: np.ndarray, width: float) -> np.ndarray:
    """Sums over rows for tries (candidate, fold, pair, d + 1): loss, gradient and curvature, flattened last."""
    pairs = list(combinations(range(len(classes)), 2))
    d = len(features) + 1
    size = 1 + d + d * d

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((*tries.shape[:3], size))
        for pdf in frames:
            x = pdf[features].to_numpy(float)
            y = pdf[label].map({c: i for i, c in enumerate(classes)}).to_numpy()
            s = pdf[subject].to_numpy()
            for fi, fold in enumerate(folds):
                mine = np.ones(len(x), dtype=bool) if fold.held_out is None else s != fold.held_out
                z = np.column_stack([(x[mine] - fold.mean) / fold.sd, np.ones(mine.sum())])
                for pi, (low, high) in enumerate(pairs):
                    rows = (y[mine] == low) | (y[mine] == high)
                    zz, sign = z[rows], np.where(y[mine][rows] == high, 1.0, -1.0)
                    c = fold.weight[y[mine][rows]]
                    for k in range(len(tries)):
                        value, slope, curve = _soft_hinge(1.0 - sign * (zz @ tries[k, fi, pi]), width)
                        out = total[k, fi, pi]
                        out[0] += (c * value).sum()
                        out[1:1 + d] -= zz.T @ (c * slope * sign)
                        out[1 + d:] += ((zz * (c * curve)[:, None]).T @ zz).ravel()
        flat = total.reshape(-1, size)
        yield pd.DataFrame({"model": np.repeat(np.arange(len(flat)), size), "pos": np.tile(np.arange(size), len(flat)), "v": flat.ravel()})

    sums = (table.select(subject, label, *features).mapInPandas(run, "model long, pos long, v double")
            .groupBy("model", "pos").agg(F.sum("v").alias("v")).toPandas())      # models x (1 + d + d^2) numbers
    out = np.zeros((tries[..., 0].size, size))
    out[sums["model"], sums["pos"]] = sums["v"]
    return out.reshape(*tries.shape[:3], size)


class UnconvergedWarning(UserWarning):
    """Models that were stopped before they had settled."""


def fit(table: DataFrame, label: str, features: list[str], subject: str, classes: list[str], folds: list[Fold],
        rounds: int = 6) -> np.ndarray:
    """Coefficients (fold, pair, d + 1) on scaled features, C = 1, intercept unpenalised and last.

    Warns with the models that are not settled at the last width: `rounds` steps are over, or no step helps
    although the slope promises one.
    """
    d = len(features) + 1
    n_pairs = len(classes) * (len(classes) - 1) // 2
    ridge = np.diag([1.0] * (d - 1) + [0.0])
    at = np.zeros((len(folds), n_pairs, d))

    def score(tries, width):
        sums = _pass(table, label, features, subject, classes, folds, tries, width)
        return 0.5 * (tries[..., :-1] ** 2).sum(axis=-1) + sums[..., 0], sums

    for width in _WIDTHS:
        value, sums = score(at[None], width)
        value, sums = value[0], sums[0]
        for _ in range(rounds):
            grad = sums[..., 1:1 + d] + at @ ridge
            hess = sums[..., 1 + d:].reshape(len(folds), n_pairs, d, d) + ridge + 1e-9 * np.eye(d)
            move = -np.linalg.solve(hess, grad[..., None])[..., 0]
            tries = np.stack([at + t * move for t in _STEPS])
            values, all_sums = score(tries, width)
            best = values.argmin(axis=0)
            pick = np.take_along_axis(values, best[None], axis=0)[0]
            better = pick < value
            gain = np.where(better, value - pick, 0.0)
            chosen = np.take_along_axis(tries, best[None, ..., None], axis=0)[0]
            chosen_sums = np.take_along_axis(all_sums, best[None, ..., None], axis=0)[0]
            at = np.where(better[..., None], chosen, at)
            sums = np.where(better[..., None], chosen_sums, sums)
            value = np.where(better, pick, value)
            if (gain <= 1e-7 * (1.0 + np.abs(value))).all():
                break
    grad = sums[..., 1:1 + d] + at @ ridge
    hess = sums[..., 1 + d:].reshape(len(folds), n_pairs, d, d) + ridge + 1e-9 * np.eye(d)
    # decrease of the loss that a full step promises
    promised = 0.5 * (grad * np.linalg.solve(hess, grad[..., None])[..., 0]).sum(axis=-1)
    late = np.argwhere(~(promised <= SETTLED * (1.0 + np.abs(value))))
    if len(late):
        pairs = list(combinations(classes, 2))
        names = "; ".join(f"{pairs[p][0]} / {pairs[p][1]} without {folds[f].held_out}" for f, p in late[:5].tolist())
        warnings.warn(f"{len(late)} of {at[..., 0].size} models stopped unconverged: {names}", UnconvergedWarning, stacklevel=2)
    return at


def predict(table: DataFrame, features: list[str], subject: str, classes: list[str], folds: list[Fold], coef: np.ndarray) -> DataFrame:
    """Adds ``pred`` from the fold that held the row's subject out: most pairwise wins, ties to the first class."""
    pairs = list(combinations(range(len(classes)), 2))
    index = {f.held_out: i for i, f in enumerate(folds)}
    schema = T.StructType(table.schema.fields + [T.StructField("pred", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = pdf[features].to_numpy(float)
            which = pdf[subject].map(lambda s: index.get(s, index.get(None))).to_numpy()
            wins = np.zeros((len(x), len(classes)))
            for fi in np.unique(which):
                rows = np.flatnonzero(which == fi)
                z = np.column_stack([(x[rows] - folds[fi].mean) / folds[fi].sd, np.ones(len(rows))])
                for pi, (low, high) in enumerate(pairs):
                    up = z @ coef[fi, pi] > 0
                    wins[rows, np.where(up, high, low)] += 1
            yield pdf.assign(pred=np.array(classes, dtype=object)[wins.argmax(axis=1)])

    return table.mapInPandas(run, schema)


def held_out(table: DataFrame, label: str, features: list[str], subject: str = "subject_id") -> DataFrame:
    """Held-out prediction of every row."""
    table = table.cache()
    classes, folds = folds_of(table, label, features, subject)
    return predict(table, features, subject, classes, folds, fit(table, label, features, subject, classes, folds))


def final_model(table: DataFrame, label: str, features: list[str], subject: str = "subject_id") -> dict:
    """Model over all rows as plain numbers (scaler and pairwise hyperplanes)."""
    classes, folds = folds_of(table, label, features, subject, whole=True)
    coef = fit(table, label, features, subject, classes, folds)[0]
    return {"features": features, "classes": classes, "mean": folds[0].mean.tolist(), "sd": folds[0].sd.tolist(),
            "pairs": [{"low": a, "high": b, "coef": c[:-1].tolist(), "intercept": float(c[-1])}
                      for (a, b), c in zip(combinations(classes, 2), coef)]}


def train_states(table: DataFrame, features: list[str]) -> tuple[dict, DataFrame]:
    """Labelled-state evaluation document and the held-out predictions of every row."""
    guards.enforce(guards.state_table_report(table, features))
    pred = held_out(table, "research_label", features).withColumnRenamed("pred", "held_out_prediction").cache()
    pairs = pred.select("subject_id", F.col("research_label").alias("truth"), F.col("held_out_prediction").alias("pred"))
    m = labelled.summary_metrics(pairs).first()
    classes = sorted(r[0] for r in table.select("research_label").distinct().collect())
    per = {r["subject_id"]: r["n"] for r in table.groupBy("subject_id").agg(F.count("*").alias("n")).collect()}
    rows, folds = sum(per.values()), []
    for s, n in sorted(per.items()):
        f1 = labelled.summary_metrics(pairs.where(F.col("subject_id") == s), classes).first()["macro_f1"]
        folds.append({"held_out_subject": s, "n_train": rows - n, "n_test": n, "macro_f1": f1})
    return {"use": "research_only", "clinical_validation": "not_established", "evaluation": "leave_one_subject_out",
            "subjects": len(per), "rows": rows, "features": features, "balanced_accuracy": m["balanced_accuracy"],
            "macro_f1": m["macro_f1"], "folds": folds}, pred


def train_groups(table: DataFrame, features: list[str]) -> tuple[dict, DataFrame]:
    """Diagnostic-group evaluation at epoch and subject level, and the votes per subject."""
    guards.enforce(guards.group_table_report(table, features))
    rows = guards.accepted_rows(table)
    pred = held_out(rows, "group", features).select("subject_id", F.col("group").alias("truth"), "pred").cache()
    votes = labelled.majority_vote(pred)
    classes = sorted(r[0] for r in rows.select("group").distinct().collect())
    epoch, subject = labelled.summary_metrics(pred, classes).first(), labelled.summary_metrics(votes).first()
    matrix = {r["truth"]: [r[c] for c in classes] for r in labelled.confusion_matrix(votes, classes).collect()}
    per = {r["group"]: r["n"] for r in rows.groupBy("group").agg(F.count_distinct("subject_id").alias("n")).collect()}
    assert set(per) <= set(GROUP_NAMES.values())
    return {"use": "research_only", "clinical_validation": "not_established", "evaluation": "leave_one_subject_out",
            "classes": classes, "subjects_per_group": per, "epochs": pred.count(), "features": features,
            "epoch_balanced_accuracy": epoch["balanced_accuracy"], "epoch_macro_f1": epoch["macro_f1"],
            "subject_balanced_accuracy": subject["balanced_accuracy"],
            "subject_confusion_matrix": {"labels": classes, "rows_true_cols_pred": [matrix.get(c, [0] * len(classes)) for c in classes]},
            "site_checked": "site" in table.columns}, votes
