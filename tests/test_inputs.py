"""Inputs that must not lose or change data silently."""

import pytest

from rillwave.sources import cohort
from rillwave.sources.recordings import chosen_labels, decode_one


def test_identifiers_stay_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("subject_id,label,alpha\n007,baseline,1\n7,baseline,2.5\n010,x,\n")
    rows = cohort.read_labelled(spark, str(tmp_path / "t.csv")).collect()
    assert {(r.subject_id, r.label, r.alpha) for r in rows} == {("007", "baseline", 1.0), ("7", "baseline", 2.5), ("010", "x", None)}


def test_a_file_that_cannot_be_decoded_ends_the_job(spark, tmp_path):
    (tmp_path / "cut.edf").write_bytes(b"0       " + b" " * 100)
    with pytest.raises(Exception, match="s1"):
        decode_one(spark, "s1", str(tmp_path / "cut.edf"), ["EEG Fp1"]).collect()


def test_labels_may_hold_blanks():
    assert chosen_labels("EEG Fp1-LE\nEEG Fp2\n") == ["EEG Fp1-LE", "EEG Fp2"]
    assert chosen_labels("A B") == ["A", "B"] and chosen_labels("") is None


def test_no_scratch_folder_on_a_cluster():
    from types import SimpleNamespace

    from rillwave.session import shared_folder

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=sc, conf={}))
