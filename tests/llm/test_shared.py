import os

import pytest

from shoptrail.llm import shared
from shoptrail.llm.files import put


def test_stages_are_below_the_shared_folder_and_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(shared, "_MADE", [])
    kept = shared.stage(spark.range(3).groupBy().count(), "t")
    (path,) = shared._MADE
    assert path.startswith(spark.conf.get(shared.DIR)) and kept.first()[0] == 3
    assert "Aggregate" not in kept._jdf.queryExecution().optimizedPlan().toString()
    shared.clean(spark)
    assert not os.path.exists(path) and shared._MADE == []


def test_files_are_whole_or_absent(tmp_path):
    for folder in (f"{tmp_path}/a", f"file://{tmp_path}/b"):
        put(folder, "x.bin", b"one")
        put(folder, "x.bin", b"two")
    assert (tmp_path / "a/x.bin").read_bytes() == (tmp_path / "b/x.bin").read_bytes() == b"two"
    assert sorted(os.listdir(tmp_path / "a")) == ["x.bin"]


def test_a_cluster_needs_the_setting(spark, monkeypatch):
    class Other:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://h"})
    with pytest.raises(ValueError):
        shared.folder(Other, "t")
