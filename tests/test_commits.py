"""Appends by run id, with drivers that die at either side of the commit."""

import pytest

from tidemark.sources import commits, tracking


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def found(spark, path):
    return sorted(r["x"] for r in commits.read_committed(spark, path).collect())


def test_a_run_that_dies_half_way_and_runs_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert commits.append_once(rows(spark, 1, 2), path, "run-1")

    def dies(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(commits, "commit", dies)  # rows are staged, the commit isn't made
        with pytest.raises(RuntimeError):
            commits.append_once(rows(spark, 3), path, "run-2")
    assert found(spark, path) == [1, 2]
    assert commits.append_once(rows(spark, 3), path, "run-2")
    assert not commits.append_once(rows(spark, 3), path, "run-2")  # dies after the commit, runs again
    assert found(spark, path) == [1, 2, 3] and list(commits.commits(spark, path)) == ["run-1", "run-2"]
    assert commits.remove_uncommitted(spark, path) == 1 and found(spark, path) == [1, 2, 3]


def test_two_drivers_of_one_run(spark, tmp_path):
    """Both have staged their rows; the commit of one wins."""
    path = str(tmp_path / "t")
    for k in (1, 2):
        rows(spark, k).write.parquet(f"{path}/staged/r-{k}")
    assert commits.commit(spark, path, "r", "staged/r-1", "parquet")
    assert not commits.commit(spark, path, "r", "staged/r-2", "parquet")
    assert found(spark, path) == [1]


def test_none_bad_ids_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        commits.read_committed(spark, path)
    assert commits.read_committed(spark, path, "x long").count() == 0
    with pytest.raises(ValueError):
        commits.append_once(rows(spark, 1), path, "../up")
    commits.append_once(rows(spark, 1), path, "a")
    commits.append_once(spark.createDataFrame([(2, "n")], "x long, y string"), path, "b")
    assert sorted((r["x"], r["y"]) for r in commits.read_committed(spark, path).collect()) == [(1, None), (2, "n")]
    commits.append_once(rows(spark), path, "none")
    assert found(spark, path) == [1, 2]
    commits.reset(spark, [path, path])
    assert commits.commits(spark, path) == {}


def test_log_and_journal(spark, tmp_path):
    log, journal = str(tmp_path / "log"), str(tmp_path / "journal")
    for _ in range(2):
        tracking.log_runtime(spark, tracking.runtime_record("a", fold=1), log, "run-1")
        tracking.log_run(spark, {"experiment_name": "a", "score": 1.5}, journal, "run-1")
    tracking.log_runtime(spark, tracking.runtime_record("b", status="failed"), log, "run-2")
    got = commits.read_committed(spark, log).collect()
    assert sorted((r["experiment_name"], r["status"]) for r in got) == [("a", "success"), ("b", "failed")]
    assert [(r["experiment_name"], r["score"]) for r in tracking.read_journal(spark, journal).collect()] == [("a", 1.5)]
