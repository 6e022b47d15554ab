"""The cursor as streaming state: restarts, late and expired days, a cap on days a run, and done only after a publish."""

import json
from datetime import datetime

import pytest

from quarterbook.streaming import cursor


@pytest.fixture
def box(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()

    def arrive(name, *events, **how):
        (landing / name).write_text("\n".join(json.dumps(dict(zip(("day", "cik", "kind", "seen"), e, strict=True))) for e in events))
        query = cursor.start(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "cp"), **how)
        query.awaitTermination()
        return query

    def told():
        return {(str(r.day), r.known, r.pending, r.state) for r in spark.read.schema(cursor.STATES).parquet(str(tmp_path / "out")).collect()}

    def pending():
        return {(str(r.day), r.cik): r.pending for r in cursor.pending(spark, str(tmp_path / "cp")).collect()}

    return landing, arrive, told, pending


def test_days_are_read_once_and_expire(spark, box):
    landing, arrive, told, pending = box
    seen = "2024-05-02T06:00:00"
    arrive("1.json", ("2024-05-01", "1", "listed", seen), ("2024-05-01", "2", "listed", seen), ("2024-05-02", "1", "listed", seen), ("2024-05-01", "9", "noise", seen), (None, "9", "listed", seen))
    assert told() == {("2024-05-01", 2, 2, "open"), ("2024-05-02", 1, 1, "open")}
    assert pending() == {("2024-05-01", "1"): True, ("2024-05-01", "2"): True, ("2024-05-02", "1"): True}
    # a restart goes on from the state: what is listed again stays done, what was dropped is pending again
    arrive("2.json", ("2024-05-01", "1", "done", "2024-05-03T06:00:00"), ("2024-05-01", "2", "done", "2024-05-03T06:00:00"), ("2024-05-01", "5", "done", "2024-05-03T06:00:00"))
    assert ("2024-05-01", 2, 0, "read") in told()
    arrive("3.json", ("2024-05-01", "1", "listed", "2024-05-04T06:00:00"), ("2024-05-01", "2", "dropped", "2024-05-04T06:00:00"))
    assert pending()[("2024-05-01", "1")] is False and pending()[("2024-05-01", "2")] is True
    # half a year on, days have left the window; what comes for one of them is late and makes no state
    arrive("4.json", ("2024-11-01", "3", "listed", "2024-11-02T06:00:00"))
    arrive("5.json", ("2024-05-02", "7", "listed", "2024-11-03T06:00:00"), ("2024-11-03", "3", "listed", "2024-11-03T06:00:00"))
    assert {("2024-05-01", 2, 1, "expired"), ("2024-05-02", 1, 1, "expired"), ("2024-05-02", 0, 0, "late")} <= told()
    assert set(pending()) == {("2024-11-01", "3"), ("2024-11-03", "3")}


def test_at_most_so_many_days_in_a_batch(box):
    landing, arrive, told, pending = box
    for d in range(1, 8):
        (landing / f"{d}.json").write_text(json.dumps({"day": f"2024-05-0{d}", "cik": "1", "kind": "listed", "seen": "2024-05-09T00:00:00"}))
    query = arrive("8.json", ("2024-05-08", "1", "listed", "2024-05-09T00:00:00"), days_per_batch=3)
    assert max(p["numInputRows"] for p in query.recentProgress) == 3 and len(pending()) == 8


def test_done_only_after_a_publish(spark, box):
    landing, arrive, told, pending = box
    arrive("1.json", ("2024-05-01", "1", "listed", "2024-05-02T00:00:00"))
    read = spark.createDataFrame([("2024-05-01", "1")], "day string, cik string").selectExpr("cast(day as date) as day", "cik")

    def broken():
        raise RuntimeError("no pointer")

    with pytest.raises(RuntimeError):
        cursor.done_after(broken, read, str(landing), datetime(2024, 5, 3))
    arrive("2.json")
    assert pending() == {("2024-05-01", "1"): True}
    cursor.done_after(lambda: None, read, str(landing), datetime(2024, 5, 3))
    arrive("3.json")
    assert pending() == {("2024-05-01", "1"): False}
