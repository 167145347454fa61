"""A left join of two streams over several micro-batches: late partners, missing partners, rows that are too late."""

from datetime import datetime, timedelta

import pytest

from seclog.streaming import joins, monitor, queries

T0 = datetime(2025, 1, 1)
LEFT, RIGHT = "timestamp timestamp, host string, n int", "timestamp timestamp, host string, role string, rank int"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_stream_equals_batch_and_lets_state_go(spark, tmp_path):
    batches = [
        ([(at(5), "a", 1), (at(6), "b", 2), (at(7), None, 3)], [(at(8), "a", "web", 1), (at(9), "a", "web", 1)]),
        ([(at(50), "c", 4)], [(at(20), "b", "db", 2)]),  # the partner of b comes a batch later
        ([(at(65), "a", 5)], [(at(70), "z", "none", 3)]),  # another window: no partner there
        ([(at(600), "end", 9)], [(at(600), "end2", "x", 9)]),
        ([(at(10), "a", 99), (at(1300), "end", 9)], [(at(30), "c", "late", 9), (at(1300), "end2", "x", 9)]),  # too late
    ]
    paths = {k: str(tmp_path / k) for k in ("l", "r", "t", "c")}
    progress = []
    for left, right in batches:
        spark.createDataFrame(left, LEFT).coalesce(1).write.mode("append").parquet(paths["l"])
        spark.createDataFrame(right, RIGHT).coalesce(1).write.mode("append").parquet(paths["r"])
        streams = [spark.readStream.schema(s).parquet(paths[k]) for k, s in (("l", LEFT), ("r", RIGHT))]
        query = queries.start_table(
            joins.left_within_windows(*streams, ["host"], window="1 hour", delay="2 hours"), paths["t"], paths["c"], every=None)
        query.awaitTermination()
        progress += [monitor.progress_row(p) for p in query.recentProgress]
    found = {(r.n, r.role, r["rank"]) for r in spark.read.parquet(paths["t"]).collect()}
    sides = [spark.createDataFrame([x for b in batches[:4] for x in b[k]], s) for k, s in ((0, LEFT), (1, RIGHT))]
    whole = joins.left_within_windows(*sides, ["host"])
    want = {(r.n, r.role, r["rank"]) for r in whole.collect()}
    assert {x for x in want if x[0] != 9} == {(1, "web", 1), (2, "db", 2), (3, None, None), (4, None, None), (5, None, None)}
    assert {x for x in found if x[0] != 9} == {x for x in want if x[0] != 9}
    rows = spark.read.parquet(paths["t"])
    assert rows.count() == rows.dropDuplicates().count() and rows.columns == whole.columns
    late, state = monitor.PROGRESS.split(", ")[5].split()[0], [p[6] for p in progress]
    assert late == "late_rows" and sum(p[5] for p in progress) >= 2  # both late rows are counted
    assert state[-1] <= 6  # closed windows have left the state


def test_names_that_clash_are_refused(spark):
    left = spark.createDataFrame([], "timestamp timestamp, host string, role string")
    with pytest.raises(ValueError, match="role"):
        joins.left_within_windows(left, spark.createDataFrame([], RIGHT), ["host"])
