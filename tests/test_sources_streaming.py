"""File sources and streams."""

import datetime as dt

from lexspan.sources import files
from lexspan.streaming import sessions


def test_documents_of_every_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("甲方".encode("gbk"))
    (tmp_path / "b.html").write_text("<p>one</p><script>x</script><p>two &amp; three</p>", encoding="utf-8")
    (tmp_path / "c.doc").write_text("<html><body><p>old</p></body></html>", encoding="utf-8")
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.xyz").write_text("?")
    (tmp_path / "f.txt").write_text("")
    (tmp_path / "g.txt").write_bytes(b"x" * (2 << 20))
    rows = {x.filename: x for x in files.documents(spark, str(tmp_path), max_mb=1).collect()}
    assert (rows["a.txt"].text, rows["b.html"].text, rows["c.doc"].text) == ("甲方", "one\ntwo & three", "old")
    assert "f.txt" not in rows  # Spark lists no empty files
    assert all(rows[n].text is None and rows[n].error for n in ("d.docx", "e.xyz", "g.txt"))


def test_feedback_lines(spark, tmp_path):
    path = str(tmp_path / "feedback")
    rows = [("r1", "x" * 3000, "agree"), ("r2", None, "false_positive")]
    files.append_feedback(spark.createDataFrame(rows, "record_id string, clause_text string, user_action string"), path)
    with open(f"{path}/more.json", "w") as f:
        f.write('{"record_id": "r3", "odd": 1}\n{broken\n{"user_action": "agree"}\n')
    got = {x.record_id: x for x in files.feedback(spark, path).collect()}
    assert set(got) == {"r1", "r2", "r3"}
    assert len(got["r1"].clause_text) == 2000


def _drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def _written(spark, rows, schema, path):
    """One file per row list, in order."""
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_sessions_expire(spark, tmp_path):
    parts = [[(1, _at(0), 7, "a", 1.0), (2, _at(10), 7, "b", 3.0), (3, _at(5), 8, "a", 2.0)], [(4, _at(300), 9, "a", 1.0)], [(5, _at(310), 9, "a", 1.0)]]
    rows = _drained(sessions.expiring_sessions(_written(spark, parts, EVENTS, str(tmp_path / "e"))), "expired", "append")
    assert sorted((x.user_id, x.n_events, x.top) for x in rows) == [(7, 2, 3.0), (8, 1, 2.0)]


def test_counts_by_window(spark, tmp_path):
    parts = [[(1, _at(0), 7, "a", 1.0), (2, _at(10), 7, "a", 3.0), (3, _at(70), 8, "a", 2.0)], [(4, _at(400), 9, "b", 1.0)], [(5, _at(410), 9, "b", 1.0)]]
    rows = _drained(sessions.stage_counts(_written(spark, parts, EVENTS, str(tmp_path / "e"))), "counted", "append")
    assert sorted((x.event_type, x.n, x["mean"]) for x in rows) == [("a", 1, 2.0), ("a", 2, 2.0)]


def test_followups_keep_state_between_batches(spark, tmp_path):
    schema = "conv_id long, turn long, role string, ts timestamp"
    parts = [[(1, 0, "user", _at(0)), (2, 0, "user", _at(0)), (None, 0, "user", _at(0))], [(1, 1, "assistant", _at(1)), (2, 1, "user", _at(1))]]
    rows = _drained(sessions.followups(_written(spark, parts, schema, str(tmp_path / "m"))), "followed", "update")
    last = {}
    for x in rows:
        if x.n_asked + x.n_answered >= last.get(x.conv_id, (0, 0, False))[0]:
            last[x.conv_id] = (x.n_asked + x.n_answered, x.n_answered, x.pending)
    assert last == {1: (2, 1, False), 2: (2, 0, True)}
