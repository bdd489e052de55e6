from voxelframe.streaming.append import append_stream, latest, windowed


def test_appended_batches_come_once(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = "t long, c long, value long"
    for rows in ([(0, 0, 1), (0, 1, 2)], [(0, 1, 5), (1, 0, 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        append_stream(stream, out, marks).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in latest(spark.read.parquet(out)).select("t", "c", "value").collect()}
    assert got == {(0, 0, 1), (0, 1, 5), (1, 0, 3)}


def test_windows_of_events(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 3.0D")
    events.write.parquet(str(tmp_path / "e"))
    stream = windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start().awaitTermination()
    assert [(r["value"], r["n"]) for r in spark.table("w").collect()] == [(5.0, 2)]


def test_units_complete_or_take_too_long(spark, tmp_path):
    import datetime

    from voxelframe.streaming.units import EVENTS, current, unit_states

    start = datetime.datetime(2024, 1, 1)
    at = lambda minutes: start + datetime.timedelta(minutes=minutes)
    batches = [
        [("1", "a", "begin", at(0)), ("2", "b", "begin", at(1)), ("1", "a", "begin", at(0)), ("3", "c", "begin", at(2))],
        [("4", "a", "complete", at(5)), ("2", "b", "begin", at(1)), ("5", "d", "complete", at(6))],
        [("6", "x", "begin", at(100))],
        [("7", "y", "begin", at(101)), ("8", "b", "complete", at(102)), ("9", "c", "complete", at(3))],  # the last is too late to count
        [("10", "b", "begin", at(103)), ("11", "z", "begin", at(104))],
        [("12", "b", "complete", at(110)), ("12", "b", "complete", at(110))],
        [("13", "q", "begin", at(300))],
        [("14", "q", "complete", at(301))],
        [("15", "w", "begin", at(302))],
    ]
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    spark.createDataFrame([], EVENTS).write.parquet(source)
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        states = unit_states(spark.readStream.schema(EVENTS).parquet(source), "10 minutes", 3600)
        states.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    minutes = lambda t: None if t is None else (t - start).total_seconds() / 60
    got = sorted((r["unit"], r["state"], minutes(r["began"]), minutes(r["ended"])) for r in spark.read.parquet(out).collect())
    want = {("a", "complete", 0, 5), ("d", "complete", None, 6), ("b", "overdue", 1, None), ("b", "complete", 1, 102), ("b", "complete", 103, 110), ("c", "overdue", 2, None), ("x", "overdue", 100, None), ("y", "overdue", 101, None), ("z", "overdue", 104, None), ("q", "complete", 300, 301)}
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] if r[2] is not None else -1)) or set(got) == want and len(got) == len(want)
    last = {r["unit"]: (r["state"], minutes(r["ended"])) for r in current(spark.read.parquet(out)).collect()}
    assert last["b"] == ("complete", 110) and last["c"] == ("overdue", None)
