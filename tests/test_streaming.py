from conftest import LOG_SCHEMA, request
from hitlens.operators.features import extract_features
from hitlens.streaming import live


def run(spark, log, tmp_path, op, name):
    rows = [request(at=60 * i, uri="/union" if i % 10 == 0 else "/a", status="500" if i % 4 == 0 else "200")
            for i in range(300)]
    log(rows).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = extract_features(spark.readStream.schema(LOG_SCHEMA).parquet(str(tmp_path / "in")))
    query = (op(stream).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.table(name)


def test_windows_closed_by_the_watermark(spark, log, tmp_path):
    out = run(spark, log, tmp_path, live.live_traffic, "traffic").orderBy("window_start").collect()
    assert [(r.requests, r.errors) for r in out] == [(60, 15)] * 3


def test_profiles(spark, log, tmp_path):
    out = run(spark, log, tmp_path, live.live_ip_profile, "profiles").collect()
    assert [(r.ip, r.requests, r.uris) for r in out] == [("1.2.3.4", 60, 2)] * 3


def test_attacks(spark, log, tmp_path):
    assert run(spark, log, tmp_path, live.live_attacks, "attacks").count() == 30


def test_lines_to_windows(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(
        f'1.1.1.1 - - [10/Oct/2000:{h:02d}:00:00 +0000] "GET /{h} HTTP/1.1" 200 5' for h in range(5)) + "\njunk\n")
    stream = extract_features(live.live_logs(spark, str(folder)))
    query = (live.live_traffic(stream).writeStream.format("memory").queryName("lines").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert [r.requests for r in spark.table("lines").collect()] == [1, 1, 1]


def test_run_to_the_end_returns_open_windows(spark, log, tmp_path):
    rows = [request(at=60 * i, status="500" if i % 4 == 0 else "200") for i in range(300)]
    log(rows).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = extract_features(spark.readStream.schema(LOG_SCHEMA).parquet(str(tmp_path / "in")))
    out = live.run_to_end(live.live_traffic(stream), str(tmp_path / "out"), ["window_start", "window_end"])
    assert [(r.requests, r.errors) for r in out.orderBy("window_start").collect()] == [(60, 15)] * 5


def test_quarantine_of_a_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text('1.1.1.1 - - [10/Oct/2000:01:00:00 +0000] "GET / HTTP/1.1" 200 5\njunk\n')
    (folder / "b.bin").write_text("other\n")
    good, bad = live.live_logs(spark, str(folder), quarantine=True)
    for frame, name in ((good, "good_lines"), (bad, "bad_lines")):
        (frame.writeStream.format("memory").queryName(name).trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / name)).start().awaitTermination())
    assert spark.table("good_lines").count() == 1
    assert [r.raw_line for r in spark.table("bad_lines").collect()] == ["junk"]
