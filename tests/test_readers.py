from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hitlens.operators.features import extract_features
from hitlens.schema import CANONICAL
from hitlens.sources.logs import parse_lines, read_logs, standardize, with_datetime
from hitlens.sources.sinks import nan_to_null, write_logs, write_report

AGENT = 'Mozilla/5.0 (X11; Linux x86_64)'
TSV11 = "\t".join(["2024-01-01", "00:00:01", "1.1.1.1", "GET", "/a", "200", "12", "7", "http://r/",
                   AGENT, "sid=1"])
TSV9 = "\t".join(["2024-01-01 00:00:02", "2.2.2.2", "POST", "/b", "404", "-", "-", "http://r/", AGENT])
COMBINED = f'3.3.3.3 - bob [10/Oct/2000:13:55:36 -0700] "GET /c?x=1 HTTP/1.0" 200 2326 "http://r/" "{AGENT}"'
COMMON = '4.4.4.4 - - [10/Oct/2000:13:55:36 +0000] "GET /d HTTP/1.1" 304 -'
NO_PROTOCOL = '5.5.5.5 - - [10/Oct/2000:13:55:36 +0000] "GET /e" 200 1'
NO_REQUEST = '6.6.6.6 - - [10/Oct/2000:13:55:36 +0000] "-" 408 -'
SPACE11 = f'7.7.7.7 - - 2024-01-01T00:00:03 GET /f HTTP/1.1 200 5 "http://r/" "{AGENT}"'


def parse(spark, *lines, layout="auto"):
    df = spark.createDataFrame([(l,) for l in lines], "value string")
    return {r["raw_line"]: r for r in parse_lines(df, layout).collect()}


def test_every_layout(spark):
    rows = parse(spark, TSV11, TSV9, COMBINED, COMMON, NO_PROTOCOL, NO_REQUEST, SPACE11)
    a = rows[TSV11]
    assert (a.layout, a.datetime, a.ip, a.uri, a.status, a.response_time, a.user_agent, a.cookie) == (
        "tsv11", datetime(2024, 1, 1, 0, 0, 1), "1.1.1.1", "/a", "200", "7", AGENT, "sid=1")
    b = rows[TSV9]
    assert (b.layout, b.datetime, b.method, b.status, b.bytes, b.referer) == (
        "tsv9", datetime(2024, 1, 1, 0, 0, 2), "POST", "404", "-", "http://r/")
    c = rows[COMBINED]
    assert (c.layout, c.datetime, c.user, c.uri, c.protocol, c.bytes, c.user_agent) == (
        "clf", datetime(2000, 10, 10, 20, 55, 36), "bob", "/c?x=1", "HTTP/1.0", "2326", AGENT)
    assert (rows[COMMON].layout, rows[COMMON].uri, rows[COMMON].user_agent) == ("clf", "/d", None)
    assert (rows[NO_PROTOCOL].uri, rows[NO_PROTOCOL].protocol) == ("/e", None)
    assert (rows[NO_REQUEST].status, rows[NO_REQUEST].uri) == ("408", None)
    s = rows[SPACE11]
    assert (s.layout, s.datetime, s.uri, s.user_agent) == (
        "space11", datetime(2024, 1, 1, 0, 0, 3), "/f", AGENT)


def test_short_long_and_broken_lines(spark):
    short = "2024-01-01\t00:00:01\t1.1.1.1\tGET\t/a"
    long_line = TSV11 + "\textra"
    impossible = "2024-02-31\t00:00:01\t1.1.1.1\tGET\t/a\t200"
    header = "date\ttime\tip\tmethod\turi\tstatus"
    quote = "2024-01-01\t00:00:01\t1.1.1.1\tGET\t/a\t200\t1\t1\t-\tBad \" agent\t-"
    quoted = '2024-01-01\t00:00:01\t1.1.1.1\tGET\t"/a b"\t200'
    rows = parse(spark, short, long_line, impossible, header, "some words only here", quote, quoted)
    assert (rows[short].layout, rows[short].uri, rows[short].status) == ("tsv11", "/a", None)
    assert rows[long_line].layout is None
    assert rows[impossible].datetime is None
    assert rows[header].layout is None and rows[header].datetime is None
    assert rows["some words only here"].layout is None
    assert rows[quote].user_agent == 'Bad " agent'
    assert rows[quoted].uri == "/a b"


def test_forced_layout(spark):
    rows = parse(spark, TSV9, TSV11, layout="tsv9")
    assert rows[TSV9].layout == "tsv9" and rows[TSV11].layout is None
    with pytest.raises(ValueError):
        parse_lines(spark.createDataFrame([("x",)], "value string"), "nope")


def test_read_folder_of_mixed_files(spark, tmp_path):
    (tmp_path / "a.LOG").write_text(COMBINED + "\n\njunk\n")
    (tmp_path / "b.TSV").write_text(TSV11 + "\n" + TSV9 + "\n")
    (tmp_path / "c.Csv").write_text(
        "timestamp,ip,status,uri,User-Agent\n"
        '2024-01-01 00:00:04,8.8.8.8,200,"/g,h","agent, one"\n'
        "2024-01-01 00:00:05,8.8.8.9,200\n"
        "2024-01-01 00:00:06,8.8.8.7,200,/x,a,b,c\n"
        "never,8.8.8.6,200,/x,a\n")
    (tmp_path / "d.bin").write_text(COMMON + "\n")
    (tmp_path / "e.txt").write_text("")
    good, bad = read_logs(spark, str(tmp_path), quarantine=True)
    assert good.columns == CANONICAL.fieldNames() + ["source_file"]
    rows = {r.ip: r for r in good.collect()}
    assert sorted(rows) == ["1.1.1.1", "2.2.2.2", "3.3.3.3", "8.8.8.8", "8.8.8.9"]
    assert (rows["8.8.8.8"].uri, rows["8.8.8.8"].user_agent) == ("/g,h", "agent, one")
    assert rows["8.8.8.9"].uri is None
    assert rows["3.3.3.3"].source_file.endswith("a.LOG")
    assert bad.count() == 3
    lines = [r.raw_line for r in bad.collect()]
    assert "junk" in lines and "2024-01-01 00:00:06,8.8.8.7,200,/x,a,b,c" in lines
    assert read_logs(spark, str(tmp_path), extensions=["bin"]).count() == 1
    # the verdict on a row does not depend on the columns a query reads
    csv = read_logs(spark, str(tmp_path), "csv")
    assert csv.count() == 2 and csv.select("ip").count() == 2 and len(csv.collect()) == 2


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,ip,status\n2024-01-01 00:00:04,8.8.8.8,200\n")
    (tmp_path / "b [1].csv").write_text("ip,timestamp,status,uri\n8.8.4.4,2024-01-01 00:00:05,404,/x\n")
    (tmp_path / "c.csv").write_text("ip,status,date,time,ip\n1.1.1.1,200,2024-01-01,00:00:06,9.9.9.9\n")
    (tmp_path / "odd.csv").write_text("some,other,table\n1,2,3\n")
    good, bad = read_logs(spark, str(tmp_path), "csv", quarantine=True)
    assert sorted((r.ip, r.status, r.uri, r.datetime.second) for r in good.collect()) == [
        ("1.1.1.1", "200", None, 6), ("8.8.4.4", "404", "/x", 5), ("8.8.8.8", "200", None, 4)]
    assert sorted(r.raw_line for r in bad.collect()) == ["1,2,3", "some,other,table"]


def test_offsets_are_instants(spark):
    texts = ["2024-01-01T10:00:00+02:00", "2024-01-01T08:00:00Z", "2024-01-01 10:00:00 +0200",
             "2024-01-01T08:00:00", "2024-01-01 03:00:00.000-0500"]
    lines = ["\t".join([t, "1.1.1.1", "GET", "/", "200", "1", "1"]) for t in texts]
    lines.append('1.1.1.1 - - [01/Jan/2024:10:00:00 +0200] "GET / HTTP/1.1" 200 1')
    lines.append(f'1.1.1.1 - - {texts[0]} GET / HTTP/1.1 200 5 "r" "a"')
    assert {r.datetime for r in parse(spark, *lines).values()} == {datetime(2024, 1, 1, 8)}


def test_times_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist on this day in New York
        text = '1.1.1.1 - - [10/Mar/2024:02:30:00 +0000] "GET / HTTP/1.1" 200 1'
        other = "2024/03/10 02:30:00\t1.1.1.1\tGET\t/\t200\t1\t1"
        rows = parse(spark, text, other)
        assert rows[text].datetime == rows[other].datetime == datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_standardize(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "00:00:01", "1.1.1.1", "200", "9"), ("bad", "x", "1.1.1.2", "200", "9")],
        "date string, time string, ip string, status string, `time-taken` string")
    out = standardize(df)
    assert [(r.ip, r.response_time) for r in out.collect()] == [("1.1.1.1", "9")]
    assert with_datetime(df).where("datetime is null").count() == 1
    with pytest.raises(ValueError):
        standardize(df.drop("status"))
    first = standardize(df.select(F.concat_ws(" ", "date", "time").alias("when"), "ip", "status"))
    assert first.count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), "x"), (1.5, None)], "a double, b string")
    write_report({"part": df}, str(tmp_path / "report"))
    text = "".join(p.read_text() for p in (tmp_path / "report" / "part").glob("*.json"))
    assert sorted(text.split()) == ['{"a":1.5,"b":null}', '{"a":null,"b":"x"}']
    logs = parse_lines(spark.createDataFrame([(TSV11,), (COMMON,)], "value string"))
    write_logs(logs, str(tmp_path / "logs"))
    assert {p.name for p in (tmp_path / "logs").glob("date=*")} == {"date=2024-01-01", "date=2000-10-10"}
    stored = spark.read.parquet(str(tmp_path / "logs"))
    assert stored.schema["status"].dataType.simpleString() == "double" and stored.count() == 2
    text, typed = (sorted(map(repr, extract_features(x).select(
        "ip", "status", "is_error", "bytes", "response_time").collect())) for x in (logs, stored))
    assert text == typed


def test_nan_becomes_null_at_any_depth(spark):
    nan = float("nan")
    schema = ("a double, b array<array<float>>, c map<string,struct<x:double,y:array<double>>>, "
              "d struct<e:struct<f:double,g:string>,h:int>, `i.j` double, k array<int>, l date")
    rows = [(nan, [[1.0, nan], None, []], {"p": (nan, [nan, 2.0]), "q": None}, ((nan, "g"), 1), nan, [1], None),
            (2.0, None, None, None, 3.0, None, None), (None, [], {}, (None, None), None, [], None)]
    df = spark.createDataFrame(rows, schema)
    out = nan_to_null(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    first, second, third = [r.asDict(recursive=True) for r in out.collect()]
    assert first == {"a": None, "b": [[1.0, None], None, []], "c": {"p": {"x": None, "y": [None, 2.0]}, "q": None},
                     "d": {"e": {"f": None, "g": "g"}, "h": 1}, "i.j": None, "k": [1], "l": None}
    assert second == {"a": 2.0, "b": None, "c": None, "d": None, "i.j": 3.0, "k": None, "l": None}
    assert third["b"] == [] and third["c"] == {} and third["d"] == {"e": None, "h": None}
    plain = df.select("k", "l")
    assert nan_to_null(plain).collect() == plain.collect()
