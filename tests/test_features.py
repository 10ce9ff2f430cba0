import math

import pytest

from conftest import request
from hitlens.operators import features

CHROME = "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36"


def test_flags_and_numbers(feats):
    rows = [request(status="-"), request(status="404"), request(status="503"), request(status="302"),
            request(size="-", took="12d"), request(size="abc", took="NaN")]
    out = feats(rows).collect()
    bad = out[0]
    assert bad.status is None
    assert (bad.is_error, bad.is_server_error, bad.is_client_error, bad.is_success) == (0, 0, 0, 0)
    assert (out[1].is_error, out[1].is_client_error, out[1].is_server_error) == (1, 1, 0)
    assert (out[2].is_error, out[2].is_client_error, out[2].is_server_error) == (1, 0, 1)
    assert (out[3].is_error, out[3].is_success) == (0, 1)
    assert (out[4].bytes, out[4].response_time) == (0.0, 0.0)
    assert (out[5].bytes, out[5].response_time) == (0.0, 0.0)
    assert out[0].bytes_log == pytest.approx(math.log(11))


def test_time(feats):
    row = feats([request(at=5 * 86400 + 3600)]).first()  # a Saturday
    assert (row.hour, row.dayofweek, row.month, row.day, row.is_weekend) == (1, 5, 1, 6, 1)


def test_uri(feats):
    rows = feats([request(uri=None), request(uri="/a/b.PNG"), request(uri="/a?x=1.5"),
                  request(uri="/")]).collect()
    assert [(r.uri_length, r.has_query_params, r.uri_depth, r.file_extension) for r in rows] == [
        (0, 0, 0, "none"), (8, 0, 2, "PNG"), (8, 1, 1, "5"), (1, 0, 1, "none")]


def test_ip(feats):
    rows = feats([request(ip=i) for i in
                  ("10.0.0.1", "130.1.1.1", "192.168.0.1", "1.2.3", "x.2.3.4", None)]).collect()
    assert [(r.is_private_ip, r.ip_first_octet, r.subnet_class) for r in rows] == [
        (1, 10, "A"), (0, 130, "B"), (1, 192, "C"), (0, 0, "Unknown"), (0, 0, "Unknown"),
        (0, 0, "Unknown")]


def test_agents_inline_equals_dimension(log):
    agents = [None, CHROME, "Mozilla/5.0 (iPad) Version/17.0 Mobile/1 Safari/6", "weird thing",
              "Mozilla (compatible; bingbot/2.0)", "SuperSpider/1", "Mozilla (Linux; Android 9) Chrome/1.2 Mobile"]
    df = log([request(agent=a) for a in agents])
    inline = features.enrich_user_agents(df)
    joined = features.enrich_user_agents(df, via="dimension").select(*inline.columns)
    assert sorted(map(repr, inline.collect())) == sorted(map(repr, joined.collect()))
    by_agent = {r.user_agent: r for r in inline.collect()}
    assert (by_agent[None].browser, by_agent[None].is_bot) == ("Unknown", 0)
    assert (by_agent["weird thing"].browser, by_agent["weird thing"].os) == ("Other", "Other")
    assert (by_agent[CHROME].browser, by_agent[CHROME].browser_version) == ("Chrome", "120.0")
    assert by_agent["SuperSpider/1"].browser == "Other Bot"
    with pytest.raises(ValueError):
        features.enrich_user_agents(df, via="magic")


def test_absent_columns_are_left_out(log):
    df = log([request()]).drop("bytes", "response_time", "uri", "user_agent")
    out = features.extract_features(df)
    assert "is_error" in out.columns
    assert not {"bytes_log", "uri_length", "is_bot"} & set(out.columns)
