"""DuckDB counterparts of the registered queries."""

from oracle.weblog import LINES, WEBLOG

_STD = f"""weblog as ({WEBLOG}),
std as (select * from (select *, try_strptime(date || ' ' || time, '%Y-%m-%d %H:%M:%S') as datetime from weblog)
 where datetime is not null)"""

_AGENT = {
    "browser": """case when user_agent is null then 'Unknown'
  when regexp_matches(user_agent, '(?i)googlebot') then 'Googlebot'
  when regexp_matches(user_agent, '(?i)bingbot') then 'Bingbot'
  when regexp_matches(user_agent, '(?i)bot|crawl|spider|slurp') then 'Other Bot'
  when regexp_matches(user_agent, '(?i)edg/') then 'Edge'
  when regexp_matches(user_agent, '(?i)opr/') then 'Opera'
  when regexp_matches(user_agent, '(?i)firefox/') then 'Firefox'
  when regexp_matches(user_agent, '(?i)chrome/.*mobile') then 'Chrome Mobile'
  when regexp_matches(user_agent, '(?i)chrome/') then 'Chrome'
  when regexp_matches(user_agent, '(?i)version/.*mobile.*safari') then 'Mobile Safari'
  when regexp_matches(user_agent, '(?i)version/.*safari') then 'Safari'
  when regexp_matches(user_agent, '(?i)curl/') then 'curl' else 'Other' end""",
    "browser_version": "case " + " ".join(
        f"when regexp_matches(user_agent, '(?i){t}/') then nullif(regexp_extract(user_agent, '(?i){t}/([0-9][0-9.]*)', 1), '')"
        for t in ("googlebot", "bingbot", "edg", "opr", "firefox", "chrome", "version", "curl")) + " end",
    "os": """case when user_agent is null then 'Unknown'
  when regexp_matches(user_agent, '(?i)windows') then 'Windows'
  when regexp_matches(user_agent, '(?i)iphone|ipad|ipod') then 'iOS'
  when regexp_matches(user_agent, '(?i)android') then 'Android'
  when regexp_matches(user_agent, '(?i)mac os x') then 'Mac OS X'
  when regexp_matches(user_agent, '(?i)linux|x11') then 'Linux' else 'Other' end""",
    "device": """case when user_agent is null then 'Unknown'
  when regexp_matches(user_agent, '(?i)bot|crawl|spider|slurp') then 'Spider'
  when regexp_matches(user_agent, '(?i)iphone') then 'iPhone'
  when regexp_matches(user_agent, '(?i)ipad') then 'iPad'
  when regexp_matches(user_agent, '(?i)ipod') then 'iPod'
  when regexp_matches(user_agent, '(?i)android') then 'Android'
  when regexp_matches(user_agent, '(?i)mac os x') then 'Mac' else 'Other' end""",
    "is_mobile": "coalesce(regexp_matches(user_agent, '(?i)iphone|ipod|android.*mobile|windows phone'), false)::bigint",
    "is_bot": "coalesce(regexp_matches(user_agent, '(?i)bot|crawl|spider|slurp'), false)::bigint",
}
_AGENT_COLUMNS = ", ".join(f"{sql} as {name}" for name, sql in _AGENT.items())

_URI = """coalesce(length({u}), 0)::bigint as uri_length,
 coalesce(contains({u}, '?'), false)::bigint as has_query_params,
 coalesce(length({u}) - length(replace({u}, '/', '')), 0)::bigint as uri_depth,
 coalesce(nullif(regexp_extract({u}, '[.]([a-zA-Z0-9]+)$', 1), ''), 'none') as file_extension"""

_OCTET = "case when len(string_split(ip, '.')) = 4 then try_cast(string_split(ip, '.')[1] as int) end"

_FEAT = f"""{_STD},
feat as (select event_id, datetime, ip, method, uri, referer, user_agent,
 hour(datetime)::bigint as hour, (isodow(datetime) - 1)::bigint as dayofweek,
 month(datetime)::bigint as month, day(datetime)::bigint as day,
 (isodow(datetime) >= 6)::bigint as is_weekend,
 try_cast(status as double) as status,
 coalesce(try_cast(status as double) >= 400, false)::bigint as is_error,
 coalesce(try_cast(status as double) >= 500, false)::bigint as is_server_error,
 coalesce(try_cast(status as double) between 400 and 499.999999, false)::bigint as is_client_error,
 coalesce(try_cast(status as double) < 400, false)::bigint as is_success,
 coalesce(try_cast(bytes as double), 0) as bytes,
 ln(1 + coalesce(try_cast(bytes as double), 0)) as bytes_log,
 coalesce(try_cast(response_time as double), 0) as response_time,
 ln(1 + coalesce(try_cast(response_time as double), 0)) as response_time_log,
 {_URI.format(u='uri')},
 {_AGENT_COLUMNS},
 case when {_OCTET} is not null and string_split(ip, '.')[1] in ('10','192','172') then 1 else 0 end::bigint as is_private_ip,
 coalesce({_OCTET}, 0)::bigint as ip_first_octet,
 case when {_OCTET} is null then 'Unknown' when {_OCTET} < 128 then 'A' when {_OCTET} < 192 then 'B' else 'C' end as subnet_class
 from std)"""

_SECURITY = f"""{_FEAT},
ipsec as (select ip, count(*)::bigint as is_error_count, sum(is_error)::bigint as is_error_sum,
 avg(is_error) as is_error_mean, count(datetime)::bigint as datetime_count,
 count(distinct datetime)::bigint as datetime_nunique, count(distinct uri)::bigint as uri_nunique
 from feat where ip is not null group by ip),
suspects as (select ipsec.*, (select count(distinct datetime) from feat)::bigint as distinct_times from ipsec
 where is_error_mean > 0.5 or datetime_count > 0.1 * (select count(distinct datetime) from feat) or uri_nunique > 100)"""

_SUSPECT_COLUMNS = ("ip, is_error_count, is_error_sum, round(is_error_mean, 6) as is_error_mean, "
                    "datetime_count, datetime_nunique, uri_nunique")

_ATTACK = f"""{_FEAT},
hits as (select *,
 coalesce(regexp_matches(uri, '(?i)(union|select|insert|delete|drop|script)'), false)::bigint as is_sql_injection,
 coalesce(regexp_matches(uri, '(?i)(<script|javascript:|onload=)'), false)::bigint as is_xss,
 coalesce(regexp_matches(uri, '(\\.\\./|\\.\\.\\\\)'), false)::bigint as is_traversal from feat)"""

_PERF = f"""{_FEAT},
perf as (select avg(response_time) as mean_response, avg(is_error) as error_share,
 sum(bytes) / 1073741824.0 as bandwidth_gb,
 (select count(*) from feat where response_time > 2 * (select avg(response_time) from feat))::bigint as slow_requests,
 (select count(*) from feat where response_time > 2 * (select avg(response_time) from feat)) / count(*) as slow_share,
 (select max(n) / avg(n) from (select count(*) as n from feat group by hour)) as peak_ratio from feat)"""


def _calendar(grain: str) -> str:
    mean = ", avg(response_time) as response_time" if grain == "hour" else ""
    filled = ", coalesce(response_time, 0) as response_time" if grain == "hour" else ""
    return f"""{_FEAT},
buckets as (select date_trunc('{grain}', datetime)::timestamp as datetime, count(ip) as requests,
 sum(is_error) as is_error, sum(bytes) as bytes{mean} from feat group by 1),
series as (select c.datetime, coalesce(requests, 0)::bigint as requests, coalesce(is_error, 0)::bigint as is_error,
 coalesce(bytes, 0) as bytes{filled}
 from (select unnest(generate_series(min(datetime), max(datetime), interval 1 {grain})) as datetime from buckets) c
 left join buckets b on b.datetime = c.datetime)"""


_HOURLY = _calendar("hour")
def _unit(text: str) -> str:
    """Number of the unit line for a text, by the first 13 hex digits of its md5 sum."""
    return f"(('0x' || substr(md5({text}), 1, 13))::bigint::double / 4503599627370496::double)"


def _path(n: str) -> str:
    """Mean depth of an unsuccessful search among n rows."""
    return (f"(case when {n} < 2 then 0 when {n} = 2 then 1 else "
            f"2 * (ln({n} - 1::double) + 0.5772156649015329::double) - 2 * ({n} - 1::double) / {n} end)")


# Isolation forest over a relation ``{0}`` of (datetime, requests): 100 trees of 256 rows, 8 levels.
_FOREST = """
base as (select datetime, requests::double as x, count(*) over () as n, """ + _unit("'42|' || datetime") + """ as place from {0}),
joined as (select datetime, x, floor((place + j) / share)::bigint as tree from (
 select *, unnest(range(0, ceil(100 * share - place)::bigint)) as j from (
  select *, least(1::double, 512::double / n) as share from base))),
drawn as (select * from (select *, row_number() over (partition by tree order by """ + _unit("'42|' || tree || '|' || datetime") + """,
 datetime) as r from joined where tree < 100) where r <= 256),
grow(tree, datetime, x, node, depth) as (
 select tree, datetime, x, 1::bigint, 0 from drawn
 union all
 select tree, datetime, x, case when x <= low + u * (high - low) then 2 * node else 2 * node + 1 end, depth + 1 from (
  select *, min(x) over w as low, max(x) over w as high, """ + _unit("'42|' || tree || '|' || node || '|cut'") + """ as u
  from grow window w as (partition by tree, node)) where high > low and depth < 8),
nodes as (select tree, node, any_value(depth) as depth, count(*) as n, min(x) as low, max(x) as high,
 """ + _unit("'42|' || tree || '|' || node || '|cut'") + """ as u from grow group by tree, node),
walk(datetime, x, tree, node) as (
 select datetime, x, tree, 1::bigint from base, (select distinct tree from drawn)
 union all
 select datetime, x, tree, case when x <= low + u * (high - low) then 2 * node else 2 * node + 1 end
 from walk join nodes using (tree, node) where high > low and depth < 8),
ends as (select datetime, tree, max(node) as node from walk group by datetime, tree),
forest as (select datetime, power(2, -avg(depth + """ + _path("n") + """) / (select """ + _path("max(n)") + """ from nodes)) as isolation_score
 from ends join nodes using (tree, node) group by datetime),
flagged as (select datetime, isolation_score, isolation_score > quantile_cont(isolation_score, 0.95) over () + 1e-12
 as is_isolation_forest from forest)"""
_VOTES = f"""{_HOURLY},
numbered as (select *, row_number() over (order by datetime) as rn, least(24, count(*) over () // 4) as w from series),
rolled as (select a.datetime, any_value(a.requests) as requests, any_value(a.is_error) as is_error,
 any_value(a.bytes) as bytes, any_value(a.response_time) as response_time,
 case when any_value(a.w) > 1 and any_value(a.rn) >= any_value(a.w) then avg(b.requests) end as rolling_mean,
 case when any_value(a.w) > 1 and any_value(a.rn) >= any_value(a.w) then stddev_samp(b.requests) end as rolling_std
 from numbered a join numbered b on b.rn between a.rn - a.w + 1 and a.rn group by a.datetime),
scored as (select *, abs(requests - avg(requests) over ()) / nullif(stddev_pop(requests) over (), 0) as z_score from rolled),
votes as (select *, coalesce(z_score > 3, false) as is_zscore,
 coalesce(abs(requests - rolling_mean) > 2 * rolling_std, false) as is_moving_average,
 coalesce(z_score > 3, false)::bigint + coalesce(abs(requests - rolling_mean) > 2 * rolling_std, false)::bigint as anomaly_score
 from scored)"""

_HOUR_COLUMNS = "datetime, requests, is_error, round(bytes, 6) as bytes, round(response_time, 6) as response_time"

_PROFILE = [("hour", "avg", "mean"), ("hour", "stddev_samp", "std"), ("hour", "min", "min"),
            ("hour", "max", "max"), ("dayofweek", "avg", "mean"), ("dayofweek", "stddev_samp", "std"),
            ("is_error", "avg", "mean"), ("is_error", "sum", "sum"), ("is_success", "sum", "sum"),
            ("bytes", "avg", "mean"), ("bytes", "sum", "sum"), ("response_time", "avg", "mean"),
            ("response_time", "max", "max"), ("uri_length", "avg", "mean"), ("is_mobile", "avg", "mean"),
            ("is_bot", "avg", "mean")]
_PROFILE_NAMES = [f"{c}_{n}" for c, _, n in _PROFILE]
_VECTOR = ", ".join(_PROFILE_NAMES)
_PROF = f"""{_FEAT},
prof as (select ip, {', '.join(f'coalesce({f}({c}), 0)::double as {c}_{n}' for c, f, n in _PROFILE)}
 from feat where ip is not null group by ip),
scaled as (select ip, {', '.join(
    f'case when max({c}) over () = min({c}) over () then 0.0 else ({c} - avg({c}) over ()) / stddev_pop({c}) over () end as {c}'
    for c in _PROFILE_NAMES)} from prof)"""


def _rounded(names) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n}" for n in names)


def _dbscan(cols, eps=0.5, min_samples=5) -> str:
    gap = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
    return f"""with recursive {_PROF},
near as (select a.ip as p, b.ip as q from scaled a, scaled b where {gap} <= {eps * eps}),
cores as (select p from near group by p having count(*) >= {min_samples}),
reach as (select p as node, p as root from cores union
 select n.q, r.root from reach r join near n on n.p = r.node join cores c on c.p = n.q),
comp as (select node, min(root) as root from reach group by node),
core_label as (select node, dense_rank() over (order by root) - 1 as label from comp),
labels as (select s.ip, coalesce(c.label, (select min(l.label) from near n join core_label l on l.node = n.q where n.p = s.ip), -1)::bigint as outlier_cluster
 from scaled s left join core_label c on c.node = s.ip)"""


_DENSE_PAIR = ["is_mobile_mean", "is_bot_mean"]


def _messages(name: str, cte: str, rules) -> str:
    union = " union all ".join(
        f"select {i} as i, {text} as {name} from {source} where {condition}"
        for i, (source, condition, text) in enumerate(rules))
    return f"with {cte} select (row_number() over (order by i) - 1)::bigint as position, {name} from ({union})"


def _top(column: str, k: int) -> str:
    return (f"with {_FEAT} select {column}, count(*)::bigint as requests from feat where {column} is not null "
            f"group by {column} order by requests desc, {column} limit {k}")


_TRAFFIC = """count(*)::bigint as total_requests, count(distinct ip)::bigint as unique_ips,
 min(datetime) as first_request, max(datetime) as last_request,
 round(avg(is_error) * 100, 6) as error_rate_pct, round(avg(is_server_error) * 100, 6) as server_error_rate_pct,
 round(avg(is_client_error) * 100, 6) as client_error_rate_pct, round(avg(is_weekend) * 100, 6) as weekend_traffic_pct,
 round(epoch(max(datetime) - min(datetime)) / 3600, 6) as duration_hours,
 round(count(*) / greatest(1.0, epoch(max(datetime) - min(datetime)) / 3600), 6) as requests_per_hour"""
_BANDWIDTH = """case when sum(bytes) > 0 then sum(bytes)::bigint end as total_bytes,
 case when sum(bytes) > 0 then round(avg(bytes), 6) end as avg_response_size,
 case when sum(bytes) > 0 then round(sum(bytes) / 1073741824.0, 6) end as total_bandwidth_gb"""
_RESPONSE = """case when sum(response_time) > 0 then round(avg(response_time), 6) end as avg_response_time,
 case when sum(response_time) > 0 then max(response_time) end as max_response_time"""
_P95 = "case when sum(response_time) > 0 then round(quantile_cont(response_time, 0.95), 6) end as response_time_95th"
_DEVICES = "round(avg(is_mobile) * 100, 6) as mobile_traffic_pct, round(avg(is_bot) * 100, 6) as bot_traffic_pct"

_LINES = f"weblog as ({WEBLOG}), lines as ({LINES.format(t=chr(9))})"

_FEATURE_COLUMNS = f"""event_id, datetime, hour, dayofweek, month, day, is_weekend, status, is_error, is_server_error,
 is_client_error, is_success, bytes, round(bytes_log, 6) as bytes_log, response_time,
 round(response_time_log, 6) as response_time_log, uri_length, has_query_params, uri_depth, file_extension"""


def build() -> dict[str, str]:
    sql = {
        "parsed_lines": f"""with {_LINES} select try_strptime(date || ' ' || time, '%Y-%m-%d %H:%M:%S')
  - case when kind = 'tsv9' and event_id % 3 = 0 then interval 2 hour else interval 0 hour end as datetime, ip, method,
 case when kind in ('tsv11', 'tsv9') then uri else u end as uri, status, bytes,
 case when kind in ('tsv11', 'tsv9') then response_time end as response_time,
 case when kind <> 'tsv9' then referer end as referer,
 case kind when 'tsv11' then user_agent when 'tsv9' then null else a end as user_agent,
 case when kind in ('clf', 'space11') then 'HTTP/1.1' end as protocol,
 case when kind = 'tsv11' then 'sid=' || event_id end as cookie, kind as layout
 from lines where kind in ('tsv11', 'tsv9', 'clf', 'space11')""",
        "short_series": f"""with {_HOURLY} select count(*)::bigint as hours, count(distinct datetime::date)::bigint as days,
 0::bigint as detected, 0::bigint as predicted from series""",
        "quarantine_from_files": f"""with {_LINES} select value as raw_line, 'txt' as suffix from lines
 where kind in ('junk', 'long', 'notime')""",
        "quarantined_lines": f"""with {_LINES} select value as raw_line from lines
 where kind in ('junk', 'long', 'notime')""",
        "standardized_log": f"""with {_STD} select event_id, datetime, ip, method, uri, status, bytes, response_time, referer, user_agent from std""",
        "log_features": f"with {_FEAT} select {_FEATURE_COLUMNS} from feat",
        "page_uri_features": f"select page_id, {_URI.format(u='url')} from pages",
        "user_agent_dim": f"with {_FEAT} select distinct user_agent, {', '.join(_AGENT)} from feat",
        "user_agent_features": f"with {_FEAT} select event_id, {', '.join(_AGENT)} from feat",
        "ip_features": f"with {_FEAT} select event_id, ip, is_private_ip, ip_first_octet, subnet_class from feat",
        "traffic_summary": f"with {_FEAT} select {_TRAFFIC} from feat",
        "traffic_by_method": f"with {_FEAT} select method, {_TRAFFIC} from feat group by method",
        "overview": f"with {_FEAT} select {_TRAFFIC}, {_BANDWIDTH}, {_RESPONSE}, {_DEVICES} from feat",
        "bandwidth_stats": f"with {_FEAT} select {_BANDWIDTH} from feat",
        "response_time_stats": f"with {_FEAT} select {_RESPONSE}, {_P95} from feat",
        "response_time_by_method": f"with {_FEAT} select method, {_RESPONSE}, {_P95} from feat group by method",
        "device_mix": f"with {_FEAT} select {_DEVICES} from feat",
        "status_breakdown": _top("status", 10),
        "top_ips": _top("ip", 10),
        "top_uris": _top("uri", 10),
        "top_user_agents": _top("user_agent", 5),
        "top_uris_by_method": f"""with {_FEAT}, c as (select method, uri, count(*)::bigint as requests from feat
 where uri is not null group by 1, 2)
 select * from c qualify row_number() over (partition by method order by requests desc, uri) <= 3""",
        "peak_hour": f"""with {_FEAT}, c as (select hour, count(*)::bigint as n from feat group by 1)
 select arg_max(hour, row(n, -hour)) as peak_hour, max(n) as requests from c""",
        "peak_weekday": f"""with {_FEAT}, c as (select dayofweek, count(*)::bigint as n from feat group by 1)
 select arg_max(dayofweek, row(n, -dayofweek)) as peak_dayofweek, max(n) as requests from c""",
        "hour_profile": f"with {_FEAT} select hour, count(*)::bigint as requests from feat group by hour",
        "peak_ratio": f"with {_FEAT} select round(max(n) / avg(n), 6) as peak_ratio from (select count(*) as n from feat group by hour)",
        "attack_hits": f"""with {_ATTACK} select event_id, ip, uri, is_sql_injection, is_xss, is_traversal from hits
 where is_sql_injection + is_xss + is_traversal > 0""",
        "attack_pattern_counts": f"""with {_ATTACK}, c as (
 select 'sql_injection' as pattern, 'SQL Injection attempts' as label, sum(is_sql_injection)::bigint as requests from hits union all
 select 'xss', 'XSS attempts', sum(is_xss)::bigint from hits union all
 select 'traversal', 'Directory traversal', sum(is_traversal)::bigint from hits)
 select pattern, requests, label || ': ' || requests || ' requests' as message from c where requests > 0""",
        "ip_security_profile": f"with {_SECURITY} select {_SUSPECT_COLUMNS} from ipsec",
        "distinct_times": f"with {_FEAT} select count(distinct datetime)::bigint as distinct_times from feat",
        "suspicious_clients": f"with {_SECURITY} select {_SUSPECT_COLUMNS}, distinct_times from suspects",
        "suspicious_ips": f"with {_SECURITY} select {_SUSPECT_COLUMNS}, distinct_times from suspects order by ip limit 10",
        "threat_level": f"""with {_SECURITY} select case when count(*) > 10 then 'High' when count(*) > 5 then 'Medium' else 'Low' end as threat_level,
 least(count(*), 10)::bigint as total_threats, count(*)::bigint as total_suspicious from suspects""",
        "threat_level_compat": f"""with {_SECURITY} select case when least(count(*), 10) > 10 then 'High' when least(count(*), 10) > 5 then 'Medium' else 'Low' end as threat_level,
 least(count(*), 10)::bigint as total_threats, count(*)::bigint as total_suspicious from suspects""",
        "security_recommendations": _messages("recommendation", _SECURITY, [
            ("(select 1)", "exists (select 1 from suspects)", "'Consider blocking or rate-limiting suspicious IP addresses'"),
            ("(select avg(is_error) as m from feat)", "m > 0.1", "'High error rate detected - review server configuration'"),
            ("(select avg(is_bot) as m from feat)", "m > 0.3", "'High bot traffic - implement bot protection measures'")]),
        "slow_requests": f"""with {_FEAT} select event_id, ip, uri, response_time from feat
 where response_time > 2 * (select avg(response_time) from feat)""",
        "slow_request_stats": f"with {_PERF} select slow_requests, round(slow_share, 6) as slow_share from perf",
        "slow_request_stats_by_method": f"""with {_FEAT}, m as (select method, avg(response_time) as mean from feat group by 1)
 select method, count(*) filter (where response_time > 2 * mean)::bigint as slow_requests,
 round(count(*) filter (where response_time > 2 * mean) / count(*), 6) as slow_share from feat join m using (method) group by method""",
        "performance_score": f"""with {_PERF}, s as (select greatest(0, least(100, 85
 - case when mean_response > 2000 then 20 else 0 end - case when mean_response > 0 and slow_share > 0.1 then 15 else 0 end
 - case when error_share > 0.05 then 25 else 0 end - case when peak_ratio > 3 then 10 else 0 end))::bigint as performance_score from perf)
 select performance_score, case when performance_score >= 80 then 'excellent' when performance_score >= 60 then 'good' else 'poor' end as score_band from s""",
        "bottlenecks": _messages("bottleneck", _PERF, [
            ("perf", "mean_response > 2000", "'Slow average response time: ' || printf('%.0f', round_even(mean_response, 0)) || 'ms'"),
            ("perf", "mean_response > 0 and slow_share > 0.1", "'High number of slow requests: ' || slow_requests"),
            ("perf", "error_share > 0.05", "'High error rate: ' || printf('%.1f', round_even(error_share * 100, 1)) || '%'"),
            ("perf", "peak_ratio > 3", "'Uneven traffic distribution - consider load balancing'")]),
        "resource_usage": f"with {_PERF} select round_even(bandwidth_gb, 2) as bandwidth_gb from perf",
        "optimization_tips": _messages("tip", _PERF, [
            ("perf", "bandwidth_gb > 100", "'High bandwidth usage - optimize content delivery'"),
            ("perf", "bandwidth_gb <= 100 and error_share > 0", "'Reduce error rates by fixing broken links and server issues'"),
            ("perf", "bandwidth_gb <= 100", "'Implement caching to improve response times'"),
            ("perf", "bandwidth_gb <= 100", "'Monitor traffic patterns for capacity planning'")]),
        "hourly_rollup": f"with {_HOURLY} select {_HOUR_COLUMNS} from series",
        "daily_rollup": f"with {_calendar('day')} select datetime, requests, is_error, round(bytes, 6) as bytes from series",
        "kept_hourly_rollup": f"with {_HOURLY} select {_HOUR_COLUMNS} from series",
        "kept_daily_rollup": f"with {_calendar('day')} select datetime, requests, is_error, round(bytes, 6) as bytes from series",
        "requests_per_hour": f"with {_HOURLY} select datetime, requests as rows from series",
        "hourly_rollup_by_method": f"""with {_FEAT},
 b as (select method, date_trunc('hour', datetime)::timestamp as datetime, count(ip) as requests, sum(is_error) as is_error,
  sum(bytes) as bytes, avg(response_time) as response_time from feat group by 1, 2),
 c as (select method, unnest(generate_series(min(datetime), max(datetime), interval 1 hour)) as datetime from b group by method)
 select method, datetime, coalesce(requests, 0)::bigint as requests, coalesce(is_error, 0)::bigint as is_error,
 round(coalesce(bytes, 0), 6) as bytes, round(coalesce(response_time, 0), 6) as response_time
 from c left join b using (method, datetime)""",
        "rolling_stats": f"with {_VOTES} select datetime, requests, round(rolling_mean, 6) as rolling_mean, round(rolling_std, 6) as rolling_std from votes",
        "zscore_anomalies": f"with {_VOTES} select datetime, requests, round(z_score, 6) as z_score, is_zscore from votes",
        "moving_average_anomalies": f"with {_VOTES} select datetime, requests, is_moving_average from votes",
        "anomaly_votes": f"with {_VOTES} select datetime, requests, is_zscore, is_moving_average, anomaly_score, anomaly_score > 0 as is_anomaly from votes",
        "anomalous_hours": f"with {_VOTES} select datetime, requests, anomaly_score from votes where anomaly_score > 0",
        "anomaly_summary": f"""with {_VOTES} select count(*) filter (where anomaly_score > 0)::bigint as total_anomalies,
 round(count(*) filter (where anomaly_score > 0) / count(*) * 100, 6) as anomaly_rate,
 max(requests)::bigint as max_requests, round(avg(requests), 6) as avg_requests from votes""",
        "error_rate_series": f"with {_HOURLY} select datetime, round(coalesce(is_error / nullif(requests, 0), 0) * 100, 6) as error_rate from series",
        "ip_profile": f"with {_PROF} select ip, {_rounded(_PROFILE_NAMES)} from prof",
        "ip_profile_head": f"with {_PROF} select ip, {_rounded(_PROFILE_NAMES)} from prof order by ip limit 20",
        "scaled_profile": f"with {_PROF} select ip, {_rounded(_PROFILE_NAMES)} from scaled",
        "dbscan_labels": f"{_dbscan(_PROFILE_NAMES)} select ip, outlier_cluster from labels",
        "dbscan_labels_two_features": f"{_dbscan(_DENSE_PAIR)} select ip, outlier_cluster from labels",
        "dbscan_outliers": f"{_dbscan(_DENSE_PAIR)} select ip, outlier_cluster from labels where outlier_cluster = -1",
        "future_frame": f"""with {_HOURLY}, e as (select min(datetime) as a, max(datetime) as b from series)
 select ds, ds > b as is_future from (select unnest(generate_series(a, b + interval 48 hour, interval 1 hour)) as ds, b from e)""",
        "live_traffic": f"""with {_FEAT} select date_trunc('hour', datetime)::timestamp as window_start,
 (date_trunc('hour', datetime) + interval 1 hour)::timestamp as window_end, count(*)::bigint as requests, sum(is_error)::bigint as errors
 from feat group by 1, 2""",
        "live_ip_profile": f"""with {_FEAT} select date_trunc('hour', datetime)::timestamp as window_start, ip, count(*)::bigint as requests,
 round(avg(is_error), 6) as is_error_mean, true as uris_close from feat where ip is not null group by 1, 2""",
        "live_attacks": f"""with {_ATTACK} select event_id, ip, uri, is_sql_injection, is_xss, is_traversal from hits
 where is_sql_injection + is_xss + is_traversal > 0""",
        "silhouette_bands": f"""with {_PROF},
 p as (select ip, case when hour_mean > 0 then 1 else 0 end as band, [{_VECTOR}] as x from scaled),
 d as (select a.ip, a.band = b.band as own, avg(power(list_distance(a.x, b.x), 2)) as s, avg(list_distance(a.x, b.x)) as e
  from p a join p b on a.ip <> b.ip group by a.ip, a.band, b.band),
 w as (select ip, max(s) filter (own) as a, min(s) filter (not own) as b, max(e) filter (own) as c, min(e) filter (not own) as f
  from d group by ip)
 select round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) as squared,
  round(avg(coalesce((f - c) / nullif(greatest(c, f), 0), 0)), 6) as euclidean from w""",
        "json_rows": f"""with {_FEAT}, v as (select event_id, method, status::bigint::varchar as status,
  case when event_id % 5 = 0 then 'null' else floor(bytes)::bigint || '.0' end as b from feat)
 select event_id, '{{"bytes":' || b || ',"sizes":[' || b || ',null,1.5],"by":{{"last":{{"all":[' || b || '],"method":"' || method ||
  '"}}}},"status":' || coalesce(status, 'null') || '}}' as json from v""",
        "ranked_dimensions": f"""with {_FEAT}, v as (
  select 'status' as dimension, 10 as k, status::double as number, null::varchar as text from feat
  union all select 'ip', 10, null, ip from feat union all select 'uri', 10, null, uri from feat
  union all select 'user_agent', 5, null, user_agent from feat
  union all select 'hour', 1, hour::double, null from feat union all select 'dayofweek', 1, dayofweek::double, null from feat),
 c as (select dimension, k, number, text, count(*)::bigint as requests from v where number is not null or text is not null group by all)
 select dimension, number, text, requests, rank from (select *, row_number() over (
  partition by dimension order by requests desc, number nulls first, text nulls first) as rank from c) where rank <= k""",
        "silhouette_bounds": f"""with {_PROF},
 p as (select ip, list_sum(x) > 0 as own, x from (select ip, [{_VECTOR}] as x from scaled)),
 d as (select a.ip, a.own = b.own as own, avg(power(list_distance(a.x, b.x), 2)) as s, avg(list_distance(a.x, b.x)) as e
  from p a join p b on a.ip <> b.ip group by a.ip, a.own, b.own),
 w as (select ip, max(s) filter (own) as a, min(s) filter (not own) as b, max(e) filter (own) as c, min(e) filter (not own) as f
  from d group by ip)
 select round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 4) as squared,
  round(avg(coalesce((f - c) / nullif(greatest(c, f), 0), 0)), 6) as euclidean, true as bounded from w""",
        "kmeans_facts": f"""with {_PROF} select count(*)::bigint as clients, 3::bigint as clusters, 0::bigint as misplaced,
 0::bigint as summary_off, count(*)::bigint as sized from prof""",
        "pca_facts": f"""with recursive {_PROF},
 l as (select ip, unnest(x) as v, generate_subscripts(x, 1) as j from (select ip, [{_VECTOR}] as x from scaled)),
 c as (select a.j as i, b.j as j, covar_samp(a.v, b.v) as c from l a join l b using (ip) group by all),
 m as (select list(r order by i) as a from (select i, list(c order by j) as r from c group by i)),
 it(n, v) as (select 0, list_transform(a, lambda r: 1.0 + r[1]) from m
  union all select n + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
  from (select n, list_transform(a, lambda r: list_dot_product(r, v)) as w from it, m) where n < 1000)
 select 0.0::double as mean_x, 0.0::double as mean_y, 0.0::double as covariance,
  round(list_dot_product(v, list_transform(a, lambda r: list_dot_product(r, v))), 4) as variance from it, m where n = 1000""",
        "isolation_forest_anomalies": f"""with recursive {_HOURLY}, {_FOREST.format('series')}
 select {_HOUR_COLUMNS}, round(isolation_score, 6) as isolation_score, is_isolation_forest from series join flagged using (datetime)""",
        "detect_anomalies": f"""with recursive {_VOTES}, {_FOREST.format('series')},
 all_votes as (select *, anomaly_score + is_isolation_forest::bigint as total from votes join flagged using (datetime))
 select {_HOUR_COLUMNS}, is_zscore, is_moving_average, is_isolation_forest, total as anomaly_score, total > 0 as is_anomaly
 from all_votes""",
        "forest_facts": f"with {_HOURLY} select count(*)::bigint as hours, true as few_flagged, true as equal_scores from series",
        "vote_facts": f"with {_VOTES} select datetime, is_zscore, is_moving_average, true as adds_up from votes",
        "forecast_facts": f"""with {_HOURLY}, e as (select min(datetime) as a, max(datetime) as b from series)
 select ds, ds > b as is_future, true as adds_up, true as bounded
 from (select unnest(generate_series(a, b + interval 48 hour, interval 1 hour)) as ds, b from e)""",
        "forecast_fit": f"with {_HOURLY} select count(*)::bigint as hours, true as better_than_mean from series",
        "forecast_certificate": f"""with {_HOURLY} select 41::bigint as terms, 41::bigint as distinct_terms, true as optimal
 from series having count(*) >= 48""",
        "report_sections": f"""with {_FEAT}, one as (select unnest(['stats', 'response_time', 'peak_hour', 'peak_dayofweek', 'threat_level',
  'performance_score', 'resource_usage', 'anomaly_stats']) as section, 1 as rows),
 ips as (select count(distinct ip) as n from feat), days as (select count(*) as n from
  (select unnest(generate_series(min(date_trunc('day', datetime)), max(date_trunc('day', datetime)), interval 1 day)) from feat)),
 hours as (select count(*) as n from
  (select unnest(generate_series(min(date_trunc('hour', datetime)), max(date_trunc('hour', datetime)), interval 1 hour)) from feat)),
 parts as (select * from one
  union all select 'status_breakdown', least(10, count(distinct status)) from feat
  union all select 'top_uris', least(10, count(distinct uri)) from feat
  union all select 'top_user_agents', least(5, count(distinct user_agent)) from feat
  union all select 'top_ips', least(10, n) from ips union all select 'clusters', least(20, n) from ips
  union all select 'cluster_points', n from ips
  union all select 'suspicious_ips', count(*) from (@suspicious_ips@)
  union all select 'hourly', n from hours union all select 'daily', n from days
  union all select 'forecast', n + 48 from hours union all select 'forecast_next', 24)
 select section, rows::bigint as rows from parts""",
    }
    sql["logs_from_files"] = f"""select * exclude (layout), 'txt' as suffix from ({sql["parsed_lines"]})
 union all by name (with weblog as ({WEBLOG}) select try_strptime(date || ' ' || time, '%Y-%m-%d %H:%M:%S') as datetime,
 ip, method, uri, status, bytes, response_time, referer, user_agent, null as protocol, null as cookie, 'csv' as suffix from weblog)"""
    sql["report_sections"] = sql["report_sections"].replace("@suspicious_ips@", sql["suspicious_ips"])
    return sql
