"""The ``weblog`` fixture: raw access-log fields derived from the events table.

The same text runs in Spark SQL and DuckDB.
"""

WEBLOG = """
select event_id, cast(cast(ts as date) as string) as date,
 concat(lpad(cast(hour(ts) as string),2,'0'),':',lpad(cast(minute(ts) as string),2,'0'),':',lpad(cast(second(ts) as string),2,'0')) as time,
 case when event_id % 101 = 0 then 'bad-ip'
  else concat(case u % 5 when 0 then '10' when 1 then '192' when 2 then '172' when 3 then '8' else '203' end,'.',cast(u % 7 as string),'.',cast(cast(floor(u / 256.0) as bigint) as string),'.',cast(u % 256 as string)) end as ip,
 case when event_type in ('purchase','signup') then 'POST' else 'GET' end as method,
 case when event_id % 67 = 0 then null
  when event_id % 8 = 0 then concat('/scan/',cast(event_id as string),'.php')
  when event_id % 53 = 0 then '/search?q=1+UNION+SELECT+pw'
  when event_id % 59 = 0 then '/c?x=<script>alert(1)</script>'
  when event_id % 61 = 0 then '/files/../../etc/passwd'
  else concat('/',event_type,'/',cast(event_id % 20 as string),case event_id % 4 when 1 then '.html' when 2 then '.PNG' when 3 then '?page=2&ref=x' else '' end) end as uri,
 case when event_id % 97 = 0 then '-' when u % 10 = 3 and event_id % 4 <> 0 then '404'
  when event_type = 'error' then case event_id % 3 when 0 then '500' when 1 then '503' else '403' end
  when event_id % 11 = 0 then '301' else '200' end as status,
 case when event_id % 41 = 0 then '-' else cast(cast(floor(value * 100) as bigint) as string) end as bytes,
 case when event_id % 43 = 0 then '-' else cast(cast(floor(value * 10) as bigint) as string) end as response_time,
 concat('https://ref', cast(event_id % 5 as string), '.example.org/') as referer,
 case event_id % 7 when 0 then 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36'
  when 1 then 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1'
  when 2 then 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)'
  when 3 then 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0'
  when 4 then 'Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36'
  when 5 then 'curl/8.4.0' else null end as user_agent
from (select *, case when event_id % 8 = 0 then 4 else user_id end as u from events) e
"""

# Raw lines in every layout, one per log record; `kind` tells what the line was made as.
# 'junk' is unreadable, 'long' has too many fields, 'notime' an impossible time.
_PARTS = """
select event_id, date, time, method, ip, status, bytes, response_time, referer,
 uri, user_agent, coalesce(uri, '-') as u, coalesce(user_agent, '-') as a,
 case event_id % 7 when 0 then 'tsv11' when 1 then 'tsv9' when 2 then 'clf' when 3 then 'space11'
  when 4 then 'junk' when 5 then 'long' else 'notime' end as kind,
 case cast(substr(date, 6, 2) as int) when 1 then 'Jan' when 2 then 'Feb' when 3 then 'Mar' when 4 then 'Apr'
  when 5 then 'May' when 6 then 'Jun' when 7 then 'Jul' when 8 then 'Aug' when 9 then 'Sep' when 10 then 'Oct'
  when 11 then 'Nov' else 'Dec' end as mon
from weblog
"""

LINES = f"""
select p.*, case kind
 when 'tsv11' then concat(date, '{{t}}', time, '{{t}}', ip, '{{t}}', method, '{{t}}', coalesce(uri, ''), '{{t}}', status, '{{t}}', bytes, '{{t}}', response_time, '{{t}}', referer, '{{t}}', coalesce(user_agent, ''), '{{t}}', 'sid=', cast(event_id as string))
 when 'tsv9' then concat(date, ' ', time, case event_id % 3 when 0 then '+02:00' when 1 then 'Z' else '' end, '{{t}}', ip, '{{t}}', method, '{{t}}', coalesce(uri, ''), '{{t}}', status, '{{t}}', bytes, '{{t}}', response_time)
 when 'clf' then concat(ip, ' - - [', substr(date, 9, 2), '/', mon, '/', substr(date, 1, 4), ':', time, ' +0000] "', method, ' ', u, ' HTTP/1.1" ', status, ' ', bytes, ' "', referer, '" "', a, '"')
 when 'space11' then concat(ip, ' - - ', date, 'T', time, ' ', method, ' ', u, ' HTTP/1.1 ', status, ' ', bytes, ' "', referer, '" "', a, '"')
 when 'junk' then concat('### rotated ', cast(event_id as string))
 when 'long' then concat(date, '{{t}}', time, '{{t}}', ip, '{{t}}', method, '{{t}}', u, '{{t}}', status, '{{t}}', bytes, '{{t}}', response_time, '{{t}}', referer, '{{t}}', a, '{{t}}c{{t}}extra')
 else concat('2024-13-45', '{{t}}', time, '{{t}}', ip, '{{t}}', method, '{{t}}', u, '{{t}}', status) end as value
from ({_PARTS}) p
"""
