"""The registered queries again, as SQL text for an independent engine."""

from __future__ import annotations

import hashlib

from clickloom.registry import EVENTS_NOON, EVENTS_NOW, ORDERS_NOW, SALT, SECRET

_DAY_START = EVENTS_NOON - EVENTS_NOON % 86400


def _epoch(x: str) -> str:
    return f"CAST(floor(epoch({x})) AS BIGINT)"


def _country(x: str) -> str:
    return (
        f"CASE {x} % 9 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'BR' WHEN 3 THEN 'IN' WHEN 4 THEN 'NG' "
        f"WHEN 5 THEN 'XX' WHEN 6 THEN 'UNITED STA' WHEN 7 THEN '' ELSE NULL END"
    )


_VIEWS = {
    "v_requests": f"""
SELECT event_id AS id, {_epoch('ts')} AS ts, concat('c', CAST(event_id AS VARCHAR)) AS click_id,
  {_country('user_id')} AS country_code,
  CASE event_id % 8 WHEN 0 THEN 'Mozilla/5.0 (iPhone OS 17_0)' WHEN 1 THEN 'Mozilla/5.0 (Android 14) Mobile'
    WHEN 2 THEN 'Mozilla/5.0 (Windows NT 10.0)' WHEN 3 THEN 'Mozilla/5.0 (iPad OS 17_0)' WHEN 4 THEN 'ExampleBot/1.0'
    WHEN 5 THEN 'wap' WHEN 6 THEN '' ELSE 'Desktop' END AS user_agent,
  CASE WHEN user_id % 11 = 0 THEN 'not-an-ip'
    WHEN user_id % 7 = 0 THEN concat('10.0.', CAST(user_id % 256 AS VARCHAR), '.', CAST(event_id % 256 AS VARCHAR))
    ELSE concat('203.0.', CAST(user_id % 256 AS VARCHAR), '.9') END AS ip,
  concat('lp', CAST(event_id % 5 AS VARCHAR)) AS user_lp, user_id
FROM events""",
    "v_logs": """
SELECT r.id, r.ts, r.ip, r.user_agent AS ua, r.click_id, nullif(r.country_code, '') AS country_code, r.user_lp,
  CASE WHEN e.event_type IN ('purchase', 'signup') THEN 'A' ELSE 'B' END AS decision
FROM v_requests r JOIN events e ON e.event_id = r.id WHERE r.ip <> 'not-an-ip'""",
    "v_received": f"""
SELECT o_orderkey AS id, {_epoch('o_orderdate')} + o_orderkey % 86400 AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
  coalesce({_country('c_nationkey')}, 'XX') AS country_code,
  CASE o_orderkey % 4 WHEN 0 THEN 'WAP' WHEN 1 THEN 'WEB' WHEN 2 THEN 'TABLET' ELSE 'BOT' END AS traffic_type,
  CAST(o_totalprice AS DECIMAL(10,2)) AS payout, concat('c', CAST(o_orderkey % 5000 AS VARCHAR)) AS click_id,
  c_mktsegment AS network
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_sent": f"""
SELECT l_orderkey * 10 + l_linenumber AS id, {_epoch('l_shipdate')} + l_orderkey % 60 AS ts,
  {_country('l_suppkey')} AS country_code, l_returnflag AS traffic_type,
  CAST(l_extendedprice AS DECIMAL(10,2)) AS payout, l_partkey AS part_key,
  concat('host', CAST(l_suppkey % 2 AS VARCHAR)) AS host,
  CASE WHEN l_returnflag = 'N' THEN 200 ELSE 503 END AS response_code, l_returnflag = 'N' AS success
FROM lineitem""",
    "v_rules": f"""
SELECT c_custkey AS id, 'rule ' || c_custkey AS rule_name, lower({_country('c_nationkey')}) AS country_code,
  CASE c_custkey % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' WHEN 2 THEN 'tablet' ELSE 'bot' END AS device_type,
  CASE WHEN c_custkey % 5 <> 0 THEN 'lp' || (c_custkey % 701) END AS user_lp,
  'https://t' || (c_custkey % 9) || '.example.net/' || c_custkey AS redirect_url, c_custkey % 17 AS priority,
  c_custkey % 6 <> 0 AS is_active
FROM customer""",
    "v_fails": f"""
SELECT event_id AS id, {_epoch('ts')} AS attempted_at, concat('203.0.', CAST(user_id % 256 AS VARCHAR), '.9') AS ip
FROM events WHERE event_type = 'error'""",
    "v_rate": f"""
SELECT event_id AS id, concat('ip', CAST(user_id % 3 AS VARCHAR)) AS ip,
  1704067200 + CAST(floor(({_epoch('ts')} - 1704067200) / 2160) AS BIGINT) AS ts
FROM events""",
    "v_reputation": """
SELECT ip, CASE WHEN bool_or(user_id % 5 = 0) THEN 'Y' ELSE 'N' END AS answer
FROM v_requests WHERE ip LIKE '203.%' AND user_id % 5 <> 1 GROUP BY ip""",
    "v_decided": """
SELECT d.*, CASE WHEN decision = 'A'
    THEN CASE CAST(concat('0x', substr(md5(click_id), 1, 8)) AS BIGINT) % 2 WHEN 0 THEN 'https://a.example.com'
      ELSE 'https://b.example.com' END
    ELSE concat('/_meetups/?click_id=', lower(click_id), '&country_code=', lower(routed_country), '&user_agent=',
      lower(device), '&ip_address=', ip, '&user_lp=', user_lp) END AS target
FROM (
  SELECT q.*, CASE WHEN NOT is_muted AND device = 'WAP' AND NOT is_vpn AND routed_country <> 'BR' THEN 'A' ELSE 'B'
    END AS decision
  FROM (
    SELECT r.id, r.ts, r.click_id, r.country_code, r.ip, r.user_lp,
      CASE WHEN r.country_code IN ('US', 'DE', 'BR', 'IN', 'NG', 'XX', '') THEN r.country_code ELSE 'XX' END
        AS routed_country,
      CASE r.id % 8 WHEN 0 THEN 'WAP' WHEN 1 THEN 'WAP' WHEN 2 THEN 'WEB' WHEN 3 THEN 'TABLET' WHEN 4 THEN 'BOT'
        WHEN 5 THEN 'WAP' ELSE 'WEB' END AS device,
      CASE WHEN r.ip NOT LIKE '203.%' THEN false ELSE coalesce(v.answer = 'Y', true) END AS is_vpn,
      (r.ts // 60) % 5 >= 2 AS is_muted
    FROM v_requests r LEFT JOIN v_reputation v ON v.ip = r.ip) q) d""",
    "v_addresses": """
SELECT id, CASE id % 5 WHEN 0 THEN ip WHEN 1 THEN concat('::ffff:', ip) WHEN 2 THEN concat(ip, '.1')
  WHEN 3 THEN concat('2001:db8::', upper(printf('%x', id % 65536))) ELSE concat('0', ip) END AS ip, ip AS plain
FROM v_requests""",
    "v_limits": """
SELECT *, window_start + 60 AS window_end, CASE WHEN attempts > 1 THEN window_start + 60 END AS blocked_until
FROM (SELECT ip, concat('/', user_lp) AS endpoint, ts - ts % 60 AS window_start, count(*) AS attempts
  FROM v_logs GROUP BY 1, 2, 3)""",
}
# Views that read other views; listed after them.
_NEEDS = {
    "v_logs": ["v_requests"],
    "v_reputation": ["v_requests"],
    "v_decided": ["v_requests", "v_reputation"],
    "v_addresses": ["v_requests"],
    "v_limits": ["v_requests", "v_logs"],
}


def _sql(body: str, recursive: bool = False) -> str:
    """The statement with the views it names in front."""
    wanted: list[str] = []
    for name in _VIEWS:
        if name in body or any(name in _NEEDS.get(other, []) for other in _VIEWS if other in body):
            wanted.append(name)
    views = ", ".join(f"{n} AS ({_VIEWS[n]})" for n in wanted)
    start = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.startswith("WITH "):
        return f"{start}{views}, {body[5:]}"
    return f"{start}{views} {body}" if views else body


_KNOWN = "('US', 'DE', 'BR', 'IN', 'NG', 'XX')"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = f"^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$"
_V4 = f"regexp_matches(ip, '{_IPV4}')"
_V6 = f"((id % 5 = 1 AND regexp_matches(plain, '{_IPV4}')) OR id % 5 = 3)"


def _hmac(message: str) -> str:
    """HMAC-SHA256 of a text expression, with the key pads as literals."""
    key = SECRET.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


_STATS = """count(*) AS total_postbacks, CAST(sum(payout) AS DOUBLE) AS total_payout,
  CAST(sum(payout) AS DOUBLE) / count(*) AS avg_payout, CAST(min(payout) AS DOUBLE) AS min_payout,
  CAST(max(payout) AS DOUBLE) AS max_payout, count(DISTINCT traffic_type) AS unique_traffic_types,
  count(DISTINCT country_code) AS unique_countries, count(DISTINCT network) AS unique_networks"""
_WEEK = "CAST(date_trunc('week', make_timestamp((ts - 25200) * 1000000)) AS DATE)"
_DAY = "CAST(make_timestamp(ts * 1000000) AS DATE)"
_LATEST = """latest AS (SELECT * FROM v_received
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts DESC, id DESC) = 1)"""


def _round2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


_RATE_STARTS = """starts AS (
  SELECT ip, min(ts) AS s FROM v_rate GROUP BY ip
  UNION ALL
  SELECT n.ip, n.s FROM (
    SELECT p.ip, min(v.ts) AS s FROM starts p JOIN v_rate v ON v.ip = p.ip AND v.ts > p.s + 60 GROUP BY p.ip) n)"""
_RATE_ROWS = """numbered AS (
  SELECT v.id, v.ip, v.ts, w.s AS window_start,
    row_number() OVER (PARTITION BY v.ip, w.s ORDER BY v.ts, v.id) AS place
  FROM v_rate v ASOF JOIN starts w ON v.ip = w.ip AND v.ts >= w.s)"""

_PATTERNS = {
    "script_tag": r"<script\b", "javascript_url": "javascript:", "event_handler": r"on\w+\s*=",
    "iframe_tag": r"<iframe\b", "object_tag": r"<object\b", "embed_tag": r"<embed\b", "vbscript_url": "vbscript:",
    "data_html_url": "data:text/html",
}


def _scan(source: str, column: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{source}' AS source, '{n}' AS pattern, count(*) FILTER (WHERE regexp_matches({column}, '(?i){p}')) "
        f"AS hits, count(*) FILTER (WHERE NOT regexp_matches({column}, '(?i){p}')) AS clean FROM {source}"
        for n, p in _PATTERNS.items())


_RULE_TESTS = {
    "single_line_agent": "true",
    "file_name_page": "true",
    "valid_ip": "ip <> 'not-an-ip'",
    "public_ip": "ip LIKE '203.%'",
    "country": f"country_code IN {_KNOWN}",
    "alphanumeric_click": "true",
    "slug_page": "true",
    "alpha_page": "false",
    "id_below_5000": "id < 5000",
    "unix_second": "true",
    "date": "month(make_timestamp(ts * 1000000)) >= 10",
    "email": "id % 2 = 0",
    "true_page": "user_lp <> 'lp0'",
}

_TRIM = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11)"
_CONTROL = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]"


def oracle_sql() -> dict[str, str]:
    rules = " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (WHERE coalesce({t}, false)) AS passed, "
        f"count(*) FILTER (WHERE NOT coalesce({t}, false)) AS failed FROM v_requests" for n, t in _RULE_TESTS.items())
    flags = {n: f"regexp_matches(html, '(?i){p}')" for n, p in _PATTERNS.items()}
    has = ", ".join(f"{t} AS has_{n}" for n, t in flags.items())
    any_flag = " OR ".join(flags.values())
    policy = [
        ("postback_security_log", "v_logs", "ts", 30), ("failed_login_attempts", "v_fails", "attempted_at", 30),
        ("rate_limit_tracking", "v_limits", "window_end", 1), ("traffic_logs", "v_logs", "ts", 7),
        ("postback_logs", "v_sent", "ts", 30), ("postback_received", "v_received", "ts", 30),
        ("audit_log", "v_logs", "ts", 90)]
    kept = " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS kept, min({c}) AS oldest FROM {v} WHERE {c} >= {EVENTS_NOON - d * 86400}"
        for n, v, c, d in policy)

    payload = ("concat('click_id=', {c}, '&country=', replace({k}, ' ', '+'), '&payout=', "
               "rtrim(rtrim(CAST(payout AS VARCHAR), '0'), '.'), '&status=', status)")

    texts = {
        "scan_tables": """
SELECT 'logs' AS name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, 7 * count(*) + count(country_code) AS filled
FROM v_logs
UNION ALL SELECT 'postback_received', count(*), min(ts), max(ts), 8 * count(*) FROM v_received
UNION ALL SELECT 'postback_logs', count(*), min(ts), max(ts), 6 * count(*) + count(country_code) FROM v_sent
UNION ALL SELECT 'failed_login_attempts', count(*), min(attempted_at), max(attempted_at), 3 * count(*) FROM v_fails""",
        "ingest_decisions": """
SELECT id, CASE WHEN bad THEN '' ELSE click_id END AS click_id,
  CASE WHEN bad OR country_code IS NULL THEN 'XX' ELSE replace(country_code, ' ', '') END AS country_code,
  CASE WHEN bad THEN '' ELSE user_agent END AS user_agent, CASE WHEN bad THEN '' ELSE ip END AS ip_address,
  CASE WHEN bad THEN '' ELSE user_lp END AS user_lp,
  CASE WHEN bad THEN 'missing_ip' WHEN ip = 'not-an-ip' THEN 'invalid_ip' END AS reject_reason
FROM (SELECT *, id % 10 IN (3, 7) AS bad FROM v_requests)""",
        "ingest_external": """
SELECT id, click_id, replace(coalesce(country_code, ''), ' ', '') AS country_code, user_agent,
  CASE WHEN id % 10 = 4 THEN '203.0.113.7' ELSE ip END AS ip_address, user_lp,
  CASE WHEN id % 10 <> 4 AND ip = 'not-an-ip' THEN 'invalid_ip' END AS reject_reason
FROM v_requests""",
        "ingest_postbacks_secure": f"""
SELECT id, status, CASE WHEN country_code IN {_KNOWN} THEN country_code ELSE 'XX' END AS country_code, traffic_type,
  CAST(payout AS DOUBLE) AS payout, CASE WHEN id % 10 = 3 THEN '' ELSE click_id END AS click_id, network,
  CASE WHEN id % 10 = 7 THEN '8.8.8.8' ELSE concat('203.0.113.', CAST(id % 256 AS VARCHAR)) END AS ip_address,
  concat('id=', CAST(id AS VARCHAR)) AS query_string,
  CASE id % 10 WHEN 7 THEN 'ip_not_allowed' WHEN 5 THEN 'invalid_api_key' WHEN 1 THEN 'invalid_signature'
    WHEN 3 THEN 'missing_click_id' END AS reject_reason
FROM v_received""",
        "ingest_postbacks_flexible": """
SELECT id, status, CASE WHEN id % 10 = 3 THEN '' ELSE country_code END AS country_code,
  CASE WHEN id % 10 = 3 THEN '' ELSE traffic_type END AS traffic_type,
  CAST(CASE id % 10 WHEN 3 THEN 0 WHEN 5 THEN 13 ELSE payout END AS DOUBLE) AS payout,
  CASE WHEN id % 10 <> 3 THEN click_id END AS click_id, network, '198.51.100.4' AS ip_address,
  concat('METHOD=POST | id=', CAST(id AS VARCHAR), CASE WHEN id % 10 = 1 THEN ' | BODY: x=1' ELSE '' END)
    AS query_string,
  CASE WHEN id % 10 = 3 THEN 'no_data' END AS reject_reason
FROM v_received""",
        "ingest_postbacks_tracking": """
SELECT id, st AS status, country_code, traffic_type, p AS payout, nullif(ci, '') AS click_id, network,
  '198.51.100.4' AS ip_address,
  concat(CASE WHEN id % 2 = 0 THEN 'click_id=' ELSE 'cid=' END, ci, '&status=', st, '&payout=',
    CASE WHEN id % 2 = 0 THEN '1.50' WHEN id % 10 = 7 THEN '-1' ELSE CAST(payout AS VARCHAR) END,
    CASE WHEN id % 2 = 0 THEN '&country=' ELSE '&country_code=' END, replace(country_code, ' ', '+'),
    CASE WHEN id % 2 = 0 THEN '&traffic_type=' ELSE '&device=' END, traffic_type, '&network=', network)
    AS query_string,
  CASE WHEN st = '' OR country_code = '' THEN 'missing_fields' WHEN p < 0 OR p > 10000 THEN 'invalid_payout' END
    AS reject_reason
FROM (SELECT *, CASE WHEN id % 10 = 9 THEN '' ELSE click_id END AS ci, CASE WHEN id % 10 = 3 THEN '' ELSE status END AS st,
  CASE WHEN id % 2 = 0 THEN 1.5 WHEN id % 10 = 7 THEN -1 ELSE CAST(payout AS DOUBLE) END AS p FROM v_received)""",
        "parse_query_params": """
SELECT id, click_id AS cid, CASE WHEN id % 2 = 0 THEN concat(status, '!') ELSE 'old' END AS status,
  country_code AS country, CAST(id AS VARCHAR) AS sub_id, '' AS empty, '' AS flag, CAST(6 AS BIGINT) AS n_params
FROM v_received""",
        "scan_service_log": """
SELECT ts, CASE id % 5 WHEN 0 THEN 'received' WHEN 1 THEN 'saved' WHEN 2 THEN 'secure-attempt' WHEN 3 THEN 'db_failure'
    ELSE 'other' END AS kind,
  CASE WHEN id % 5 IN (0, 2) THEN concat('203.0.113.', CAST(id % 256 AS VARCHAR)) END AS ip,
  CASE id % 5 WHEN 1 THEN status WHEN 2 THEN 'FAIL' END AS status,
  CASE WHEN id % 5 = 1 THEN country_code END AS country, CASE WHEN id % 5 = 1 THEN CAST(payout AS DOUBLE) END AS payout,
  CASE id % 5 WHEN 0 THEN concat('Postback received from IP: 203.0.113.', CAST(id % 256 AS VARCHAR))
    WHEN 1 THEN concat('Postback saved: Status=', status, ', Country=', country_code, ', Payout=', CAST(payout AS VARCHAR))
    WHEN 2 THEN concat('[POSTBACK FAIL] Invalid API key | IP: 203.0.113.', CAST(id % 256 AS VARCHAR), ' | Data: {}')
    WHEN 3 THEN 'Database connection failed: refused' ELSE concat('note ', CAST(id AS VARCHAR)) END AS message
FROM v_received""",
        "append_traffic": """
SELECT id, ts, CASE WHEN id % 10 = 6 THEN '' ELSE ip END AS ip, user_agent AS ua, click_id,
  nullif(country_code, '') AS country_code, user_lp, CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END AS decision
FROM v_requests WHERE id % 10 <> 5 AND (id % 10 = 6 OR ip <> 'not-an-ip')""",
        "append_postback_log": f"""
SELECT id, ts, part_key, country_code, traffic_type, CAST(payout AS DOUBLE) AS payout,
  concat('https://track.example.com/?p=', CAST(part_key AS VARCHAR)) AS postback_url, response_code,
  CASE WHEN success THEN 'ok' END AS response_body, success
FROM v_sent WHERE country_code = '' OR country_code IN {_KNOWN}""",
        "append_postbacks": """
SELECT id, ts, status, country_code, traffic_type, CAST(CAST(payout AS DECIMAL(10,2)) * 100 % 100 AS DOUBLE) AS payout,
  click_id, 'unknown' AS network
FROM v_received WHERE country_code <> ''""",
        "apply_postbacks_to_clicks": f"""
WITH {_LATEST}
SELECT l.id, l.click_id, l.ts, l.country_code, p.status AS postback_status,
  CAST(coalesce(p.payout, 0) AS DOUBLE) AS postback_payout, p.ts AS postback_ts
FROM v_logs l LEFT JOIN latest p USING (click_id)""",
        "upsert_by_key": f"""
WITH {_LATEST}, changes AS (SELECT * FROM latest WHERE regexp_matches(click_id, '^c[0-9]*[0-8]$'))
SELECT l.click_id, l.country_code, coalesce(c.status, l.decision) AS value, coalesce(c.ts, l.ts) AS updated_at
FROM v_logs l LEFT JOIN changes c USING (click_id)
UNION ALL
SELECT c.click_id, c.country_code, c.status, c.ts FROM changes c
WHERE NOT EXISTS (SELECT 1 FROM v_logs l WHERE l.click_id = c.click_id)""",
        "delete_by_ids": "SELECT * FROM v_logs WHERE id NOT IN (SELECT event_id FROM events WHERE user_id % 5 = 0)",
        "clear_all": "SELECT count(*) AS removed FROM v_logs",
        "retention": f"SELECT * FROM v_logs WHERE ts >= {EVENTS_NOW - 7 * 86400}",
        "retention_today": f"SELECT * FROM v_logs WHERE ts >= {_DAY_START}",
        "retention_policy": kept,
        "json_export": """
SELECT concat('{"id":', id, ',"ts":', ts, ',"ip":"', ip, '","ua":"', replace(ua, '/', chr(92) || '/'), '","click_id":"',
  click_id, '","country_code":', coalesce('"' || country_code || '"', 'null'), ',"user_lp":"', user_lp,
  '","decision":"', decision, '"}') AS json FROM v_logs""",
        "sanitize_text": f"""
SELECT doc_id, md5(clean) AS clean_md5, length(clean) AS clean_chars, md5(line) AS line_md5 FROM (
  SELECT doc_id, regexp_replace(trim(chr(32) || chr(9) || chr(11) || text || chr(1) || chr(127) || chr(10) || chr(32),
      {_TRIM}), '{_CONTROL}', '', 'g') AS clean,
    regexp_replace(trim(translate(text, chr(13) || chr(10) || chr(9), '   '), {_TRIM}), '{_CONTROL}', '', 'g') AS line
  FROM documents)""",
        "valid_ip": f"""
SELECT id, ip, {_V4} OR {_V6} AS valid, {_V4} AS v4, {_V6} AS v6 FROM v_addresses""",
        "public_ip": f"""
SELECT id, ip, ({_V4} AND ip LIKE '203.%') OR id % 5 = 3 AS is_public FROM v_addresses""",
        "blocked_ip": f"""
SELECT id, ip, NOT (({_V4} AND ip LIKE '203.%') OR id % 5 = 3) AS is_blocked FROM v_addresses""",
        "cidr_match": f"""
SELECT id, ip, CASE WHEN id % 5 = 3 THEN id % 65536 BETWEEN 4096 AND 8191
  ELSE {_V4} AND ((ip LIKE '203.0.%' AND TRY_CAST(split_part(ip, '.', 3) AS INT) < 32)
    OR (ip LIKE '10.0.%' AND TRY_CAST(split_part(ip, '.', 3) AS INT) BETWEEN 64 AND 127) OR ip = '203.0.100.9') END AS listed
FROM v_addresses""",
        "cidr_match_table": f"""
SELECT id, ip FROM v_addresses WHERE {_V4} AND ip IN (
  SELECT ip FROM v_requests WHERE ip LIKE '203.%' AND user_id % 10 < 3)""",
        "client_ip": """
SELECT id,
  coalesce(CASE WHEN id % 250 < 128 THEN coalesce(cf, real, fw_any) END, remote) AS detector,
  coalesce(cf, real, fw_public, remote) AS client, coalesce(cf, real, fw_first, remote) AS secure
FROM (
  SELECT id, CASE WHEN id % 7 = 0 AND ip <> 'not-an-ip' THEN ip END AS cf,
    CASE WHEN id % 4 = 0 THEN concat('192.168.0.', CAST(id % 200 AS VARCHAR)) END AS real,
    CASE WHEN id % 3 = 0 AND ip LIKE '203.%' THEN ip END AS fw_public,
    CASE WHEN id % 3 = 0 THEN concat('192.168.0.', CAST(id % 200 AS VARCHAR)) END AS fw_first,
    CASE WHEN id % 3 = 0 THEN CASE WHEN ip LIKE '203.%' THEN ip ELSE concat('192.168.0.', CAST(id % 200 AS VARCHAR)) END
      END AS fw_any,
    concat('198.51.100.', CAST(id % 250 AS VARCHAR)) AS remote
  FROM v_requests)""",
        "resolve_country": f"""
SELECT id, CASE WHEN country_code IN {_KNOWN} THEN country_code ELSE 'XX' END AS country FROM v_requests""",
        "valid_country": f"SELECT id, coalesce(country_code IN {_KNOWN}, false) AS valid FROM v_requests",
        "normalize_country": f"""
SELECT id, CASE WHEN country_code IN {_KNOWN} THEN country_code ELSE 'XX' END AS country FROM v_received""",
        "country_filter": """
SELECT id, coalesce(country_code IN ('US', 'DE'), false) AS white, false AS white_empty,
  coalesce(country_code <> 'BR', true) AS black, true AS black_empty, true AS all_mode FROM v_requests""",
        "country_filter_table": """
WITH l AS (SELECT DISTINCT upper(country_code) AS c FROM v_rules WHERE id % 3 = 0 AND country_code > 'd'),
r AS (SELECT id, upper(country_code) AS c FROM v_requests)
SELECT 'white' AS list, id FROM r WHERE c IN (SELECT c FROM l)
UNION ALL SELECT 'black', id FROM r WHERE c IS NULL OR c NOT IN (SELECT c FROM l)
UNION ALL SELECT 'black_empty', id FROM r""",
        "detect_device": """
SELECT id, CASE WHEN ua = '' OR ua IN ('web', 'desktop') THEN 'WEB' WHEN ua IN ('wap', 'mobile') THEN 'WAP'
  WHEN ua = 'tablet' THEN 'TABLET' WHEN regexp_matches(ua, 'bot|crawl|spider|facebook|whatsapp|telegram') THEN 'BOT'
  WHEN regexp_matches(ua, 'tablet|ipad') THEN 'TABLET'
  WHEN regexp_matches(ua, 'mobile|android|iphone|ipod|blackberry|iemobile|opera mini|windows phone') THEN 'WAP'
  ELSE 'WEB' END AS device FROM (SELECT id, lower(user_agent) AS ua FROM v_requests)""",
        "detect_device_client": """
SELECT id, device, CASE WHEN id % 6 = 0 THEN 'wap' ELSE device END AS with_override FROM (
  SELECT id, CASE WHEN regexp_matches(ua, 'bot|crawl|spider|facebook|whatsapp|telegram') THEN 'bot'
    WHEN regexp_matches(ua, 'tablet|ipad|mobile|android|iphone|ipod|blackberry|iemobile|opera mini|windows phone')
    THEN 'wap' ELSE 'web' END AS device FROM (SELECT id, lower(user_agent) AS ua FROM v_requests))""",
        "url_check": """
SELECT page_id, regexp_matches(url, '^https?://[a-z0-9.-]+([/?#][!-~]*)?$') AS valid,
  regexp_matches(url, '^https://[a-z0-9.-]+([/?#][!-~]*)?$') AS valid_https, false AS broken FROM pages""",
        "redirect_url_check": """
SELECT page_id, host, CASE WHEN url NOT LIKE 'https:%' THEN 'not_https'
  WHEN length(host) % 3 = 0 OR host LIKE 'm.%' THEN 'blocked_address' END AS reject_reason
FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages)""",
        "injection_scan": f"{_scan('pages', 'html')} UNION ALL {_scan('documents', 'text')}",
        "injection_scan_rows": f"SELECT page_id, {has}, {any_flag} AS suspicious FROM pages",
        "schema_check": "SELECT event_id, event_id % 4 = 0 AS schema_ok FROM events",
        "quality_report": rules,
        "repair_values": """
SELECT page_id, substring(trim(replace(translate(' ../' || url || '?a=<b>|"c"*..', '/\\<>:"|?*', ''), '..', '')), 1, 255) AS file_name,
  CASE WHEN page_id % 3 <> 0 THEN 'webmaster' || page_id || '@' || regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) END AS email,
  CASE WHEN page_id % 4 = 0 AND page_id <= 5000 THEN page_id ELSE -1 END AS whole,
  CASE WHEN page_id % 3 = 0 AND page_id + 0.25 <= 100000 THEN page_id + CAST(0.25 AS DOUBLE)
    WHEN page_id % 3 = 2 AND page_id * 100 <= 100000 THEN CAST(page_id * 100 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS real
FROM pages""",
        "quality_quarantine": f"""
SELECT id, concat_ws(',', CASE WHEN ip = 'not-an-ip' THEN 'valid_ip' END,
  CASE WHEN NOT coalesce(country_code IN {_KNOWN}, false) THEN 'country' END) AS failed_rules
FROM v_requests WHERE ip = 'not-an-ip' OR NOT coalesce(country_code IN {_KNOWN}, false)""",
        "duplicate_keys": "SELECT click_id, count(*) AS n FROM v_received GROUP BY click_id HAVING count(*) > 1",
        "hash_ip": f"SELECT id, substr(sha256(concat(ip, '{SALT}')), 1, 16) AS ip_hash FROM v_requests",
        "fingerprint": """
SELECT id, md5(concat(ip, '|', user_agent)) AS request,
  sha256(concat(user_agent, '|', coalesce(country_code, ''), '|', user_lp)) AS session FROM v_requests""",
        "verify_signature": f"""
SELECT id, {_hmac(payload.format(c='click_id', k='country_code'))} AS signature, id % 3 <> 0 AS ok FROM v_received""",
        "render_postback_url": f"""
SELECT id, ts, part_key, CAST(payout AS DOUBLE) AS payout, CASE WHEN id % 10 <> 0 AND country_code IN {_KNOWN} THEN
  concat('https://track.example.com/pb?c=', country_code, '&t=', traffic_type, '+x&p=', CAST(payout AS VARCHAR))
  END AS url FROM v_sent""",
        "fallback_url": """
SELECT id, concat('/_meetups/?click_id=', click_id, '&country_code=', url_encode(lower(coalesce(country_code, 'XX'))),
  '&user_agent=', url_encode(lower(user_agent)), '&ip_address=', url_encode(concat(ip, '*~')), '&user_lp=', user_lp)
  AS url FROM v_requests""",
        "parse_url_list": """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat(url, ' https://b.example.com') ELSE '' END AS urls
FROM pages""",
        "success_flag": """
SELECT host, CAST(response_code AS BIGINT) AS response_code,
  count(*) FILTER (WHERE part_key % 10 <> 0 AND response_code = 200) AS ok,
  count(*) FILTER (WHERE NOT (part_key % 10 <> 0 AND response_code = 200)) AS failed
FROM v_sent GROUP BY host, response_code""",
        "mute_window": "SELECT id, (ts // 60) % 5 >= 2 AS muted, false AS muted_off FROM v_requests",
        "vpn_flag": """
SELECT r.id, r.ip, CASE WHEN r.ip NOT LIKE '203.%' THEN false ELSE coalesce(v.answer = 'Y', true) END AS is_vpn
FROM v_requests r LEFT JOIN v_reputation v ON v.ip = r.ip""",
        "decide": """
SELECT id, ts, click_id, country_code, routed_country, device, is_vpn, is_muted, decision, target FROM v_decided""",
        "decide_whitelist": """
SELECT id, CASE WHEN a THEN 'A' ELSE 'B' END AS decision,
  CASE WHEN a THEN 'https://c.example.com' ELSE concat('/_meetups/?click_id=', click_id, '&country_code=',
    lower(routed_country), '&user_agent=', lower(device), '&ip_address=', ip, '&user_lp=', user_lp) END AS target
FROM (SELECT *, NOT is_muted AND device = 'WAP' AND NOT is_vpn AND routed_country IN ('US', 'XX', '') AS a
  FROM v_decided)""",
        "decision_counters": f"""
SELECT CAST({_DAY} AS VARCHAR) AS day, count(*) FILTER (WHERE decision = 'A') AS total_decision_a,
  count(*) FILTER (WHERE decision = 'B' AND NOT is_muted) AS total_decision_b FROM v_decided GROUP BY 1""",
        "outgoing_postbacks": """
SELECT id, ts, routed_country AS country_code, device AS traffic_type, CAST(1.5 AS DOUBLE) AS payout,
  concat('https://track.example.com/pb?c=', routed_country, '&t=', device, '&p=1.50') AS postback_url
FROM v_decided WHERE decision = 'A' AND routed_country <> ''""",
        "forward_postbacks": """
SELECT id, ts, country_code, traffic_type, CAST(payout AS DOUBLE) AS payout,
  concat('https://forward.example.net/r?c=', click_id, '&s=', status, '&p=',
    regexp_replace(CAST(payout AS VARCHAR), '\\.?0+$', ''), '&g=', country_code, '&d=', traffic_type) AS postback_url
FROM v_received WHERE country_code IN ('US', 'DE', 'BR', 'IN', 'NG', 'XX')""",
        "match_rules": """
WITH rules AS (SELECT id AS rule_id, rule_name, upper(country_code) AS place, device_type AS kind, user_lp AS page,
    redirect_url, priority FROM v_rules WHERE is_active),
clicks AS (SELECT id, country_code, CASE id % 8 WHEN 2 THEN 'desktop' WHEN 3 THEN 'tablet' WHEN 4 THEN 'bot'
  WHEN 6 THEN 'desktop' WHEN 7 THEN 'desktop' ELSE 'mobile' END AS device_type, 'lp' || (id % 1009) AS user_lp FROM v_requests)
SELECT c.id, c.country_code, c.device_type, c.user_lp, CAST(r.rule_id AS BIGINT) AS rule_id, r.rule_name, r.redirect_url
FROM clicks c LEFT JOIN rules r ON r.kind = c.device_type AND r.place IN (coalesce(c.country_code, 'XX'), 'XX')
  AND (r.page IS NULL OR r.page = c.user_lp)
QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY r.place = coalesce(c.country_code, 'XX') DESC NULLS LAST, r.priority DESC NULLS LAST,
  r.rule_id) = 1""",
        "daily_payout_stats": f"""
SELECT CAST({_DAY} AS VARCHAR) AS date, {_STATS} FROM v_received WHERE ts >= {ORDERS_NOW - 30 * 86400}
GROUP BY 1 ORDER BY 1 DESC""",
        "weekly_payout_stats": f"""
SELECT CAST({_WEEK} AS VARCHAR) AS date, CAST({_WEEK} + 6 AS VARCHAR) AS week_end, {_STATS}
FROM v_received WHERE ts >= {ORDERS_NOW - 365 * 86400} GROUP BY ALL ORDER BY 1 DESC""",
        "payout_summary": f"""
SELECT CAST(sum(n) AS BIGINT) AS total_postbacks, {_round2('sum(p)')} AS total_payout,
  {_round2('sum(p) / count(*)')} AS avg_daily_payout, count(*) AS days_count
FROM (SELECT {_DAY} AS d, count(*) AS n, CAST(sum(payout) AS DOUBLE) AS p FROM v_received
  WHERE ts >= {ORDERS_NOW - 365 * 86400} GROUP BY 1 ORDER BY 1 DESC)""",
        "postback_delivery_stats": f"""
SELECT count(*) AS total, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed,
  {_round2('count(*) FILTER (WHERE success) / count(*) * 100')} AS success_rate,
  CAST(sum(payout) AS DOUBLE) AS total_payout FROM v_sent""",
        "traffic_stats": f"""
SELECT count(*) AS total, ({EVENTS_NOW} - min(ts)) // 86400 AS oldest_days,
  ({EVENTS_NOW} - max(ts)) // 86400 AS newest_days, count(*) * 500 AS size_estimate FROM v_logs""",
        "count_by_decision": f"""
SELECT d.decision, count(l.id) AS n FROM (VALUES ('A'), ('B')) d(decision)
LEFT JOIN v_logs l ON l.decision = d.decision AND l.ts >= {_DAY_START} GROUP BY 1""",
        "count_today": f"SELECT count(*) AS n FROM v_logs WHERE ts >= {_DAY_START}",
        "country_stats": """
SELECT coalesce(country_code, 'XX') AS country, count(*) AS total, count(*) FILTER (WHERE decision = 'A') AS decision_a,
  count(*) FILTER (WHERE decision <> 'A') AS decision_b FROM v_logs GROUP BY 1""",
        "top_countries": """
SELECT country, total, decision_a, decision_b, decision_a / total * 100 AS share_a, decision_b / total * 100 AS share_b
FROM (SELECT coalesce(country_code, 'XX') AS country, count(*) AS total,
  count(*) FILTER (WHERE decision = 'A') AS decision_a, count(*) FILTER (WHERE decision <> 'A') AS decision_b
  FROM v_logs GROUP BY 1) ORDER BY total DESC, country LIMIT 5""",
        "decision_totals": """
SELECT a AS total_a, b AS total_b, a + b AS total, CAST(floor(a / (a + b) * 100 + 0.5) AS BIGINT) AS percent_a,
  CAST(floor(b / (a + b) * 100 + 0.5) AS BIGINT) AS percent_b
FROM (SELECT count(*) FILTER (WHERE decision = 'A') AS a, count(*) FILTER (WHERE decision = 'B') AS b FROM v_logs)""",
        "decision_rates": f"""
SELECT {_round2("count(*) FILTER (WHERE decision = 'A') / count(*) * 100")} AS rate_a,
  {_round2("count(*) FILTER (WHERE decision = 'B') / count(*) * 100")} AS rate_b,
  count(DISTINCT country_code) AS active_countries FROM v_logs""",
        "unique_countries": "SELECT DISTINCT country_code FROM v_logs WHERE country_code IS NOT NULL",
        "unique_sketches": f"""
WITH d AS (SELECT DISTINCT CAST({_DAY} AS DATE) AS day, country_code, ip FROM v_logs),
e AS (SELECT CAST(day + CAST(k AS INTEGER) AS DATE) AS day, country_code, ip FROM d, range(0, 7) t(k))
SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT country_code) AS countries, true AS close FROM e GROUP BY 1""",
        "estimated_revenue": """
SELECT CAST(count(*) FILTER (WHERE decision = 'A') * 1.5 AS DOUBLE) AS revenue FROM v_logs""",
        "security_summary": f"""
SELECT 'postback_attempts' AS metric_type, count(*) AS total_count,
  CAST(sum(CASE WHEN decision = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS success_count,
  CAST(sum(CASE WHEN decision = 'A' THEN 0 ELSE 1 END) AS BIGINT) AS failure_count,
  count(DISTINCT ip) AS unique_ips, max(ts) AS last_activity FROM v_logs WHERE ts > {EVENTS_NOON - 86400}
UNION ALL
SELECT 'failed_logins', count(*), 0, count(*), count(DISTINCT ip), max(attempted_at) FROM v_fails
WHERE attempted_at > {EVENTS_NOON - 86400}
UNION ALL
SELECT 'rate_limits', count(*), CAST(sum(CASE WHEN blocked_until IS NULL THEN 1 ELSE 0 END) AS BIGINT),
  CAST(sum(CASE WHEN blocked_until IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT), count(DISTINCT ip), max(window_start)
FROM v_limits WHERE window_end > {EVENTS_NOON - 3600}""",
        "dashboard": f"""
SELECT 'log' AS section, CAST(id AS VARCHAR) AS name, concat('{{"id":', id, ',"ts":', ts, ',"ip":"', ip, '","ua":"', ua,
  '","click_id":"', click_id, '","country_code":', coalesce('"' || country_code || '"', 'null'), ',"user_lp":"',
  user_lp, '","decision":"', decision, '"}}') AS value
FROM (SELECT * FROM v_logs WHERE ts >= {_DAY_START} ORDER BY id DESC LIMIT 20)
UNION ALL SELECT 'stat', 'total', CAST(count(*) AS VARCHAR) FROM v_logs
UNION ALL SELECT 'stat', 'oldest_days', CAST(({EVENTS_NOON} - min(ts)) // 86400 AS VARCHAR) FROM v_logs
UNION ALL SELECT 'stat', 'newest_days', CAST(CAST(trunc(({EVENTS_NOON} - max(ts)) / 86400) AS BIGINT) AS VARCHAR)
  FROM v_logs
UNION ALL SELECT 'stat', 'size_estimate', CAST(count(*) * 500 AS VARCHAR) FROM v_logs
UNION ALL SELECT 'decision', d.decision, CAST(count(l.id) AS VARCHAR) FROM (VALUES ('A'), ('B')) d(decision)
  LEFT JOIN v_logs l ON l.decision = d.decision AND l.ts >= {_DAY_START} GROUP BY d.decision""",
        "recent_traffic": f"SELECT * FROM v_logs WHERE ts >= {_DAY_START} ORDER BY id DESC LIMIT 30 OFFSET 10",
        "page_info": f"""
SELECT CAST(500 AS BIGINT) AS "limit", CAST(0 AS BIGINT) AS "offset", count(*) AS total, 500 < count(*) AS has_more
FROM v_logs WHERE ts >= {_DAY_START}""",
        "recent_postbacks": """
SELECT id, ts, country_code, traffic_type, CAST(payout AS DOUBLE) AS payout,
  CAST(response_code AS BIGINT) AS response_code, success
FROM (SELECT * FROM v_sent ORDER BY ts DESC, id DESC, payout DESC, part_key DESC LIMIT 100)""",
        "recent_received": """
SELECT id, ts, status, country_code, traffic_type, CAST(payout AS DOUBLE) AS payout, click_id, network
FROM v_received ORDER BY ts DESC, id DESC LIMIT 200""",
        "postbacks_by_status": """
SELECT id, ts, CAST(payout AS DOUBLE) AS payout, part_key, success
FROM (SELECT * FROM v_sent WHERE NOT success ORDER BY ts DESC, id DESC, payout DESC, part_key DESC LIMIT 50)""",
        "traffic_by_country": "SELECT * FROM v_logs WHERE country_code = 'DE' ORDER BY id DESC LIMIT 200",
        "traffic_by_decision": "SELECT * FROM v_logs WHERE decision = 'A' ORDER BY id DESC LIMIT 100",
        "search_traffic": """
SELECT * FROM v_logs WHERE contains(lower(click_id), 'c12') OR contains(lower(coalesce(country_code, '')), 'c12')
  OR contains(lower(ip), 'c12') OR contains(lower(user_lp), 'c12')""",
        "filter_traffic": """
SELECT * FROM v_logs WHERE country_code = 'US' AND ts >= 1704412800 AND ts < 1704844800""",
        "conversions_by_country": f"""
WITH {_LATEST}, good AS (SELECT click_id, payout FROM latest WHERE status = 'confirmed')
SELECT country, count(*) AS clicks, count(payout) AS converted, coalesce(CAST(sum(payout) AS DOUBLE), 0) AS payout,
  {_round2('count(payout) / count(*) * 100')} AS rate
FROM (SELECT click_id, coalesce(country_code, 'XX') AS country FROM v_logs
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, id) = 1) LEFT JOIN good USING (click_id)
GROUP BY country""",
        "resolve_user": """
SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN user_id END AS user_id, event_type AS action,
  CASE WHEN user_id % 2 = 0 THEN concat('user', CAST(user_id AS VARCHAR)) END AS username FROM events""",
        "failure_streaks": """
WITH marked AS (SELECT host, ts, id, payout, part_key, success,
    CASE WHEN NOT success AND NOT coalesce(lag(success) OVER w, true) AND ts - lag(ts) OVER w <= 60 THEN 0 ELSE 1 END
      AS fresh
  FROM v_sent WINDOW w AS (PARTITION BY host ORDER BY ts, id, payout, part_key)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY ts, id, payout, part_key
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marked)
SELECT host, min(ts) AS started, max(ts) AS ended, count(*) AS failures FROM runs WHERE NOT success
GROUP BY host, run HAVING count(*) >= 5""",
        "rate_windows": """
SELECT *, window_start + 60 AS window_end, CASE WHEN attempts > 120 THEN window_start + 60 END AS blocked_until
FROM (SELECT ip, '/decision' AS endpoint, ts - ts % 60 AS window_start, count(*) AS attempts FROM v_rate GROUP BY 1, 2, 3)""",
    }
    texts = {name: _sql(body) for name, body in texts.items()}
    texts["rate_limit_violations"] = _sql(
        f"WITH {_RATE_STARTS}, {_RATE_ROWS} SELECT id, ip, ts, window_start FROM numbered WHERE place > 120", True)
    texts["rate_limit_usage"] = _sql(f"""
WITH {_RATE_STARTS}, {_RATE_ROWS} SELECT ip, window_start, count(*) AS requests, least(count(*), 120) AS passed,
  count(*) - least(count(*), 120) AS denied FROM numbered GROUP BY ip, window_start""", True)
    texts["rate_limit_stream"] = _sql(
        f"WITH {_RATE_STARTS}, {_RATE_ROWS} SELECT id, ip, ts, place <= 120 AS allowed FROM numbered", True)
    texts["rate_windows_stream"] = _sql("""
SELECT *, window_start + 60 AS window_end, CASE WHEN attempts > 120 THEN window_start + 60 END AS blocked_until
FROM (SELECT ip, '/decision' AS endpoint, ts - ts % 60 AS window_start, count(*) AS attempts FROM v_rate GROUP BY 1, 2, 3)""")
    texts["decide_stream"] = texts["decide"]
    texts["payout_stats_stream"] = _sql(f"""
SELECT CAST({_WEEK} AS VARCHAR) AS date, CAST({_WEEK} + 6 AS VARCHAR) AS week_end, {_STATS}
FROM v_received GROUP BY ALL""")
    texts["latest_postback_stream"] = _sql(
        f"WITH {_LATEST} SELECT click_id, status, CAST(payout AS DOUBLE) AS payout, ts, id FROM latest")
    return texts
