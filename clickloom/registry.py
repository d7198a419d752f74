"""Registered queries: every operator over whole benchmark tables, with plain column types for comparison."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import device as dev
from clickloom.functions import geo, net, numbers, secure, text, web
from clickloom.operators import attribution, browse, quality, routing, security, stats, tables
from clickloom.sources import derived, params, postbacks, requests, service_log
from clickloom.plans.workspace import staged, work_folder
from clickloom.schemas import schema_of
from clickloom.sources.derived import read
from clickloom.sources.tables import load
from clickloom.streaming import jobs, limits, sinks, stores

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values: "now" for the event tables, the order tables and the shipment tables.
EVENTS_NOW = 1706659200
EVENTS_NOON = 1706616000
ORDERS_NOW = 996710400

SETTINGS = routing.Settings(
    system_on=True,
    redirect_urls=("https://a.example.com/", "https://b.example.com"),
    country_filter_mode="blacklist",
    country_filter_list=("BR",),
    postback_url="https://track.example.com/pb?c={country}&t={traffic_type}&p={payout}",
    default_payout=Decimal("1.50"),
)
SECRET = "not-a-real-secret"
SALT = "pepper"
API_KEY = "not-a-real-key"
FORWARD = "https://forward.example.net/r?c={click_id}&s={status}&p={payout}&g={country}&d={device}"
_SENT_TIES = ("id", "payout", "part_key")

_QUERIES: dict[str, Query] = {}


def _register(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _texts(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def _pick(index: Column, *choices) -> Column:
    """The choice at an index, counted from 0."""
    out = F.when(index == 0, choices[0])
    for i, c in enumerate(choices[1:], start=1):
        out = out.when(index == i, c)
    return out


def _params(*pairs: Column) -> Column:
    """Alternating names and values as a map, as a request reader would deliver it."""
    return F.map_from_arrays(F.array(*pairs[::2]), F.array(*pairs[1::2]))


def _reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.requests_from(read(spark, sf_dir, "events")).where("ip like '203.%' and user_id % 5 <> 1")
    answer = F.when(F.bool_or(F.col("user_id") % 5 == 0), "Y").otherwise("N")
    return rows.groupBy("ip").agg(answer.alias("answer"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.decide(derived.requests(spark, sf_dir), SETTINGS, _reputation(spark, sf_dir))


def _store(df: DataFrame, name: str, ts: str = "ts", dated: bool = True) -> str:
    """New folder of stored tables, with one of this name that holds the rows."""
    folder = work_folder(df.sparkSession, "stored")
    tables.append_dated(df, f"{folder}/{name}", ts, batch_id="first", dated=dated)
    return folder


def _after(df: DataFrame, name: str, split, ts: str = "ts", dated: bool = True) -> DataFrame:
    """The rows of a stored table, read back with its declared schema after a split of it was applied in place."""
    folder = _store(df, name, ts, dated)
    tables.apply_split(split(load(df.sparkSession, folder, name)), f"{folder}/{name}")
    return load(df.sparkSession, folder, name).select(*[c for c in df.columns if c in schema_of(name)])


# --- sources -------------------------------------------------------------------------------------------------------


@_register
def scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table stored once and read with its declared schema; ``filled`` counts values of all declared columns."""
    found = {
        "logs": (derived.logs(spark, sf_dir), "ts", True),
        "postback_received": (derived.received(spark, sf_dir), "ts", False),
        "postback_logs": (derived.sent(spark, sf_dir), "ts", False),
        "failed_login_attempts": (derived.failed_logins(spark, sf_dir), "attempted_at", True),
    }
    out = None
    for name, (df, ts, dated) in found.items():
        stored = load(spark, _store(df, name, ts, dated), name)
        filled = sum((F.count(c) for c in schema_of(name)), F.lit(0).cast("bigint"))
        line = stored.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                          filled.alias("filled"))
        line = line.select(F.lit(name).alias("name"), "*")
        out = line if out is None else out.unionByName(line)
    return out


@_register
def ingest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.requests(spark, sf_dir)
    packed = F.to_json(F.struct("click_id", "country_code", "user_agent", F.col("ip").alias("ip_address"), "user_lp"))
    body = F.when(F.col("id") % 10 == 3, F.substring(packed, 1, 40)).when(F.col("id") % 10 == 7, "a=b").otherwise(packed)
    out = requests.ingest_decisions(r.select("id", body.alias("body")))
    return out.drop("body")


@_register
def ingest_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.requests(spark, sf_dir)
    i = F.col("id") % 3
    given = _params(
        _pick(i, F.lit("click_id"), F.lit("cid"), F.lit("click_id")), F.col("click_id"),
        _pick(i, F.lit("country_code"), F.lit("country"), F.lit("cc")), F.col("country_code"),
        _pick(i, F.lit("user_agent"), F.lit("device"), F.lit("ua")), F.col("user_agent"),
        _pick(i, F.lit("ip_address"), F.lit("ip"), F.lit("ip")), F.when(F.col("id") % 10 == 4, "").otherwise(F.col("ip")),
        _pick(i, F.lit("user_lp"), F.lit("lp"), F.lit("campaign")), F.col("user_lp"),
    )
    out = requests.ingest_external(
        r.select("id", given.alias("params"), F.lit("203.0.113.7").alias("own")), client_address="own")
    return out.drop("params", "own")


def _postback_text(c: str) -> Column:
    return F.col(c).cast("string")


def _stored(df: DataFrame) -> DataFrame:
    return _doubles(df.select("id", *postbacks.STORED_COLUMNS, "reject_reason"), "payout")


@_register
def ingest_postbacks_secure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.received(spark, sf_dir)
    i, d = F.col("id") % 4, F.col("id") % 10
    click_id = F.when(d == 3, "").otherwise(F.col("click_id"))
    payload = secure.signature_payload(
        click_id, F.when(F.col("country_code") == "", "XX").otherwise(F.col("country_code")),
        F.col("payout").cast("double"), F.col("status"))
    signature = F.when(d == 1, "0" * 64).otherwise(secure.hmac_sha256(payload, SECRET))
    given = _params(
        _pick(i, F.lit("click_id"), F.lit("clickid"), F.lit("cid"), F.lit("s2")), click_id,
        _pick(i, F.lit("status"), F.lit("conversion_status"), F.lit("action"), F.lit("status")), F.col("status"),
        _pick(i, F.lit("payout"), F.lit("amount"), F.lit("revenue"), F.lit("commission")), _postback_text("payout"),
        _pick(i, F.lit("country"), F.lit("country_code"), F.lit("geo"), F.lit("country")), F.col("country_code"),
        _pick(i, F.lit("device"), F.lit("device_type"), F.lit("traffic_type"), F.lit("device")), F.col("traffic_type"),
        _pick(i, F.lit("network"), F.lit("source"), F.lit("partner"), F.lit("network")), F.col("network"),
        F.lit("signature"), signature,
    )
    ip = F.when(d == 7, "8.8.8.8").otherwise(F.concat(F.lit("203.0.113."), (F.col("id") % 256).cast("string")))
    rows = p.select(
        "id", given.alias("params"), ip.alias("client_ip"), F.when(d == 5, "wrong").otherwise(API_KEY).alias("api_key"),
        F.concat(F.lit("id="), F.col("id").cast("string")).alias("query_string"))
    config = postbacks.ReceiverConfig(api_key=API_KEY, hmac_secret=SECRET)
    return _stored(postbacks.ingest_postbacks(rows, "secure", config))


@_register
def ingest_postbacks_flexible(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.received(spark, sf_dir)
    i, d = F.col("id") % 4, F.col("id") % 10
    none = d == 3
    payout = F.when(none, F.lit(None)).when(d == 5, "1e3").when(d == 7, F.concat(F.lit("-"), _postback_text("payout")))
    payout = payout.otherwise(_postback_text("payout"))
    given = _params(
        _pick(i, F.lit("click_id"), F.lit("cid"), F.lit("transaction_id"), F.lit("txid")), F.when(~none, F.col("click_id")),
        _pick(i, F.lit("status"), F.lit("s"), F.lit("state"), F.lit("st")), F.col("status"),
        _pick(i, F.lit("payout"), F.lit("p"), F.lit("rev"), F.lit("a")), payout,
        _pick(i, F.lit("country"), F.lit("c"), F.lit("geo"), F.lit("cc")), F.when(~none, F.col("country_code")),
        _pick(i, F.lit("device"), F.lit("d"), F.lit("type"), F.lit("dt")), F.when(~none, F.lower("traffic_type")),
        _pick(i, F.lit("network"), F.lit("source"), F.lit("src"), F.lit("net")), F.col("network"),
    )
    rows = p.select(
        "id", given.alias("params"), F.lit("198.51.100.4").alias("client_ip"), F.lit("POST").alias("method"),
        F.concat(F.lit("id="), F.col("id").cast("string")).alias("query_string"),
        F.when(d == 1, "x=1").otherwise("").alias("body"))
    return _stored(postbacks.ingest_postbacks(rows, "flexible"))


@_register
def ingest_postbacks_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.received(spark, sf_dir)
    i, d = F.col("id") % 2, F.col("id") % 10
    given = _params(
        _pick(i, F.lit("click_id"), F.lit("cid")), F.when(d == 9, "").otherwise(F.col("click_id")),
        F.lit("status"), F.when(d == 3, "").otherwise(F.col("status")),
        F.lit("payout"), F.when(i == 0, "1.50").when(d == 7, "-1").otherwise(_postback_text("payout")),
        _pick(i, F.lit("country"), F.lit("country_code")), F.col("country_code"),
        _pick(i, F.lit("traffic_type"), F.lit("device")), F.col("traffic_type"),
        F.lit("network"), F.col("network"),
    )
    rows = p.select("id", given.alias("params"), F.lit("198.51.100.4").alias("client_ip"))
    return _stored(postbacks.ingest_postbacks(rows, "tracking"))


@_register
def parse_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.received(spark, sf_dir)
    get = F.concat(F.lit("cid="), F.col("click_id"), F.lit("&status=old&country="), web.form_encode(F.col("country_code")),
                   F.lit("&sub.id="), F.col("id").cast("string"), F.lit("&empty=&flag"))
    post = F.when(F.col("id") % 2 == 0, F.concat(F.lit("status="), F.col("status"), F.lit("&status="), F.col("status"),
                                                  F.lit("%21")))
    m = F.col("m")
    return p.select("id", params.query_params(get, post).alias("m")).select(
        "id", m["cid"].alias("cid"), m["status"].alias("status"), m["country"].alias("country"),
        m["sub_id"].alias("sub_id"), m["empty"].alias("empty"), m["flag"].alias("flag"),
        F.size(m).cast("bigint").alias("n_params"))


@_register
def scan_service_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.received(spark, sf_dir)
    stamp = F.date_format(F.timestamp_seconds("ts"), "dd-MMM-yyyy HH:mm:ss")
    message = _pick(
        F.col("id") % 5,
        F.concat(F.lit("Postback received from IP: 203.0.113."), (F.col("id") % 256).cast("string")),
        F.concat(F.lit("Postback saved: Status="), F.col("status"), F.lit(", Country="), F.col("country_code"),
                 F.lit(", Payout="), F.col("payout").cast("string")),
        F.concat(F.lit("[POSTBACK FAIL] Invalid API key | IP: 203.0.113."), (F.col("id") % 256).cast("string"),
                 F.lit(" | Data: {}")),
        F.lit("Database connection failed: refused"),
        F.concat(F.lit("note "), F.col("id").cast("string")))
    lines = p.select(F.concat(F.lit("["), stamp, F.lit(" UTC] "), message).alias("value"))
    path = f"{work_folder(spark, 'service-log')}/log"
    lines.write.text(path)
    return service_log.scan_service_log(spark, path)


# --- sinks and table changes ---------------------------------------------------------------------------------------


def _appended(append, rows: DataFrame, like: DataFrame, dated: bool = True) -> DataFrame:
    """The stored rows after an append.

    The order tables have few rows on each of some thousand dates, so they are stored undated.
    """
    path = f"{work_folder(rows.sparkSession, 'appended')}/table"
    append(rows, path, batch_id="first", dated=dated)
    return rows.sparkSession.read.schema(f"{_ddl(like)}, dt date, batch_id string").parquet(path).select(*like.columns)


@_register
def append_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.requests(spark, sf_dir)
    rows = r.select(
        "id", "ts", F.when(F.col("id") % 10 == 6, "").otherwise(F.col("ip")).alias("ip"),
        F.concat(F.lit("  "), F.col("user_agent"), F.lit("\t")).alias("ua"), "click_id", "country_code", "user_lp",
        F.when(F.col("id") % 10 == 5, "C").when(F.col("id") % 2 == 0, "A").otherwise("B").alias("decision"))
    return _appended(tables.append_traffic, rows, tables.traffic_rows(rows))


@_register
def append_postback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.sent(spark, sf_dir)
    rows = s.select(
        "id", "ts", "part_key", "country_code", "traffic_type", "payout",
        F.concat(F.lit("https://track.example.com/?p="), F.col("part_key").cast("string")).alias("postback_url"),
        "response_code", F.when(F.col("success"), " ok ").alias("response_body"),
        F.when(F.col("response_code") == 200, True).alias("success"))
    return _doubles(_appended(tables.append_postback_log, rows, tables.postback_log_rows(rows), False), "payout")


@_register
def append_postbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows of the tracking receiver, as they are stored."""
    p = derived.received(spark, sf_dir)
    given = _params(
        F.lit("status"), F.col("status"), F.lit("payout"), F.substring_index(_postback_text("payout"), ".", -1),
        F.lit("country"), F.col("country_code"), F.lit("traffic_type"), F.col("traffic_type"),
        F.lit("click_id"), F.col("click_id"))
    rows = postbacks.ingest_postbacks(p.select("id", "ts", given.alias("params")), "tracking")
    stored = _appended(tables.append_postbacks, rows, tables.received_rows(rows), False)
    return _doubles(stored.select("id", "ts", "status", "country_code", "traffic_type", "payout", "click_id", "network"),
                    "payout")


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.logs(spark, sf_dir).select(
        "id", "click_id", "ts", "country_code", F.lit(None).cast("string").alias("postback_status"),
        F.lit(0).cast("decimal(10,2)").alias("postback_payout"), F.lit(None).cast("bigint").alias("postback_ts"))


@_register
def apply_postbacks_to_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(tables.update_clicks(_clicks(spark, sf_dir), derived.received(spark, sf_dir)), "postback_payout")


@_register
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = derived.logs(spark, sf_dir).select(
        "click_id", "country_code", F.col("decision").alias("value"), F.col("ts").alias("updated_at"))
    changes = derived.received(spark, sf_dir).select(
        "click_id", "country_code", F.col("status").alias("value"), F.col("ts").alias("updated_at"), "id")
    return tables.upsert(
        base, changes, "click_id", ["value", "updated_at"], ["updated_at", "id"], key_pattern=r"\Ac[0-9]*[0-8]\z")


@_register
def delete_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "events").where("user_id % 5 = 0").select("event_id")
    return _after(derived.logs(spark, sf_dir), "logs", lambda stored: tables.delete_by_ids(stored, ids))


@_register
def clear_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _store(derived.logs(spark, sf_dir), "logs")
    removed = tables.clear(load(spark, folder, "logs")).removed_count().first()[0]
    tables.apply_split(tables.clear(load(spark, folder, "logs")), f"{folder}/logs")
    left = load(spark, folder, "logs").agg(F.count(F.lit(1)).alias("left"))
    return left.select((F.lit(removed) - F.col("left")).alias("removed"))


@_register
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(derived.logs(spark, sf_dir), "logs", lambda stored: tables.apply_retention(stored, "ts", 7, EVENTS_NOW))


@_register
def retention_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(derived.logs(spark, sf_dir), "logs", lambda stored: tables.keep_today(stored, EVENTS_NOON))


@_register
def retention_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven tables are stored, cut in place and read back. Tables of one month are stored by date, the order tables
    with their thousands of dates undated."""
    logs = derived.logs(spark, sf_dir)
    given = {
        "postback_security_log": (logs.select("id", "ts", "ip"), True),
        "failed_login_attempts": (derived.failed_logins(spark, sf_dir), True),
        "rate_limit_tracking": (_limits(spark, sf_dir), True),
        "traffic_logs": (logs, True),
        "postback_logs": (derived.sent(spark, sf_dir), False),
        "postback_received": (derived.received(spark, sf_dir), False),
        "audit_log": (logs.select("id", F.col("ts").alias("created_at")), True),
    }
    columns = {name: ts for name, ts, _ in tables.RETENTION_DAYS}
    out = None
    for name, (df, dated) in given.items():
        def split(t, name=name):
            return tables.apply_policy({name: t}, EVENTS_NOON)[name]

        stored = _after(df, name, split, columns[name], dated)
        kept = stored.agg(
            F.lit(name).alias("name"), F.count(F.lit(1)).alias("kept"), F.min(columns[name]).alias("oldest"))
        out = kept if out is None else out.unionByName(kept)
    return out


@_register
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.to_json_rows(derived.logs(spark, sf_dir))


# --- cleaning, validation, classification --------------------------------------------------------------------------


@_register
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    dirty = F.concat(F.lit(" \t\x0b"), F.col("text"), F.lit("\x01\x7f\n "))
    clean, line = text.sanitize(dirty, 2147483647), text.single_line(F.col("text"), 2147483647)
    return d.select(
        "doc_id", F.md5(clean.cast("binary")).alias("clean_md5"), F.char_length(clean).cast("bigint").alias("clean_chars"),
        F.md5(line.cast("binary")).alias("line_md5"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.requests(spark, sf_dir)
    form = _pick(
        F.col("id") % 5, F.col("ip"), F.concat(F.lit("::ffff:"), F.col("ip")), F.concat(F.col("ip"), F.lit(".1")),
        F.concat(F.lit("2001:db8::"), F.hex(F.col("id") % 65536)), F.concat(F.lit("0"), F.col("ip")))
    return r.select("id", form.alias("ip"))


@_register
def valid_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("ip")
    return _addresses(spark, sf_dir).select(
        "id", "ip", net.is_ip(c).alias("valid"), net.is_ipv4(c).alias("v4"), net.is_ipv6(c).alias("v6"))


@_register
def public_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("id", "ip", net.is_public(F.col("ip")).alias("is_public"))


@_register
def blocked_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("id", "ip", net.is_blocked(F.col("ip")).alias("is_blocked"))


CIDRS = ("203.0.0.0/19", "10.0.64.0/18", "203.0.100.9", "2001:db8::1000/116")


@_register
def cidr_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("id", "ip", net.in_any_cidr(F.col("ip"), CIDRS).alias("listed"))


@_register
def cidr_match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges from a table: the /24 block of every public address of users 0 to 2 modulo 10."""
    source = derived.requests_from(read(spark, sf_dir, "events")).where("ip like '203.%' and user_id % 10 < 3")
    ranges = source.select(F.concat(F.substring_index("ip", ".", 3), F.lit(".0/24")).alias("cidr")).distinct()
    return net.match_cidr_table(_addresses(spark, sf_dir), "ip", ranges)


@_register
def client_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.requests(spark, sf_dir)
    inner = F.concat(F.lit("192.168.0."), (F.col("id") % 200).cast("string"))
    heads = r.select(
        "id",
        F.when(F.col("id") % 7 == 0, F.col("ip")).alias("cf"),
        F.when(F.col("id") % 5 == 0, F.lit("bogus")).alias("true_client"),
        F.when(F.col("id") % 4 == 0, inner).alias("real"),
        F.when(F.col("id") % 3 == 0, F.concat(inner, F.lit(" , "), F.col("ip"))).alias("forwarded"),
        F.concat(F.lit("198.51.100."), (F.col("id") % 250).cast("string")).alias("remote"))
    columns = [F.col(c) for c in ("cf", "true_client", "real", "forwarded", "remote")]
    return heads.select(
        "id",
        net.client_ip("detector", *columns, trusted_proxies=("198.51.100.0/25",)).alias("detector"),
        net.client_ip("client", *columns).alias("client"),
        net.client_ip("secure", *columns).alias("secure"))


@_register
def resolve_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.requests(spark, sf_dir)
    header = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), F.lower("country_code")))
    return r.select("id", geo.country_of(header, F.col("country_code")).alias("country"))


@_register
def valid_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.requests(spark, sf_dir).select("id", geo.is_country(F.lower("country_code")).alias("valid"))


@_register
def normalize_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.received(spark, sf_dir).select("id", geo.norm_country(F.col("country_code")).alias("country"))


@_register
def country_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("country_code")
    return derived.requests(spark, sf_dir).select(
        "id",
        geo.country_allowed(c, "whitelist", ["US", "de"]).alias("white"),
        geo.country_allowed(c, "whitelist", []).alias("white_empty"),
        geo.country_allowed(c, "blacklist", ["BR"]).alias("black"),
        geo.country_allowed(c, "blacklist", []).alias("black_empty"),
        geo.country_allowed(c, "all", ["BR"]).alias("all_mode"))


@_register
def country_filter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a list from a table admits, in both modes, and with an empty list."""
    requests_ = derived.requests(spark, sf_dir).select("id", "country_code")
    listed = derived.rules(spark, sf_dir).where("id % 3 = 0 and country_code > 'd'").select("country_code")
    out = None
    for name, mode, codes in (("white", "whitelist", listed), ("white_empty", "whitelist", listed.where("false")),
                              ("black", "blacklist", listed), ("black_empty", "blacklist", listed.where("false"))):
        kept = geo.countries_allowed(requests_, "country_code", mode, codes).select(F.lit(name).alias("list"), "id")
        out = kept if out is None else out.unionByName(kept)
    return out


@_register
def detect_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.requests(spark, sf_dir).select("id", dev.device(F.col("user_agent")).alias("device"))


@_register
def detect_device_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("id") % 6 == 0, "Mobile").when(F.col("id") % 6 == 1, "nonsense")
    return derived.requests(spark, sf_dir).select(
        "id", dev.client_device(F.col("user_agent")).alias("device"),
        dev.client_device(F.col("user_agent"), given).alias("with_override"))


@_register
def url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", web.valid_url(u).alias("valid"), web.valid_url(u, https_only=True).alias("valid_https"),
        web.valid_url(F.replace(u, F.lit("://"), F.lit(":/"))).alias("broken"))


@_register
def redirect_url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(web.url_host(F.col("url")).alias("host")).distinct()
    size = F.length("host") % 3
    first = hosts.select("host", F.when(size == 0, "10.0.0.1").when(size == 1, "93.184.216.34").alias("ip"))
    second = hosts.where("host like 'm.%'").select("host", F.lit("169.254.169.254").alias("ip"))
    return web.check_redirect_urls(pages, first.where("ip is not null").unionByName(second)).drop("url")


@_register
def injection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("html").alias("body"))
    docs = read(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("text").alias("body"))
    out = None
    for df, name in ((found, "pages"), (docs, "documents")):
        report = quality.markup_report(df, "body").select(F.lit(name).alias("source"), "*")
        out = report if out is None else out.unionByName(report)
    return out


@_register
def injection_scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scan_markup(read(spark, sf_dir, "pages"), "html").drop("html", "url")


@_register
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(
        "event_id", _pick(F.col("event_id") % 4, F.col("props"), F.replace("props", F.lit(": "), F.lit(': "x')),
                          F.lit('{"k": null}'), F.replace("props", F.lit("}"), F.lit('.5, "z": 1}'))).alias("props"))
    return quality.check_schema(e, "props", {"k": "int"}, ["k"]).drop("props")


@_register
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.requests(spark, sf_dir)
    rules = {
        "single_line_agent": text.is_single_line(F.col("user_agent")),
        "file_name_page": text.is_file_name(F.col("user_lp")),
        "valid_ip": net.is_ip(F.col("ip")),
        "public_ip": net.is_public(F.col("ip")),
        "country": geo.is_country(F.col("country_code")),
        "alphanumeric_click": text.matches(F.col("click_id"), "alphanumeric"),
        "slug_page": text.matches(F.col("user_lp"), "slug"),
        "alpha_page": text.matches(F.col("user_lp"), "alpha"),
        "id_below_5000": numbers.is_int(F.col("id").cast("string"), 0, 4999),
        "unix_second": numbers.is_unix_second(F.col("ts").cast("string")),
        "date": text.is_date(F.date_format(F.timestamp_seconds("ts"), "yyyy-M-dd")),
        "email": text.is_email(F.concat("click_id", F.lit("@"), "user_lp", F.when(F.col("id") % 2 == 0, ".example").otherwise(""))),
        "true_page": text.to_boolean(F.replace("user_lp", F.lit("lp"), F.lit(""))),
    }
    return quality.quality_report(r, rules)


@_register
def repair_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-dirty forms of page addresses and ids, repaired: file names, mail addresses, integers and floats."""
    p, number = read(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    file = F.concat(F.lit(" ../"), F.col("url"), F.lit('?a=<b>|"c"*\x1f\t..\\ '))
    mail = F.concat(F.lit(" web master("), number, F.lit(")"), F.when(F.col("page_id") % 3 == 0, "@@").otherwise("@"), host)
    whole = _pick(F.col("page_id") % 4, number, F.concat(F.lit("0"), number), F.concat(F.lit("-"), number),
                  F.concat(number, F.lit(".5")))
    real = _pick(F.col("page_id") % 3, F.concat(number, F.lit(".25")), F.concat(number, F.lit("x")),
                 F.concat(number, F.lit("e2")))
    return p.select(
        "page_id", text.safe_file_name(file).alias("file_name"), text.clean_email(mail).alias("email"),
        numbers.int_or(whole, -1, 0, 5000).alias("whole"), numbers.float_or(real, -1.0, 0, 100000).alias("real"))


@_register
def quality_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"valid_ip": net.is_ip(F.col("ip")), "country": geo.is_country(F.col("country_code"))}
    bad = quality.failing_rows(derived.requests(spark, sf_dir), rules)
    return bad.select("id", F.array_join("failed_rules", ",").alias("failed_rules"))


@_register
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(derived.received(spark, sf_dir), ["click_id"])


@_register
def hash_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.requests(spark, sf_dir).select("id", secure.hash_ip(F.col("ip"), SALT).alias("ip_hash"))


@_register
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.requests(spark, sf_dir).select(
        "id", secure.request_fingerprint(F.col("ip"), F.col("user_agent")).alias("request"),
        secure.session_fingerprint(F.col("user_agent"), F.col("country_code"), F.col("user_lp")).alias("session"))


@_register
def verify_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.received(spark, sf_dir)
    fields = (F.col("click_id"), F.col("country_code"), F.col("payout").cast("double"), F.col("status"))
    signed = p.withColumn("signature", secure.hmac_sha256(secure.signature_payload(*fields), SECRET))
    sent = F.when(F.col("id") % 3 == 0, F.reverse("signature")).otherwise(F.col("signature"))
    return signed.select("id", "signature", secure.hmac_ok(sent, *fields, SECRET).alias("ok"))


@_register
def render_postback_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.sent(spark, sf_dir)
    template = F.when(F.col("id") % 10 == 0, "no-url-{country}").otherwise(SETTINGS.postback_url)
    url = web.render_url(template, F.lower("country_code"), F.concat("traffic_type", F.lit(" x")), F.col("payout"))
    return _doubles(s.select("id", "ts", "part_key", "payout", url.alias("url")), "payout")


@_register
def fallback_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.requests(spark, sf_dir)
    return r.select("id", web.fallback_url(
        F.upper("click_id"), F.coalesce("country_code", F.lit("XX")), F.col("user_agent"),
        F.concat("ip", F.lit("*~")), F.col("user_lp")).alias("url"))


@_register
def parse_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    given = _pick(F.col("page_id") % 3, u, F.to_json(F.array(u, F.lit("nope"), F.lit("https://b.example.com"))), F.lit(""))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(web.url_list(given), " ").alias("urls"))


@_register
def success_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = derived.sent(spark, sf_dir)
    flag = web.success_flag(F.col("part_key") % 10 != 0, F.col("response_code"))
    return s.groupBy("host", "response_code").agg(F.count_if(flag).alias("ok"), F.count_if(~flag).alias("failed")) \
        .withColumn("response_code", F.col("response_code").cast("bigint"))


# --- routing -------------------------------------------------------------------------------------------------------


@_register
def mute_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.requests(spark, sf_dir).select(
        "id", routing.is_muted(F.col("ts")).alias("muted"), routing.is_muted(F.col("ts"), False).alias("muted_off"))


@_register
def vpn_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = routing.flag_vpn(derived.requests(spark, sf_dir), _reputation(spark, sf_dir))
    return flagged.select("id", "ip", "is_vpn")


_DECIDED = ["id", "ts", "click_id", "country_code", "routed_country", "device", "is_vpn", "is_muted", "decision", "target"]


@_register
def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select(*_DECIDED)


@_register
def decide_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = routing.Settings(
        system_on=True, redirect_urls=("nope", "https://c.example.com//"), country_filter_mode="whitelist",
        country_filter_list=("US",))
    out = routing.decide(derived.requests(spark, sf_dir), settings, _reputation(spark, sf_dir))
    return out.select("id", "decision", "target")


@_register
def decide_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = derived.requests_from(derived.read_stream(spark, sf_dir, "events"))
    out = jobs.decide_stream(source, SETTINGS, _reputation(spark, sf_dir)).select(*_DECIDED)
    return spark.read.schema(out.schema).parquet(sinks.run_available(out, "decide"))


@_register
def decision_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(routing.counters(_decisions(spark, sf_dir), SETTINGS), "day")


@_register
def outgoing_postbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(routing.outgoing(_decisions(spark, sf_dir), SETTINGS), "payout")


@_register
def forward_postbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(routing.forwarded(derived.received(spark, sf_dir), FORWARD), "payout")


@_register
def match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from the customer table; clicks spread over more landing pages than there are rules for."""
    kind = dev.device(F.col("user_agent"))
    clicks = derived.requests(spark, sf_dir).select(
        "id", "country_code", F.when(kind == "WAP", "mobile").when(kind == "WEB", "desktop").otherwise(F.lower(kind))
        .alias("device_type"), F.concat(F.lit("lp"), (F.col("id") % 1009).cast("string")).alias("user_lp"))
    return routing.match_rules(clicks, derived.rules(spark, sf_dir))


# --- aggregations --------------------------------------------------------------------------------------------------


def _payout_stats(spark: SparkSession, sf_dir: str, days: int, view: str) -> DataFrame:
    cutoff = stats.stats_cutoff(days, ORDERS_NOW)
    return stats.payout_stats(derived.received(spark, sf_dir, cutoff), days, ORDERS_NOW, view)


@_register
def daily_payout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(_payout_stats(spark, sf_dir, 30, "daily"), "date")


@_register
def weekly_payout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(_payout_stats(spark, sf_dir, 365, "weekly"), "date", "week_end")


@_register
def payout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.payout_summary(_payout_stats(spark, sf_dir, 365, "daily"))


@_register
def postback_delivery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.postback_delivery_stats(derived.sent(spark, sf_dir))


@_register
def traffic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.traffic_stats(derived.logs(spark, sf_dir), EVENTS_NOW)


def _today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.logs(spark, sf_dir, stats.midnight(EVENTS_NOON))


@_register
def count_by_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_by_decision(_today(spark, sf_dir), EVENTS_NOON)


@_register
def count_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_today(_today(spark, sf_dir), EVENTS_NOON)


@_register
def country_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.country_stats(derived.logs(spark, sf_dir))


@_register
def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_countries(derived.logs(spark, sf_dir), 5)


@_register
def decision_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.decision_totals(derived.logs(spark, sf_dir))


@_register
def decision_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.decision_rates(derived.logs(spark, sf_dir))


@_register
def unique_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unique_countries(derived.logs(spark, sf_dir))


@_register
def unique_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries and addresses of the seven days up to each day, from one stored sketch per day. Small sets are counted
    exactly; of the addresses, the estimate's distance from the exact count is tested against three standard errors."""
    logs = derived.logs(spark, sf_dir)
    sketches = staged(stats.daily_sketches(logs, ["country_code", "ip"]), "sketches")
    found = stats.trailing_distinct(sketches, ["country_code", "ip"], 7)
    ends = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")
    days = logs.select(stats.utc_date(F.col("ts")).alias("day"), "ip").distinct()
    exact = days.select("day", "ip", ends).select(
        F.date_add("day", F.col("k")).alias("day"), "ip").distinct().groupBy("day").agg(F.count("*").alias("n"))
    close = F.abs(F.col("ip") - F.col("n")) <= F.greatest(F.lit(1), F.ceil(F.col("n") * 3 * stats.SKETCH_ERROR))
    return _texts(found.join(exact, "day").select("day", F.col("country_code").alias("countries"), close.alias("close")), "day")


@_register
def estimated_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(stats.estimated_revenue(derived.logs(spark, sf_dir), SETTINGS.default_payout), "revenue")


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = derived.logs(spark, sf_dir).withColumn("endpoint", F.concat(F.lit("/"), F.col("user_lp")))
    return security.rate_windows(logs, max_requests=1)


@_register
def security_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = derived.logs(spark, sf_dir, EVENTS_NOON - 86400)
    attempts = attempts.select("ts", "ip", (F.col("decision") == "A").alias("success"))
    logins = derived.failed_logins(spark, sf_dir, EVENTS_NOON - 86400)
    return security.security_summary(attempts, logins, _limits(spark, sf_dir), EVENTS_NOON)


@_register
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dashboard(derived.logs(spark, sf_dir), EVENTS_NOON, 20)


# --- filters, sorts, paging ----------------------------------------------------------------------------------------


@_register
def recent_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.page(_today(spark, sf_dir), 30, 10, EVENTS_NOON)


@_register
def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.page_info(_today(spark, sf_dir), 500, -5, EVENTS_NOON)


@_register
def recent_postbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = browse.recent_postbacks(derived.sent(spark, sf_dir), 100, _SENT_TIES)
    return _doubles(recent.withColumn("response_code", F.col("response_code").cast("bigint")), "payout")


@_register
def recent_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(browse.recent_received(derived.received(spark, sf_dir), 200), "payout")


@_register
def postbacks_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = browse.postbacks_by_status(derived.sent(spark, sf_dir), False, 50, _SENT_TIES)
    return _doubles(rows.select("id", "ts", "payout", "part_key", "success"), "payout")


@_register
def traffic_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.traffic_by_country(derived.logs(spark, sf_dir), "de", 200)


@_register
def traffic_by_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.traffic_by_decision(derived.logs(spark, sf_dir), "A", 100)


@_register
def search_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.search(derived.logs(spark, sf_dir), "C12")


@_register
def filter_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.filter_traffic(derived.logs(spark, sf_dir), "us", "2024-01-05", "2024-01-09")


# --- joins, windows, rate limits -----------------------------------------------------------------------------------


@_register
def conversions_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.conversions(derived.logs(spark, sf_dir), derived.received(spark, sf_dir))


@_register
def resolve_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    audit = events.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"))
    users = events.where("user_id % 2 = 0").select(F.col("user_id").alias("id")).distinct()
    users = users.withColumn("username", F.concat(F.lit("user"), F.col("id").cast("string")))
    return attribution.with_user(audit, users)


@_register
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.failure_streaks(derived.sent(spark, sf_dir), order=_SENT_TIES)


@_register
def rate_limit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.rate_limit_violations(derived.squeezed(spark, sf_dir))


@_register
def rate_limit_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.rate_limit_usage(derived.squeezed(spark, sf_dir))


@_register
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.rate_windows(derived.squeezed(spark, sf_dir).withColumn("endpoint", F.lit("/decision")))


# --- streams -------------------------------------------------------------------------------------------------------


@_register
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = derived.squeezed_from(derived.read_stream(spark, sf_dir, "events"))
    carried = limits.CarriedLimits(f"{work_folder(spark, 'rate-limit')}/limits")
    sinks.run_batches(source, "rate-limit-run", carried.take)
    carried.flush(spark)
    return carried.decisions(spark)


@_register
def rate_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, each as its last micro-batch reported it."""
    source = derived.squeezed_from(derived.read_stream(spark, sf_dir, "events"))
    out = jobs.rate_windows_stream(source.withColumn("endpoint", F.lit("/decision")))
    rows = spark.read.schema(f"{_ddl(out)}, batch_id bigint").parquet(
        sinks.run_available(out, "rate-windows", "update"))
    key = ["ip", "endpoint", "window_start"]
    last = F.max_by(F.struct(*[c for c in out.columns if c not in key]), "batch_id").alias("last")
    return rows.groupBy(*key).agg(last).select(*key, "last.*")


@_register
def payout_stats_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts, from a store of combinations."""
    source = derived.received_from(
        derived.read_stream(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"))
    store = stores.LatestStore(
        f"{work_folder(spark, 'payouts')}/store", jobs.COMBINATIONS, "combination", ["n"], buckets=8)
    sinks.run_batches(jobs.payout_combinations_stream(source, "weekly"), "payouts-run", store.save, "update")
    return _texts(jobs.payout_stats_of(store.read(spark), "weekly"), "date", "week_end")


@_register
def latest_postback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = derived.received_from(
        derived.read_stream(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"))
    rows = source.select("click_id", "status", "payout", "ts", "id")
    store = stores.LatestStore(f"{work_folder(spark, 'latest')}/store", _ddl(rows), "click_id", ["ts", "id"], buckets=8)
    sinks.run_batches(rows, "latest-run", store.save)
    return _doubles(store.read(spark), "payout")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
