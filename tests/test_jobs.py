"""Routing, statistics and security jobs: truth tables, brute force, empty inputs."""

from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clickloom.functions import geo
from clickloom.operators import attribution, browse, quality, routing, security, stats, tables
from clickloom.plans import lookup

REQUEST = "id bigint, ts bigint, click_id string, country_code string, user_agent string, ip string, user_lp string"
GOOD = (1, 0, "C1", "US", "wap", "8.8.8.8", "Lp")
SETTINGS = routing.Settings(
    True, ("https://a.de/",), "whitelist", ("US",), "https://t.de/?c={country}", Decimal("1.50"))


@pytest.fixture(scope="module")
def reputation(spark):
    return spark.createDataFrame([("8.8.8.8", " N\n"), ("9.9.9.9", "Y"), ("7.7.7.7", "")], "ip string, answer string")


def _decide(spark, rows, settings, reputation):
    return routing.decide(spark.createDataFrame(rows, REQUEST), settings, reputation).orderBy("id").collect()


def test_all_conditions_give_a(spark, reputation):
    r = _decide(spark, [GOOD], SETTINGS, reputation)[0]
    assert (r.decision, r.target) == ("A", "https://a.de")


@pytest.mark.parametrize("change", [
    {"system_on": False}, {"redirect_urls": ()}, {"redirect_urls": ("nope",)}, {"country_filter_list": ("DE",)},
    {"country_filter_list": ()}])
def test_settings_that_give_b(spark, reputation, change):
    assert _decide(spark, [GOOD], replace(SETTINGS, **change), reputation)[0].decision == "B"


def test_requests_that_give_b(spark, reputation):
    def but(i, **c):
        names = [x.split()[0] for x in REQUEST.split(", ")]
        return tuple({**dict(zip(names, GOOD)), "id": i, **c}[n] for n in names)

    rows = [but(1, ts=120), but(2, user_agent="Desktop"), but(3, ip="9.9.9.9"), but(4, ip="6.6.6.6"),
            but(5, ip="7.7.7.7"), but(6, country_code="DE"), but(7, country_code=""), but(8, country_code="XX"),
            but(9, country_code="ZQ"), but(10, country_code=None), but(11, ip="10.0.0.1"), but(12, ip="bad")]
    out = _decide(spark, rows, SETTINGS, reputation)
    assert [r.decision for r in out] == ["B"] * 6 + ["A"] * 6
    assert out[8].country_code == "ZQ" and out[8].routed_country == "XX"
    assert out[5].target == "/_meetups/?click_id=c1&country_code=de&user_agent=wap&ip_address=8.8.8.8&user_lp=lp"


def test_mute_cycle(spark):
    df = spark.createDataFrame([(m * 60 + 59,) for m in range(10)], "ts bigint")
    assert [r[0] for r in df.select(routing.is_muted(F.col("ts"))).collect()] == [False, False, True, True, True] * 2


def test_counters_and_outgoing(spark, reputation):
    rows = [GOOD, (2, 130, *GOOD[2:]), (3, 0, "C3", "DE", *GOOD[4:]), (4, 86400, "C4", "", *GOOD[4:])]
    decisions = routing.decide(spark.createDataFrame(rows, REQUEST), SETTINGS, reputation)
    out = sorted((str(r.day), r.total_decision_a, r.total_decision_b) for r in
                 routing.counters(decisions, SETTINGS).collect())
    assert out == [("1970-01-01", 1, 1), ("1970-01-02", 1, 0)]
    assert [r.postback_url for r in routing.outgoing(decisions, SETTINGS).collect()] == ["https://t.de/?c=US"]
    assert routing.outgoing(decisions, replace(SETTINGS, postback_url="")).isEmpty()


def test_lookup_without_broadcast(spark, setting):
    """A hot key, a missing key and unmatched keys through the shuffled way, against a plain join."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{rng.randrange(400)}") for i in range(3000)]
    left = spark.createDataFrame(rows, "id int, k string").repartition(8)
    right = spark.createDataFrame([("hot", 1, "h")] + [(f"k{i}", i, None) for i in range(0, 400, 2)],
                                  "k string, a int, b string")
    plain = sorted(map(str, left.join(right, "k", "left").select("k", "id", "a", "b").collect()))
    assert lookup.fits_broadcast(spark.range(1))
    for keys in (1000, 3):
        setting("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert not lookup.fits_broadcast(right)
        before, lookup.HOT_KEYS = lookup.HOT_KEYS, keys
        out = lookup.lookup_join(left, right, "k")
        lookup.HOT_KEYS = before
        assert out.columns == ["k", "id", "a", "b"]
        assert sorted(map(str, out.collect())) == plain


def test_rules_without_broadcast(spark, setting):
    rules = spark.createDataFrame(
        [(1, "own", "US", "mobile", None, "u1", 1, True), (2, "world", "XX", "mobile", None, "u2", 50, True),
         (3, "page", "XX", "mobile", "p", "u3", 60, True), (4, "off", "US", "mobile", None, "u4", 99, False),
         (5, "tie", "US", "mobile", None, "u5", 1, True)],
        "id int, rule_name string, country_code string, device_type string, user_lp string, redirect_url string, "
        "priority int, is_active boolean")
    clicks = spark.createDataFrame(
        [(1, "us", "mobile", "p"), (2, "DE", "mobile", "p"), (3, "DE", "mobile", None), (4, "US", "tablet", None),
         (5, None, "mobile", "q")], "id int, country_code string, device_type string, user_lp string")
    for limit in ("10485760", "-1"):
        setting("spark.sql.autoBroadcastJoinThreshold", limit)
        out = routing.match_rules(clicks, rules).orderBy("id").collect()
        assert [r.rule_id for r in out] == [1, 3, 2, None, 2]


def _brute_limit(rows, most, window):
    """Requests (ip, ts, id) that are denied, walked one by one."""
    state, denied = {}, set()
    for i, ip, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        start, used = state.get(ip, (None, 0))
        if start is None or ts - start > window:
            state[ip] = (ts, 1)
        elif used < most:
            state[ip] = (start, used + 1)
        else:
            denied.add((i, start))
    return denied


@pytest.mark.parametrize("seed,most,window,span", [(1, 3, 60, 2000), (2, 1, 7, 3 * 86400), (3, 20, 600, 4 * 86400), (4, 5, 1, 300)])
def test_rate_limit_brute_force(spark, setting, seed, most, window, span):
    rng = random.Random(seed)
    rows = [(i, f"ip{min(rng.randrange(6), rng.randrange(6))}", rng.randrange(span)) for i in range(1500)]
    # A burst in one second, and requests around midnight.
    rows += [(2000 + i, "ip0", 86400) for i in range(50)] + [(3000 + i, "ip1", 86400 - 30 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, ip string, ts bigint").repartition(5)
    expected = _brute_limit(rows, most, window)
    for limit in ("10485760", "-1"):
        setting("spark.sql.autoBroadcastJoinThreshold", limit)
        out = security.rate_limit(df, most, window).collect()
        assert len(out) == len(rows)
        assert {(r.id, r.window_start) for r in out if not r.allowed} == expected
    usage = security.rate_limit_usage(df, most, window).collect()
    assert sum(r.requests for r in usage) == len(rows) and sum(r.denied for r in usage) == len(expected)


def test_rate_limit_edges(spark):
    rows = [(i, "a", 0) for i in range(121)] + [(200, "a", 60), (201, "a", 61)]
    out = security.rate_limit_violations(spark.createDataFrame(rows, "id bigint, ip string, ts bigint"))
    assert sorted(r.id for r in out.collect()) == [120, 200]


def _brute_streaks(rows, threshold, gap):
    found, hosts = set(), defaultdict(list)
    for r in rows:
        hosts[r[1]].append(r)
    for host, items in hosts.items():
        run = []
        for i, _, ts, ok in sorted(items, key=lambda r: (r[2], r[0])) + [(None, None, None, True)]:
            if ok or (run and ts - run[-1] > gap):
                if len(run) >= threshold:
                    found.add((host, run[0], run[-1], len(run)))
                run = []
            if not ok:
                run.append(ts)
    return found


@pytest.mark.parametrize("seed,good,parts", [(1, 0.1, 8), (2, 0.5, 3), (3, 0.02, 16), (4, 0.9, 8), (5, 0.0, 16)])
def test_failure_streaks_brute_force(spark, setting, seed, good, parts):
    """A host with most rows is cut over many partitions, in tiny batches; runs must come out whole."""
    rng = random.Random(seed)
    rows = [(i, "big" if rng.random() < 0.7 else f"h{rng.randrange(20)}", rng.randrange(60000), rng.random() < good)
            for i in range(4000)]
    setting("spark.sql.shuffle.partitions", str(parts))
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    setting("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    df = spark.createDataFrame(rows, "id bigint, host string, ts bigint, success boolean").repartition(6)
    out = security.failure_streaks(df, 3, 60).collect()
    assert sorted(map(tuple, out)) == sorted(_brute_streaks(rows, 3, 60))


def test_security_summary_of_nothing(spark):
    a = spark.createDataFrame([], "ts bigint, ip string, success boolean")
    b = spark.createDataFrame([], "attempted_at bigint, ip string")
    c = spark.createDataFrame([], "ip string, window_start bigint, window_end bigint, blocked_until bigint")
    out = [tuple(r) for r in security.security_summary(a, b, c, 0).collect()]
    assert sorted(out) == [("failed_logins", 0, 0, 0, 0, None), ("postback_attempts", 0, None, None, 0, None),
                           ("rate_limits", 0, None, None, 0, None)]


def test_weekly_boundary(spark):
    # Sunday 2024-01-07 23:00, Monday 06:59:59 and Monday 07:00:00 UTC.
    rows = [(1704668400,), (1704697199,), (1704697200,)]
    df = spark.createDataFrame(rows, "ts bigint").withColumns({
        "payout": F.lit(1).cast("decimal(10,2)"), "traffic_type": F.lit("a"), "country_code": F.lit("b"),
        "network": F.lit(None).cast("string")})
    out = stats.payout_stats(df, 30, 1704697200, "weekly").collect()
    assert [(str(r.date), str(r.week_end), r.total_postbacks, r.unique_networks) for r in out] == [
        ("2024-01-08", "2024-01-14", 1, 0), ("2024-01-01", "2024-01-07", 2, 0)]
    assert len(stats.payout_stats(df, 999, 1704697200, "other").columns) == 9


def test_empty_statistics(spark):
    logs = spark.createDataFrame([], "id bigint, ts bigint, country_code string, decision string")
    assert tuple(stats.traffic_stats(logs, 10).first()) == (0, 0, 0, 0)
    assert tuple(stats.decision_rates(logs).first()) == (0.0, 0.0, 0)
    assert tuple(stats.decision_totals(logs).first()) == (0, 0, 0, 0, 0)
    assert sorted(map(tuple, stats.count_by_decision(logs, 10).collect())) == [("A", 0), ("B", 0)]
    sent = spark.createDataFrame([], "success boolean, payout decimal(10,2)")
    assert tuple(stats.postback_delivery_stats(sent).first()) == (0, 0, 0, 0.0, 0.0)
    empty = spark.createDataFrame([], "total_postbacks bigint, total_payout double")
    assert tuple(stats.payout_summary(empty).first()) == (0, 0.0, 0.0, 0)


def test_country_stats_counts_everything_not_a(spark):
    rows = [("US", "A"), ("US", None), ("", "X"), (None, "B")]
    out = stats.country_stats(spark.createDataFrame(rows, "country_code string, decision string"))
    assert sorted(map(tuple, out.collect())) == [("US", 2, 1, 1), ("XX", 2, 0, 2)]


def test_paging_and_search(spark):
    assert [browse.page_size(x) for x in (1, 200, 1000)] == [1, 200, 1000]
    for limit, most in ((0, None), (-3, None), (201, 200)):
        with pytest.raises(ValueError):
            browse.page_size(limit, most)
    df = spark.createDataFrame([("Abc%", "US", None, "x"), (None, None, "1.2.3.4", "abc")],
                               "click_id string, country_code string, ip string, user_lp string")
    assert browse.search(df, "a").isEmpty()
    assert browse.search(df, "BC").count() == 2 and browse.search(df, "c%").count() == 1
    assert browse.traffic_by_decision(df.withColumns({"id": F.lit(1), "decision": F.lit("C")}), "C").isEmpty()


def test_markup_patterns(spark):
    texts = ["<SCRIPT >", "<scripts>", "JavaScript:x", "onClick =", "<iframe", "<object ", "<embed/", "VBScript:",
             "data:text/html", "plain once upon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = quality.scan_markup(df, "t").orderBy("i").collect()
    assert [r.suspicious for r in out] == [True, False] + [True] * 7 + [False, False]
    report = {r.pattern: r.hits for r in quality.markup_report(df, "t").collect()}
    assert all(n == 1 for n in report.values()) and len(report) == 8


def test_quality(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, v int")
    rules = {"v_set": F.col("v").isNotNull(), "v_small": F.col("v") < 2}
    assert sorted(map(tuple, quality.quality_report(df, rules).collect())) == [("v_set", 2, 1), ("v_small", 1, 2)]
    assert sorted(len(r.failed_rules) for r in quality.failing_rows(df, rules).collect()) == [1, 2]
    assert [tuple(r) for r in quality.duplicate_keys(df, ["k"]).collect()] == [("a", 2)]


def test_payouts_cover_every_period(spark):
    as_of = 20_000 * 86400 + 43_200
    rows = spark.range(365 * 24 + 12).selectExpr(
        f"{as_of} - id * 3600 AS ts", "'WAP' AS traffic_type", "'US' AS country_code", "'n' AS network",
        "CAST(1 AS decimal(10,2)) AS payout").where(f"ts >= {as_of - 365 * 86400}")
    daily = stats.payout_stats(rows, 365, as_of)
    assert daily.count() == 366 and daily.agg(F.sum("total_postbacks")).first()[0] == rows.count()
    assert stats.payout_summary(daily).first()["total_postbacks"] == rows.count()
    assert stats.payout_stats(rows, 365, as_of, max_periods=3).count() == 3
    with pytest.raises(ValueError):
        stats.payout_stats(rows, 0, as_of)


def test_rules_match_in_wide_and_narrow_plans(spark, setting):
    """Packed rules against every rule tried on every click; a third of the clicks have one page, some have none."""
    rng = random.Random(4)
    places, kinds, pages = ["us", "DE", "xx", None, "FR"], ["mobile", "desktop", "", None], ["p", "q", None, "r"]
    rules = [(i, f"n{i}", rng.choice(places), rng.choice(kinds), rng.choice(pages), f"u{i}", rng.randint(0, 3), rng.random() < 0.8)
             for i in range(120)]
    clicks = [(i, rng.choice(["US", "de", "XX", None, "ZZ"]), rng.choice(kinds), "p" if i % 3 == 0 else rng.choice([*pages, "s"]))
              for i in range(300)]

    def best(place, kind, page):
        fit = []
        for i, _, where, what, only, _, priority, on in rules:
            if on and where is not None and what is not None and what == (kind or "") and only in (None, page):
                if where.upper() in ((place or "xx").upper(), "XX"):
                    fit.append((where.upper() == (place or "xx").upper(), priority, -i))
        return -max(fit)[2] if fit else None

    expected = {i: best(place, kind, page) for i, place, kind, page in clicks}
    table = spark.createDataFrame(rules, "id int, rule_name string, country_code string, device_type string, user_lp string, "
                                         "redirect_url string, priority int, is_active boolean")
    frame = spark.createDataFrame(clicks, "id int, country_code string, device_type string, user_lp string")
    for limit in ("10485760", "-1"):
        setting("spark.sql.autoBroadcastJoinThreshold", limit)
        assert {r.id: r.rule_id for r in routing.match_rules(frame, table).collect()} == expected
    plan = routing.match_rules(frame, table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") <= 4  # one lookup with its hot keys, and one broadcast


def test_upsert_reads_the_base_once(spark, setting, tmp_path):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.range(50).selectExpr("cast(id as string) as k", "id as v", "1 as w").write.parquet(f"{tmp_path}/base")
    base = spark.read.parquet(f"{tmp_path}/base")
    changes = spark.createDataFrame([("3", 30, 9, 1), ("3", 31, 9, 2), ("x", 5, 7, 1)], "k string, v bigint, w int, at int")
    out = tables.upsert(base, changes, "k", ["v"], ["at"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert sorted(map(tuple, out.collect())) == sorted([(str(i), 31 if i == 3 else i, 1) for i in range(50)] + [("x", 5, 7)])


def test_a_click_counts_in_one_country(spark):
    logs = spark.createDataFrame([(1, 10, "c", "US"), (2, 5, "c", "DE"), (3, 7, "d", None), (4, 7, None, "US")],
                                 "id bigint, ts bigint, click_id string, country_code string")
    posts = spark.createDataFrame([("c", 1, 1, "confirmed", Decimal(2)), ("d", 1, 2, "confirmed", Decimal(3))],
                                  "click_id string, ts bigint, id bigint, status string, payout decimal(10,2)")
    found = attribution.conversions(logs, posts).select("country", "clicks", "converted", "payout").collect()
    assert sorted(map(tuple, found)) == [("DE", 1, 1, 2.0), ("XX", 1, 1, 3.0)]


def test_country_tables(spark):
    df = spark.createDataFrame([("us",), ("DE",), (None,), ("",)], "c string")
    codes = spark.createDataFrame([("US", 1), ("us", 2), (None, 3)], "code string, n int")
    for mode, listed, kept in (("whitelist", codes, ["us"]), ("whitelist", codes.limit(0), []), ("all", codes, ["", "DE", "us", None]),
                               ("blacklist", codes, ["", "DE", None]), ("blacklist", codes.limit(0), ["", "DE", "us", None])):
        found = [r.c for r in geo.countries_allowed(df, "c", mode, listed).collect()]
        assert sorted(found, key=lambda c: (c is None, c or "")) == kept


def test_sketches_unite_days(spark):
    rows = spark.range(40_000).selectExpr("(id % 10) * 86400 as ts", "cast(id % 7 as string) as few", "cast(id as string) as many")
    sketches = stats.daily_sketches(rows.union(spark.createDataFrame([(0, None, "")], "ts bigint, few string, many string")),
                                    ["few", "many"])
    found = stats.distinct_between(sketches, ["few", "many"], "1970-01-01", "1970-01-10").first()
    assert found.few == 7 and abs(found.many - 40_000) <= 40_000 * 3 * stats.SKETCH_ERROR
    part = stats.distinct_between(sketches, ["many"], "1970-01-02", "1970-01-03").first().many
    assert abs(part - 8000) <= 8000 * 3 * stats.SKETCH_ERROR
    assert stats.distinct_between(sketches, ["few"], "1999-01-01", "1999-01-02").first().few == 0
