"""A/B routing decisions over whole tables of requests. The same functions take streams."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.device import device
from clickloom.functions.geo import UNKNOWN_COUNTRY, country_allowed, is_country
from clickloom.functions.net import is_public
from clickloom.functions.text import trimmed
from clickloom.functions.web import fallback_url, render_forward_url, render_url, valid_url_text
from clickloom.plans.barrier import computed_once
from clickloom.plans.lookup import lookup_join
from clickloom.plans.pruning import utc_date

# Of every five minutes, the first two are active.
MUTE_CYCLE_MINUTES = 5
ACTIVE_MINUTES = 2


@dataclass(frozen=True)
class Settings:
    """The one configuration row a batch of requests is decided under."""

    system_on: bool = False
    redirect_urls: tuple[str, ...] = ()
    country_filter_mode: str = "all"
    country_filter_list: tuple[str, ...] = field(default=())
    postback_url: str = ""
    default_payout: Decimal = Decimal("0.00")


def is_muted(ts: Column, system_on: bool = True) -> Column:
    if not system_on:
        return F.lit(False)
    return F.pmod(F.floor(ts / 60), F.lit(MUTE_CYCLE_MINUTES)) >= ACTIVE_MINUTES


def flag_vpn(df: DataFrame, reputation: DataFrame, ip: str = "ip") -> DataFrame:
    """Adds ``is_vpn``. Reputation rows (ip, answer) are unique per address; no answer counts as a VPN.

    Invalid and private addresses are never looked up.
    """
    side = reputation.select(F.col("ip").alias(ip), trimmed(F.col("answer")).alias("_answer"))
    joined = lookup_join(df, side, ip)
    asked = is_public(F.col(ip))
    answered = F.coalesce(F.col("_answer"), F.lit("")) != ""
    flag = F.when(~asked, False).when(answered, F.col("_answer") == "Y").otherwise(True)
    return joined.withColumn("is_vpn", flag).drop("_answer")


def decide(requests: DataFrame, settings: Settings, reputation: DataFrame) -> DataFrame:
    """Adds device, is_vpn, routed_country, is_muted, decision and target to requests.

    Columns read: ts, click_id, country_code, user_agent, ip, user_lp. The country of the input is left as it came;
    ``routed_country`` holds the one the decision used. One of several redirect URLs is picked by a digest of the
    click id, so that a rerun gives the same target.
    """
    urls = [u.rstrip("/") for u in settings.redirect_urls if valid_url_text(u)]
    given = F.coalesce("country_code", F.lit(UNKNOWN_COUNTRY))
    routed = F.when((given == "") | is_country(given), given).otherwise(F.lit(UNKNOWN_COUNTRY))
    open_country = F.col("routed_country").isin("", UNKNOWN_COUNTRY)
    allowed = open_country | country_allowed(
        F.col("routed_country"), settings.country_filter_mode, settings.country_filter_list)

    df = flag_vpn(requests, reputation).withColumns({
        "device": device(F.col("user_agent")),
        "routed_country": routed,
        "is_muted": is_muted(F.col("ts"), settings.system_on),
    })
    go = F.lit(False)
    if settings.system_on and urls:
        go = ~F.col("is_muted") & (F.col("device") == "WAP") & ~F.col("is_vpn") & allowed
    df = df.select("*", computed_once(F.when(go, "A").otherwise("B")).alias("decision"))
    other = fallback_url(F.col("click_id"), F.col("routed_country"), F.col("device"), F.col("ip"), F.col("user_lp"))
    target = other
    if urls:
        digest = F.md5(F.coalesce("click_id", F.lit("")).cast("binary"))
        slot = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(len(urls))).cast("int")
        target = F.when(F.col("decision") == "A", F.get(F.array(*[F.lit(u) for u in urls]), slot)).otherwise(other)
    return df.withColumn("target", target)


def counters(decisions: DataFrame, settings: Settings) -> DataFrame:
    """Daily A and B counters. B counts only while the system is on and not muted."""
    counted = (F.col("decision") == "B") & ~F.col("is_muted") & F.lit(settings.system_on)
    return decisions.groupBy(utc_date(F.col("ts")).alias("day")).agg(
        F.count_if(F.col("decision") == "A").alias("total_decision_a"),
        F.count_if(counted).alias("total_decision_b"),
    )


def outgoing(decisions: DataFrame, settings: Settings) -> DataFrame:
    """One rendered postback per A decision with a valid country. Sending is left to the caller."""
    if not settings.postback_url:
        decisions = decisions.where(F.lit(False))
    payout = F.lit(settings.default_payout).cast("decimal(10,2)")
    url = render_url(F.lit(settings.postback_url), F.col("routed_country"), F.col("device"), payout)
    sent = decisions.where((F.col("decision") == "A") & is_country(F.col("routed_country")))
    rows = sent.select(
        "id", "ts", F.col("routed_country").alias("country_code"), F.col("device").alias("traffic_type"),
        payout.alias("payout"), computed_once(url).alias("postback_url"))
    return rows.where("postback_url is not null")


def forwarded(postbacks: DataFrame, template: str) -> DataFrame:
    """One URL per received postback that is passed on. Rows without a valid country or a valid URL are left out.

    The values go into the template as they are, the payout without trailing zeros; the result is then checked like any
    outgoing postback. An empty template forwards nothing.
    """
    if not template:
        postbacks = postbacks.where(F.lit(False))
    payout = F.col("payout").cast("decimal(10,2)")
    plain = F.regexp_replace(payout.cast("string"), r"\.?0+$", "")
    filled = render_forward_url(F.lit(template), *[F.coalesce(c, F.lit("")) for c in (
        F.col("click_id"), F.col("status"), plain, F.col("country_code"), F.col("traffic_type"))])
    url = render_url(filled, F.col("country_code"), F.coalesce("traffic_type", F.lit("")), payout)
    rows = postbacks.select("id", "ts", "country_code", "traffic_type", payout.alias("payout"),
                            computed_once(url).alias("postback_url"))
    return rows.where("postback_url is not null")


# More kinds of device than this, and rules for all pages are not broadcast.
_MAX_KINDS = 1000


def _packed(best: DataFrame, *keys: str) -> DataFrame:
    """One row per key with its winners by country, at most one for each country code."""
    return best.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_rule"))).alias("_rules"))


def match_rules(clicks: DataFrame, rules: DataFrame) -> DataFrame:
    """Best active rule per click, null where none fits.

    Columns read: country_code, device_type, user_lp. A rule of the click's own country beats a global one, then the
    higher priority wins, then the lower id. The rules are folded to one winner per (country, device, landing page) and
    packed by country, so a click finds all of its candidates in two rows: that of its device and page, by one lookup,
    and that of its device alone, which is a broadcast of a few rows. No click is multiplied or regrouped.
    """
    active = rules.where("is_active and country_code is not null and device_type is not null").select(
        F.upper("country_code").alias("_place"), F.col("device_type").alias("_kind"), F.col("user_lp").alias("_page"),
        F.struct(F.col("priority").alias("priority"), (-F.col("id")).alias("order"), F.col("id").alias("rule_id"),
                 F.col("rule_name").alias("rule_name"), F.col("redirect_url").alias("redirect_url")).alias("_rule"))
    best = active.groupBy("_place", "_kind", "_page").agg(F.max("_rule").alias("_rule"))
    kind = F.coalesce("device_type", F.lit(""))
    slot = F.concat_ws("\x1f", F.col("_kind"), F.col("_page"))
    paged = _packed(best.where("_page is not null").withColumn("_slot", slot), "_slot")
    everywhere = _packed(best.where("_page is null"), "_kind").withColumnRenamed("_rules", "_general")
    wanted = clicks.withColumns({
        "_slot": F.when(F.col("user_lp").isNotNull(), F.concat_ws("\x1f", kind, F.col("user_lp"))), "_kind": kind})
    wanted = lookup_join(wanted, paged, "_slot", clicks.columns).drop("_slot")
    if everywhere.limit(_MAX_KINDS + 1).count() <= _MAX_KINDS:
        wanted = wanted.join(F.broadcast(everywhere), "_kind", "left")
    else:
        wanted = lookup_join(wanted, everywhere, "_kind", clicks.columns)

    def winner(place: Column) -> Column:
        return F.greatest(F.col("_rules")[place], F.col("_general")[place])

    own = winner(F.coalesce(F.upper("country_code"), F.lit(UNKNOWN_COUNTRY)))
    chosen = wanted.withColumn("_rule", F.coalesce(own, winner(F.lit(UNKNOWN_COUNTRY))))
    return chosen.select(
        *clicks.columns, F.col("_rule.rule_id").alias("rule_id"), F.col("_rule.rule_name").alias("rule_name"),
        F.col("_rule.redirect_url").alias("redirect_url"))
