"""Hand-made rows per column function."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from clickloom.functions import device, geo, net, numbers, secure, text, web
from clickloom.sources import params


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]

    return run


def test_sanitize(apply):
    given = ["  a\tb \n", "\x0b\0x\x01y\x7f", "äöü€𝄞z", None, " \t "]
    assert apply(lambda c: text.sanitize(c, 5), given) == ["a\tb", "xy", "äöü€𝄞", None, ""]


def test_single_line_and_file_name(apply):
    assert apply(text.single_line, ["a\r\nb\tc", "x"]) == ["a  b c", "x"]
    assert apply(text.safe_file_name, ["../etc/pass<wd>", "a\\b:c?", "ok.txt"]) == ["etcpasswd", "abc", "ok.txt"]
    assert apply(text.is_file_name, ["../x", "a.txt", "a|b"]) == [False, True, False]


def test_first_bytes(apply):
    assert apply(lambda c: text.first_bytes(c, 4), ["abcdef", "abc", "aäö€"]) == ["abcd", "abc", "aä�"]


def test_patterns(apply):
    assert apply(lambda c: text.matches(c, "alphanumeric"), ["a1", "a-1", "", "a1\n", None]) == [
        True, False, False, True, False]
    assert apply(lambda c: text.matches(c, "slug"), ["a_b-1", "A"]) == [True, False]
    assert apply(lambda c: text.matches(c, "config_key"), ["A_1", "_X", "1A", "a"]) == [True, True, False, False]
    assert apply(text.is_email, ["a@b.co", "a.b+c@x-y.org", "a@b", "a..b@c.de", "@c.de", "a@1.2.3.4"]) == [
        True, True, False, False, False, False]
    assert apply(text.clean_email, [" a b@c.de ", "x"]) == ["ab@c.de", None]


def test_booleans_and_dates(apply):
    given = ["1", "0", "0.5", "2.5", "true", " YES ", "on", "off", "", None, "1e3"]
    assert apply(text.to_boolean, given) == [
        True, False, False, True, True, True, True, False, False, False, True]
    assert apply(text.is_date, ["2024-02-29", "2023-02-29", "2024-2-9", "x", None]) == [True, False, False, False, False]


def test_numbers(apply):
    given = ["12abc", " -1.5e2x", ".5", "abc", "", None, "1.2.3", "+7"]
    assert apply(numbers.number_prefix, given) == [12.0, -150.0, 0.5, 0.0, 0.0, 0.0, 1.2, 7.0]
    assert apply(lambda c: numbers.is_int(c, 1, 200), ["1", "200", "201", "01", "+1", "1.0", "x", None]) == [
        True, True, False, False, False, False, False, False]
    assert apply(lambda c: numbers.int_or(c, 50, 1, 200), ["7", "999", "x"]) == [7, 50, 50]
    assert apply(lambda c: numbers.float_or(c, 1.5, 0, 10), ["2.5", "11", "x", "1e1"]) == [2.5, 1.5, 1.5, 10.0]
    assert apply(numbers.is_unix_second, ["0", "2147483647", "2147483648", "-1"]) == [True, True, False, False]


def test_money(apply):
    given = [0.285, 1.005, 1e12, -1e12, 5.2065]
    assert [str(v) for v in apply(numbers.money, given, "double")] == [
        "0.29", "1.01", "99999999.99", "-99999999.99", "5.21"]
    assert apply(numbers.money_text, [1.0, 1234.5], "double") == ["1.00", "1234.50"]


def test_float_text(apply):
    given = [1.0, 0.285, 10000000.0, 1e16, 1e25, 1e-5, 0.0001, -2.5, 0.0, 112946.26, 0.1 + 0.2]
    assert apply(numbers.float_text, given, "double") == [
        "1", "0.285", "10000000", "10000000000000000", "1.0E+25", "1.0E-5", "0.0001", "-2.5", "0", "112946.26",
        "0.30000000000000004"]


def test_countries(apply):
    codes = geo.country_codes()
    assert len(codes) == 250 and "XX" in codes and "ZQ" not in codes
    assert apply(geo.is_country, ["us", "XX", "ZQ", "", None, "USA"]) == [True, True, False, False, False, False]
    assert apply(geo.norm_country, ["DE", "UNITED STA", None]) == ["DE", "XX", "XX"]
    assert apply(lambda c: geo.country_allowed(c, "whitelist", []), ["US"]) == [False]
    assert apply(lambda c: geo.country_allowed(c, "blacklist", []), ["US"]) == [True]


def test_device(apply):
    given = ["", "wap", "Desktop", "tablet", "Googlebot Mobile", "iPad; CPU", "Linux; Android", "X11; Linux", None, "MOBILE"]
    assert apply(device.device, given) == [
        "WEB", "WAP", "WEB", "TABLET", "BOT", "TABLET", "WAP", "WEB", "WEB", "WAP"]
    assert apply(device.client_device, ["", "iPad", "a crawler", "wap", "iPhone"]) == ["web", "wap", "bot", "web", "wap"]


V4_CASES = ["1.2.3.4", "0.0.0.0", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4\n", "", None]
V6_CASES = [
    "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "1::2::3", "fe80::1%eth0",
    "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.400", "12345::", "2001:DB8::FF00:42:8329", ":1", "1:", "g::"]


def test_ip_validity(apply):
    def valid(v, version):
        try:
            return "%" not in v and ipaddress.ip_address(v).version == version
        except (ValueError, TypeError):
            return False

    given = V4_CASES + V6_CASES
    assert apply(net.is_ipv4, given) == [valid(v, 4) for v in given]
    assert apply(net.is_ipv6, given) == [valid(v, 6) for v in given]
    assert apply(net.is_ip, given) == [valid(v, 4) or valid(v, 6) for v in given]


def _random_addresses(n):
    rng = random.Random(7)
    found = []
    for i in range(n):
        if i % 2:
            found.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
        else:
            bits = rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128)
            found.append(str(ipaddress.IPv6Address(bits)))
    return found


def test_ipv6_digits(apply):
    given = [v for v in _random_addresses(200) + V6_CASES[:5] + V6_CASES[8:10] if ":" in v]
    assert apply(net.ipv6_digits, given) == [f"{int(ipaddress.ip_address(v)):032x}" for v in given]


def test_cidr_against_ipaddress(apply):
    rng = random.Random(3)
    given = _random_addresses(300)
    ranges = []
    for v in given[:60]:
        a = ipaddress.ip_address(v)
        ranges.append(f"{v}/{rng.randrange(8 if a.version == 4 else 20, a.max_prefixlen + 1)}")
    blocks = [ipaddress.ip_network(r, strict=False) for r in ranges]
    edges = [str(a) for b in blocks for x in (int(b[0]) - 1, int(b[0]), int(b[-1]), int(b[-1]) + 1)
             if 0 <= x < 2 ** b.max_prefixlen for a in [type(b[0])(x)]]
    cases = given + edges
    expected = [any(ipaddress.ip_address(v).version == b.version and ipaddress.ip_address(v) in b for b in blocks)
                for v in cases]
    assert apply(lambda c: net.in_any_cidr(c, ranges), cases) == expected


def test_cidr_table_against_ipaddress(spark):
    given = sorted(set(_random_addresses(200)))
    ranges = [f"{v}/{p}" for v, p in zip(given[:40], [9, 16, 23, 32, 8] * 8) if "." in v] + [
        f"{v}/{p}" for v, p in zip(given[-40:], [33, 64, 127, 128] * 10) if ":" in v] + ["junk", "1.2.3.4/99", given[3]]
    blocks = [ipaddress.ip_network(r, strict=False) for r in ranges if r not in ("junk", "1.2.3.4/99")]
    expected = {v for v in given if any(
        ipaddress.ip_address(v).version == b.version and ipaddress.ip_address(v) in b for b in blocks)}
    df = spark.createDataFrame([(v,) for v in given + given], "ip string")
    found = net.match_cidr_table(df, "ip", spark.createDataFrame([(r,) for r in ranges], "cidr string"))
    rows = [r.ip for r in found.collect()]
    assert set(rows) == expected and len(rows) == 2 * len(expected)


def test_cidr_table_of_many_ranges(spark, setting):
    """Prefixes of 0 and 8 bits beside many long ones, a hot address, and as many partitions as there is room for."""
    rng = random.Random(6)

    def v4():
        return ".".join(str(rng.randrange(256)) for _ in range(4))

    def v6():
        return ":".join(f"{rng.randrange(65536):x}" for _ in range(8))

    setting("spark.sql.shuffle.partitions", "13")
    given = [v4() for _ in range(150)] + [v6() for _ in range(50)] + ["10.1.2.3"] * 100 + [None, "bad", "::ffff:1.2.3.4"]
    long = [f"{rng.choice(given[:200])}/{rng.choice([20, 24, 31, 32, 61])}" for _ in range(60)] + [f"{v4()}/24" for _ in range(500)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(given)], "n int, ip string")
    for extra in ([], ["10.0.0.0/8"], ["0.0.0.0/0"], ["::/0", "junk", "1.2.3.4/33", "1.2.3.4/x", None]):
        ranges = long + extra
        nets = []
        for r in ranges:
            try:
                nets.append(ipaddress.ip_network(r, strict=False))
            except ValueError:
                continue
        def inside(a):
            try:
                x = ipaddress.ip_address(a)
            except ValueError:
                return False
            return any(x.version == n.version and x in n for n in nets)

        found = net.match_cidr_table(df, "ip", spark.createDataFrame([(r,) for r in ranges], "cidr string"))
        assert sorted(r.n for r in found.collect()) == [i for i, a in enumerate(given) if a and inside(a)]


def test_cidr_lists(apply):
    ranges = ["203.0.113.0/24", "198.51.100.0/24", "192.0.2.0/24"]
    given = ["203.0.113.0", "203.0.113.255", "203.0.112.255", "203.0.114.0", "2001:db8::1", None]
    assert apply(lambda c: net.in_any_cidr(c, ranges), given) == [True, True, False, False, False, False]
    assert apply(lambda c: net.in_any_cidr(c, []), given[:1]) == [True]
    assert apply(lambda c: net.in_any_cidr(c, ["1.1.1.1", "nonsense/8"]), ["1.1.1.1", "1.1.1.2"]) == [True, False]
    assert apply(lambda c: net.in_any_cidr(c, ["0.0.0.0/0"]), ["9.9.9.9", "::1", "x"]) == [True, False, False]


def test_public_and_blocked(apply):
    closed = ["10.0.0.1", "172.16.0.1", "172.31.255.255", "192.168.1.1", "127.0.0.1", "169.254.169.254", "0.1.2.3",
              "240.0.0.1", "255.255.255.255", "::", "::1", "::ffff:8.8.8.8", "fe80::1", "febf::", "fc00::1", "fdff::1", "x", None]
    opened = ["8.8.8.8", "172.15.0.1", "172.32.0.1", "203.0.113.9", "11.0.0.1", "2001:db8::1", "fec0::1", "::2", "239.1.1.1"]
    assert apply(net.is_public, closed) == [False] * len(closed)
    assert apply(net.is_public, opened) == [True] * len(opened)
    assert apply(net.is_blocked, closed[:-1]) == [True] * (len(closed) - 1)
    assert apply(net.is_blocked, opened) == [False] * len(opened)


def test_client_ip(spark):
    rows = [
        (1, "1.1.1.1", None, None, "2.2.2.2", "198.51.100.1"),
        (2, None, None, None, "10.0.0.1, 8.8.8.8", "198.51.100.1"),
        (3, None, None, None, "10.0.0.1, 10.0.0.2", "198.51.100.1"),
        (4, None, "x", "", None, None),
        (5, None, "9.9.9.9", "7.7.7.7", None, "203.0.113.1"),
    ]
    df = spark.createDataFrame(rows, "i int, cf string, tc string, real string, xff string, remote string")
    c = [F.col(x) for x in ("cf", "tc", "real", "xff", "remote")]
    out = df.orderBy("i").select(
        net.client_ip("detector", *c, trust_headers=True).alias("a"), net.client_ip("detector", *c).alias("b"),
        net.client_ip("client", *c).alias("c"), net.client_ip("secure", *c).alias("d"),
        net.client_ip("detector", *c, trust_cf=True).alias("e"),
        net.client_ip("detector", *c, trusted_proxies=("203.0.113.0/24",)).alias("f")).collect()
    assert [r.a for r in out] == ["1.1.1.1", "8.8.8.8", "10.0.0.1", "0.0.0.0", "9.9.9.9"]
    assert [r.b for r in out] == ["198.51.100.1"] * 3 + ["0.0.0.0", "203.0.113.1"]
    assert [r.c for r in out] == ["1.1.1.1", "8.8.8.8", "198.51.100.1", "0.0.0.0", "9.9.9.9"]
    assert [r.d for r in out] == ["1.1.1.1", "10.0.0.1", "10.0.0.1", "0.0.0.0", "7.7.7.7"]
    assert [r.e for r in out] == ["1.1.1.1", "198.51.100.1", "198.51.100.1", "0.0.0.0", "203.0.113.1"]
    assert [r.f for r in out] == ["198.51.100.1"] * 3 + ["0.0.0.0", "9.9.9.9"]


def test_urls(apply):
    good = ["https://a.example.com", "http://a.b/c?d=e#f", "https://u:p@host.tld:8080/x", "ftp://host/file",
            "mailto:a@b.de", "https://1.2.3.4/x", "https://[::1]/", "HTTPS://A.DE", "https://localhost"]
    bad = ["", "nope", "http://", "http:///x", "https://a b.de", "https://ä.de", "//x.de/a", "https://-a.de",
           "https://a_b.de/", "http:/a.de", None]
    assert apply(web.valid_url, good) == [True] * len(good)
    assert apply(web.valid_url, bad) == [False] * len(bad)
    assert [web.valid_url_text(u) for u in good + bad[:-1]] == [True] * len(good) + [False] * (len(bad) - 1)
    assert apply(lambda c: web.valid_url(c, True), ["https://a.de", "http://a.de"]) == [True, False]


def test_encodings(apply):
    assert apply(web.form_encode, ["a b*~é/.-_"]) == ["a+b%2A%7E%C3%A9%2F.-_"]
    assert apply(web.percent_encode, ["a b*~é/.-_"]) == ["a%20b%2A~%C3%A9%2F.-_"]


def test_url_list(apply):
    given = ['["https://a.de","x","https://b.de"]', "https://c.de", "", None, "[]", "[broken", '{"a":1}']
    assert apply(web.url_list, given) == [["https://a.de", "https://b.de"], ["https://c.de"], [], [], [], [], []]


def test_render(spark):
    df = spark.range(1).select(
        web.render_url(F.lit("https://x.de/?c={country}&t={traffic_type}&p={payout}"), F.lit("us"), F.lit("A B"),
                       F.lit(1234.5)).alias("a"),
        web.render_url(F.lit("https://x.de/?c={country}"), F.lit("ZQ"), F.lit("A"), F.lit(1)).alias("b"),
        web.render_url(F.lit("bad {country}"), F.lit("US"), F.lit("A"), F.lit(1)).alias("c"),
        web.render_forward_url(F.lit("https://x.de/{click_id}/{status}/{payout}/{country}/{device}"), F.lit("c1"),
                               F.lit("ok"), F.lit("1.5"), F.lit("US"), F.lit("WAP")).alias("d"))
    r = df.first()
    assert r.a == "https://x.de/?c=US&t=A+B&p=1234.50"
    assert r.b is None and r.c is None
    assert r.d == "https://x.de/c1/ok/1.5/US/WAP"


def test_redirect_checks(spark):
    urls = ["https://good.example.com/x", "http://good.example.com", "https://bad.example.com", "nope", "",
            "https://unknown.example.com", "https://good.example.com/" + "a" * 2100, "https://[::1]/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    dns = spark.createDataFrame([
        ("good.example.com", "93.184.216.34"), ("bad.example.com", "8.8.8.8"), ("bad.example.com", "169.254.169.254")],
        "host string, ip string")
    out = [r.reject_reason for r in web.check_redirect_urls(df, dns).orderBy("i").collect()]
    assert out == [None, "not_https", "blocked_address", "invalid_format", None, None, "too_long", "invalid_host"]


@pytest.mark.parametrize("secret", ["k", "x" * 64, "y" * 100])
def test_hmac(apply, secret):
    given = ["", "abc", "é" * 80]
    assert apply(lambda c: secure.hmac_sha256(c, secret), given) == [
        hmac.new(secret.encode(), v.encode(), hashlib.sha256).hexdigest() for v in given]


def test_hashes(apply):
    assert apply(lambda c: secure.hash_ip(c, "salt"), ["1.2.3.4"]) == [
        hashlib.sha256(b"1.2.3.4salt").hexdigest()[:16]]
    assert apply(lambda c: secure.request_fingerprint(c, F.lit(None)), ["1.2.3.4"]) == [
        hashlib.md5(b"1.2.3.4|").hexdigest()]


def test_query_params(apply):
    given = ["a=1&b=two+words&a=3&c=%C3%A9&d&e=x%3Dy=z", "", None, "a.b=1&c%20d=2&=x&bad=%zz"]
    assert apply(params.query_params, given) == [
        {"a": "3", "b": "two words", "c": "é", "d": "", "e": "x=y=z"}, {}, {}, {"a_b": "1", "c_d": "2", "bad": "%zz"}]
