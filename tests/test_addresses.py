"""Addresses against ranges, held against the standard library."""

import ipaddress
import random

from exposa.functions import fixed
from exposa.operators import addresses as AD


def brute(hosts, cidrs, mapped=False):
    out = set()
    for h in hosts:
        try:
            a = ipaddress.ip_address(h)
        except ValueError:
            continue
        forms = [a] + ([a.ipv4_mapped] if mapped and a.version == 6 and a.ipv4_mapped else [])
        out |= {(h, c) for c in cidrs for f in forms if f in ipaddress.ip_network(c, strict=False)}
    return out


def found(spark, hosts, cidrs, **options):
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    return {tuple(r) for r in AD.in_ranges(df, "host", AD.ranges(spark, cidrs), **options).collect()}


HOSTS = ["10.0.0.1", "9.255.255.255", "11.0.0.0", "127.0.0.1", "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.168.1.1",
         "169.254.169.254", "8.8.8.8", "::1", "::", "::2", "fc00::1", "fdff::", "fe80::1", "febf:ffff::1", "fec0::1", "2001:db8::1", "1::", "FE80::ABCD",
         "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:c0a8:0101", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "1::8", "1:2:3:4:5:6:7::",
         # no addresses
         "example.com", "10.0.0", "10.0.0.256", "1:2:3:4:5:6:7", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", ":1", "1:", "", "12345::", "1:2:3:4:5:6:7:8::", "a.b.c.d"]


def test_the_nine_ranges(spark):
    assert found(spark, HOSTS, fixed.PRIVATE_RANGES) == brute(HOSTS, fixed.PRIVATE_RANGES)


def test_mapped_addresses(spark):
    assert found(spark, HOSTS, fixed.PRIVATE_RANGES, mapped=True) == brute(HOSTS, fixed.PRIVATE_RANGES, True)
    assert ("::ffff:10.0.0.1", "10.0.0.0/8") in found(spark, HOSTS, fixed.PRIVATE_RANGES, mapped=True)


def test_random_ranges(spark):
    r = random.Random(3)
    hosts = list({str(ipaddress.IPv4Address(r.getrandbits(32) >> r.randrange(24))) for _ in range(200)}
                 | {str(ipaddress.IPv6Address(r.getrandbits(128) >> r.randrange(120))) for _ in range(200)}
                 | {h for h in HOSTS})
    cidrs = [f"{ipaddress.IPv4Address(r.getrandbits(32) >> r.randrange(24))}/{r.randrange(33)}" for _ in range(80)]
    cidrs += [f"{ipaddress.IPv6Address(r.getrandbits(128) >> r.randrange(120))}/{r.randrange(129)}" for _ in range(80)]
    cidrs += ["0.0.0.0/0", "::/0", "10.0.0.1", "::1"]
    assert found(spark, hosts, list(dict.fromkeys(cidrs))) == brute(hosts, cidrs)


def test_no_ranges_and_bad_ones(spark):
    assert found(spark, HOSTS, ["10.0.0.0/33", "nonsense", "10.0.0.0/x", "10.0.0.0/-1"]) == set()
    assert AD.in_ranges(spark.createDataFrame([], "host string"), "host", AD.ranges(spark)).collect() == []
