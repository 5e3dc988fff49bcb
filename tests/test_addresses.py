"""Addresses against the standard library; HMAC against the standard library; chains of proxies."""

import hashlib
import hmac
import ipaddress
import random
from datetime import datetime

import pyspark.sql.functions as F
import pytest

from landsift.functions import addresses as A
from landsift.functions.scalars import hmac_sha256
from landsift.operators import intake

ODD = ["", " ", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4 ", "\t1.2.3.4\n", "::", ":::", "1::2::3", "::1", "1::", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:7:8:9", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "fe80::1%eth0", "::ffff:1.2.3.4", "::FFFF:0a01:0203", "::1.2.3.4", "::1.2.3.256", "::01.2.3.4", "1.2.3.4::", "12345::", "g::", "2001:DB8:0:0:1:0:0:1", "0:0:1::", "::ffff:0:0", "1:0:0:2:0:0:0:3", "0:1:0:1:0:1:0:1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "x", "1.2.3.4:80", "[::1]"]


def normal(text):
    if text is None or "%" in text:
        return None
    try:
        a = ipaddress.ip_address(text.strip())
    except ValueError:
        return None
    return str(getattr(a, "ipv4_mapped", None) or a)


def some():
    r = random.Random(7)
    for _ in range(1500):
        words = [r.choice([0, 0, 0, 1, 0xFFFF, r.randrange(65536)]) for _ in range(8)]
        a = ipaddress.IPv6Address(sum(w << (112 - 16 * k) for k, w in enumerate(words)))
        yield r.choice([str(a), a.exploded, str(a).upper(), ":".join(f"{w:x}" for w in words)])
        yield str(ipaddress.IPv4Address(r.randrange(2**32)))


def test_normal_text_is_that_of_the_standard_library(spark):
    texts = [None, *ODD, *some()]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.normal(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [(t, normal(t)) for t in texts]


@pytest.mark.parametrize("network", ["10.0.0.0/8", "192.168.1.128/25", "0.0.0.0/0", "2001:db8::/32", "2001:db8:8000::/33", "::/0", "::1/128", "1.2.3.4/32"])
def test_networks(spark, network):
    net = ipaddress.ip_network(network)
    near = [str(net[0]), str(net[-1]), "1.2.3.4", "::1", "2001:db8:7fff::", "2001:db9::", "192.168.1.127", "11.0.0.0"]
    got = spark.createDataFrame([(t,) for t in [*near, None, "x"]], "t string").select("t", A.within(A.words(F.col("t")), net).alias("x")).collect()
    assert {r.t: r.x for r in got} == {t: ipaddress.ip_address(t) in net for t in near} | {None: False, "x": False}


def plain_client(peer, forwarded, networks):
    trusted = lambda a: any(ipaddress.ip_address(a) in n for n in networks)
    now = own = normal(peer) or "0.0.0.0"
    if not trusted(own) or forwarded is None or len(forwarded) > 2048:
        return own
    for raw in reversed(forwarded.split(",")):
        if not trusted(now):
            break
        now = normal(raw)
        if now is None:
            return own
    return now


def test_chains_of_proxies(spark):
    r = random.Random(5)
    places = ["10.1.1.1", "::ffff:10.2.2.2", "fd00::5", " FD00:0:0::6 ", "8.8.8.8", "2001:DB8::1", "junk", "", "fe80::1%0", "0.0.0.0"]
    rows = [(r.choice(places), ",".join(r.choice(places[: r.choice([4, 10])]) for _ in range(r.randrange(1, 5)))) for _ in range(400)] + [("10.1.1.1", None), (None, "8.8.8.8"), ("10.1.1.1", "8.8.8.8," + "10.1.1.1," * 300 + "10.1.1.1")]
    trusted = [("10.0.0.0", 8), ("fd00::", 8)]
    networks = [ipaddress.ip_network(f"{a}/{b}") for a, b in trusted]
    got = spark.createDataFrame(rows, "p string, f string").select("p", "f", intake.client_address(F.col("p"), F.col("f"), trusted).alias("c")).collect()
    assert [(x.p, x.f, x.c) for x in got] == [(p, f, plain_client(p, f, networks)) for p, f in rows]


@pytest.mark.parametrize("secret", [b"k", b"s" * 64, b"long" * 40, bytes(range(64))])
def test_hmac(spark, secret):
    texts = ["", "a", "é" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(hmac_sha256(secret, F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [hmac.new(secret, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_client_keys_are_told_by_hour_route_and_address(spark):
    secret = b"0123456789abcdef0123456789abcdef"
    rows = spark.createDataFrame([(datetime(2024, 5, 6, 7, 59, 59), "watch", "::1")], "at timestamp, r string, a string")
    got = rows.select(intake.client_key(secret, F.col("at"), F.col("r"), F.col("a")).alias("k"), F.col("at").cast("long").alias("s")).first()
    want = datetime.fromtimestamp(got.s // 3600 * 3600, __import__("datetime").UTC).isoformat()
    assert got.k == hmac.new(secret, f"{want}|watch|::1".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError, match="short"):
        intake.client_key(b"short", F.col("at"), F.col("r"), F.col("a"))
