import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from accesswatch.functions import endpoint as E
from accesswatch.functions import ip as I
from accesswatch.functions import temporal as T


def column(spark, values, expressions):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [tuple(r) for r in df.select(*expressions).collect()]


def test_clean_endpoint(spark):
    cases = {
        "": "", "/": "", "/a": "/a", "/a/b/c/d/": "/a/b/c/d", "/admin/users/view": "/admin/users",
        "/x/v2/y": "/x", "/p?q=/v1": "/p", "/patient/appointments/confirm": "/patient/appointments/confirm",
        "/a//": "/a",
    }
    assert column(spark, cases, [E.clean_endpoint(F.col("x"))]) == [(v,) for v in cases.values()]
    kept = column(spark, ["/admin/users/view", "/x/v2/y", "/x/v2"], [E.clean_endpoint(F.col("x"), versions_only=True)])
    assert kept == [("/admin/users/view",), ("/x",), ("/x",)]


def test_levels(spark):
    rows = column(spark, ["", "/a", "/a/b/c/d/", "a/b"], E.endpoint_levels(F.col("x")))
    assert rows == [("none",) * 3, ("a", "none", "none"), ("a", "b", "c"), ("b", "none", "none")]


def test_request_parameters(spark):
    values = [
        "/patient/records/1234?export=true&limit=1000&query=; DROP TABLE users",
        "/patient/appointments/confirm",
        "/admin/users/65?query=' OR 1=1 --",
        "/patient/records/99999999999999999999",
    ]
    assert column(spark, values, E.request_parameters(F.col("x"))) == [
        ("/patient/records", 1234, 1, 1000, "; DROP TABLE users"),
        ("/patient/appointments/confirm", None, 0, None, None),
        ("/admin/users", 65, 0, None, "' OR 1=1 --"),
        ("/patient/records", None, 0, None, None),
    ]


def test_resource_and_item_ids(spark):
    values = ["/inventory/items/4711?export=true", "/patient/records/12", "/inventory/items", "/items/x"]
    assert column(spark, values, [E.resource_id(F.col("x"))]) == [(4711,), (None,), (None,), (None,)]
    assert column(spark, values, [E.item_key(F.col("x"))]) == [("4711",), ("12",), (None,), (None,)]


def test_bad_times_are_null(spark):
    values = [None, "", "2024-13-40 00:00:00", "yesterday", "2024-01-02 03:04:05", "2024-01-02 03:04:05.000007"]
    parsed = column(spark, values, [F.unix_micros(T.parse_timestamp(F.col("x")))])
    assert [p[0] is None for p in parsed] == [True] * 4 + [False] * 2
    assert parsed[5][0] - parsed[4][0] == 7


def test_time_features(spark):
    ts = F.col("x").cast("timestamp")
    values = ["2024-01-01 05:59:59", "2024-01-01 06:00:00", "2024-01-07 21:00:00", "2024-01-07 22:00:00", None]
    rows = column(
        spark, values,
        [T.day_of_week(ts), T.is_unusual_time(ts), T.in_unusual_hours(ts, T.REPORT_HOURS), T.hour_or_default(ts)],
    )
    assert rows == [(0, 1, True, 5), (0, 0, False, 6), (6, 1, False, 21), (6, 1, True, 22), (None, 0, False, -1)]


def addresses():
    values = [
        None, "", "1.2.3", "256.1.1.1", "010.0.0.1", "not-an-ip", " 1.2.3.4", "1.2.3.4\n", "192.0.0.9", "192.0.0.10",
        "::", "::1", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4::5:6:7:8", "12345::",
        "g::", ":::", ":1", "1:", "::1.2.3.4", "1.2.3.4::", "::ffff:1.2.3", "::ffff:01.2.3.4", "::ffff:10.0.0.1",
        "::FFFF:8.8.8.8", "::ffff:100.64.0.1", "fe80::1%eth0", "fe80::1%", "2606:4700::1111",
    ]
    for block in I.PRIVATE_V4 + I.SHARED_V4 + I.PRIVATE_V6 + I.PRIVATE_V6_EXCEPT:
        net = ipaddress.ip_network(block)
        kind, top = type(net[0]), 2**net.max_prefixlen
        values += [str(kind(n)) for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1) if 0 <= n < top]
    draw = random.Random(7)
    values += [str(ipaddress.IPv4Address(draw.getrandbits(32))) for _ in range(200)]
    masks = [draw.getrandbits(128) & draw.getrandbits(128) & draw.getrandbits(128) for _ in range(200)]
    values += [str(ipaddress.IPv6Address(n)) for n in masks] + [ipaddress.IPv6Address(n).exploded for n in masks]
    return values


def test_network_class_equals_the_standard_library(spark):
    values = addresses()
    ip = F.col("x")
    rows = column(
        spark, values, [I.is_internal_ip(ip), I.is_global_ip(ip), I.is_valid_ip(ip), I.ipv4_to_long(ip), I.ipv6_to_hex(ip)]
    )
    for value, row in zip(values, rows):
        try:
            a = ipaddress.ip_address(value)
        except ValueError:
            expected = (False, False, False, None, None)
        else:
            number, digits = (int(a), None) if a.version == 4 else (None, a.packed.hex())
            expected = (a.is_private, a.is_global, True, number, digits)
        assert row == expected, value


@pytest.mark.parametrize("ip, kind", [("10.1.2.3", "Internal"), ("8.8.8.8", "External"), ("unknown", "External")])
def test_ip_class(spark, ip, kind):
    assert column(spark, [ip], [I.ip_class(F.col("x"))]) == [(kind,)]


def test_unusual_hours_within_a_day(spark):
    day = column(spark, ["2024-01-01 08:59:59", "2024-01-01 09:00:00", "2024-01-01 16:59:59", "2024-01-01 17:00:00"],
                 [T.in_unusual_hours(T.parse_timestamp(F.col("x")), (9, 17))])
    assert [v for (v,) in day] == [False, True, True, False]


def test_times_without_a_date_are_no_times(spark):
    texts = ["10:00:00", "T10:00", "2024", "2024-01-02T03:04:05Z", "2024-01-02", "", "2024-02-30"]
    found = column(spark, texts, [T.parse_timestamp(F.col("x")).cast("string")])
    assert [v for (v,) in found] == [None, None, None, "2024-01-02 03:04:05", "2024-01-02 00:00:00", None, None]
