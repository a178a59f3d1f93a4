"""Registered functions, sensors, and the guarded fetch source."""

import math

import pytest

from crawlight.functions.register import register
from crawlight.plans import sensors
from crawlight.sources import fetching
from tests.conftest import DATA


def test_registered_functions(spark):
    register(spark)
    row = spark.sql("select detect_currency('€5') as c, billing_interval('$5/mo') as i, normalize_price('€1.250,50') as p, normalize_price('none') as q, classify_page('https://a.b/fr/shop/x') as t, classify_page('https://a.b/') as h, robots_octets('/%7ea') as o, zlib_ratio('') as z").first()
    assert (row.c, row.i, row.p, row.q, row.t, row.h, row.o, row.z) == ("EUR", "month", "1250.50", None, "product_detail", "homepage", "/~a", 0.0)
    assert math.isclose(spark.sql("select token_entropy(n) as e from values (1), (1), (2) as t(n)").first().e, 1.5)
    rows = spark.sql("select * from html_tokens('<p>a<br/></p>')").collect()
    assert [(r.kind, r.tag) for r in rows] == [("start", "p"), ("text", ""), ("start", "br"), ("end", "p")]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("sensor", ["corroboration", "engagement"])
def test_sensor_payloads(spark, sensor):
    out = sensors.payload(spark, str(DATA), sensor)
    assert out.columns == ["sensor", "rule", "finding"] and out.count() > 0


@pytest.mark.parametrize("address", ["10.0.0.1", "127.0.0.1", "169.254.169.254", "::1", "::ffff:192.168.0.1", "224.0.0.1", "100.64.0.1"])
def test_private_addresses_are_not_public(address):
    assert not fetching.is_public(address)


@pytest.mark.parametrize("url", ["file:///etc/passwd", "http://127.0.0.1/", "http://localhost:1/", "ftp://a.b/", "http://[::1]/"])
def test_unsafe_fetches_are_refused(url):
    row = fetching.fetch(url, "test")
    assert row[2] is None and "unsafe" in row[5]


def test_public_address_and_bounds(monkeypatch):
    import zlib

    assert fetching.is_public("8.8.8.8")
    monkeypatch.setattr(fetching, "MOST_BYTES", 100)
    assert len(fetching.unpacked(zlib.compress(b"x" * 10_000), "deflate")) == 100


def test_fetch_source_reports_errors(spark):
    spark.dataSource.register(fetching.FetchSource)
    rows = spark.read.format("guarded_fetch").option("urls", "http://127.0.0.1/ file:///x").load().collect()
    assert len(rows) == 2 and all(r.status is None and "unsafe" in r.error for r in rows)


def test_names_exist():
    """Names that functions look up when they run exist in their module."""
    import builtins
    import dis
    import importlib
    import pkgutil
    from types import CodeType

    import crawlight

    def missing(code, known):
        for i in dis.get_instructions(code):
            if i.opname == "LOAD_GLOBAL" and i.argval not in known and not hasattr(builtins, i.argval):
                yield code.co_name, i.argval
        for inner in code.co_consts:
            if isinstance(inner, CodeType):
                yield from missing(inner, known)

    for m in pkgutil.walk_packages(crawlight.__path__, "crawlight."):
        module = importlib.import_module(m.name)
        with open(module.__file__) as file:
            assert not list(missing(compile(file.read(), module.__file__, "exec"), vars(module))), m.name
