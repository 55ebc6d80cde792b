import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tilequery.functions import signing as s
from tilequery.operators import views

PARAMS = "array<struct<k:string,v:string>>"


def one(spark, f, path, params, **more):
    df = spark.createDataFrame([(path, params)], f"path string, params {PARAMS}")
    return df.select(f(F.col("path"), F.col("params"), **more).alias("x")).first()[0]


def mac(message, key="k"):
    return hmac.new(key.encode(), message.encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("key", ["k", "x" * 100])
def test_signature_matches_hmac(spark, key):
    got = one(spark, lambda p, q: s.sign(key, p, q, F.lit(99)), "/tiles/a", [("quality", "80"), ("a", "b c")])
    assert got == mac("/tiles/a?a=b c&exp=99&quality=80", key)


def decide(spark, params, path="/tiles/folder%2Fs.svs/0/1/2.jpg", now=50):
    return one(spark, lambda p, q: s.access_decision("k", p, q, F.lit(now)), path, params)


def test_decisions(spark):
    path = "/tiles/folder%2Fs.svs/0/1/2.jpg"
    good = mac(f"{path}?exp=99&quality=80")
    ok = [("quality", "80"), ("exp", "99"), ("sig", good)]
    assert decide(spark, ok) is None
    assert decide(spark, ok, now=99) is None and decide(spark, ok, now=100) == "signature_expired"
    assert decide(spark, [("quality", "81"), *ok[1:]]) == "invalid_signature"
    assert decide(spark, ok, path="/tiles/other/0/1/2.jpg") == "invalid_signature"
    assert decide(spark, [("exp", "99"), ("sig", "zz")]) == "invalid_signature_format"
    assert decide(spark, [("exp", "99")]) == "missing_signature"
    assert decide(spark, [("sig", good)]) == "missing_expiry" and decide(spark, []) == "missing_expiry"
    assert decide(spark, [*ok, ("sig", good)]) == "invalid_signature_format"
    assert decide(spark, [("exp", "x"), ("sig", "a"), ("sig", "b")]) == "invalid_expiry_format"
    assert decide(spark, [("exp", "99"), ("exp", "99")]) == "invalid_expiry_format"
    token = mac("viewer:folder/s.svs:99")
    assert decide(spark, [("exp", "99"), ("vt", token)]) is None
    assert decide(spark, [("exp", "99"), ("vt", token)], path="/slides") == "missing_signature"
    assert decide(spark, [("exp", "99"), ("vt", token[::-1])]) == "invalid_signature"


@pytest.mark.parametrize("path,want", [("/tiles/folder%2Fsample.svs/0/1/2.jpg", "folder/sample.svs"), ("/slides/a+b", "a+b"), ("/health", None), ("/view/x", None), ("", None)])
def test_slide_of_path(spark, path, want):
    assert spark.range(1).select(s.slide_id_of_path(F.lit(path))).first()[0] == want


def test_signed_url(spark):
    df = spark.createDataFrame([("/tiles/a", [("q", "a b")])], f"path string, params {PARAMS}")
    r = views.sign_urls(df, "k", now=10, ttl=5, base="http://h/").first()
    assert r.url == f"http://h/tiles/a?q=a+b&exp=15&sig={r.sig}" and r.sig == mac("/tiles/a?exp=15&q=a b")


def test_plain_url_and_presence(spark):
    df = spark.createDataFrame([("/tiles/a", [("q", "a b")])], f"path string, params {PARAMS}")
    assert views.plain_urls(df, "k", now=10, ttl=5).first().url.startswith("/tiles/a?q=a b&exp=15&sig=")
    got = spark.createDataFrame([("sig=1&exp=2",), ("exp=2",), (None,)], "q string").select(s.has_signature(F.col("q"))).collect()
    assert [r[0] for r in got] == [True, False, False]
