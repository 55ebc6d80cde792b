"""Request signing and the access decision, of built-in expressions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_U64 = 18_446_744_073_709_551_615


def canonical_query(params: Column) -> Column:
    """params: array<struct<k,v>>. Sorted bytewise by (k, v), joined as k=v with &, not percent-encoded."""
    return F.array_join(F.transform(F.sort_array(params), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def signature_base(path: Column, params: Column, expiry: Column) -> Column:
    own = F.array(F.struct(F.lit("exp").alias("k"), expiry.cast("string").alias("v")))
    return F.concat(path, F.lit("?"), canonical_query(F.concat(F.coalesce(params, F.array().cast("array<struct<k:string,v:string>>")), own)))


def hmac_sha256(secret: str, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256; the padded keys are constants of the plan."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)


def sign(secret: str, path: Column, params: Column, expiry: Column) -> Column:
    return hmac_sha256(secret, signature_base(path, params, expiry))


def viewer_token(secret: str, slide_id: Column, expiry: Column) -> Column:
    return hmac_sha256(secret, F.concat(F.lit("viewer:"), slide_id, F.lit(":"), expiry.cast("string")))


def signed_url(base: str, secret: str, path: Column, params: Column, expiry: Column) -> Column:
    """Form-encoded parameters, then exp and sig."""
    pairs = F.transform(F.coalesce(params, F.array().cast("array<struct<k:string,v:string>>")), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"])))
    tail = F.array(F.concat(F.lit("exp="), expiry.cast("string")), F.concat(F.lit("sig="), sign(secret, path, params, expiry)))
    return F.concat(F.lit(base.rstrip("/")), path, F.lit("?"), F.array_join(F.concat(pairs, tail), "&"))


def verify(secret: str, path: Column, signature: Column, expiry: Column, params: Column, now: Column) -> Column:
    """Null if valid, else the error. A time equal to the expiry is still valid."""
    return (
        F.when(now > expiry, "signature_expired")
        .when(~signature.rlike(r"^([0-9a-fA-F]{2})*\z"), "invalid_signature_format")
        .when(F.lower(signature) != sign(secret, path, params, expiry), "invalid_signature")
    )


def slide_id_of_path(path: Column) -> Column:
    """The segment after /tiles or /slides, percent-decoded; a plus sign stays one."""
    parts = F.split(path, "/")
    second = F.get(parts, F.lit(2))
    known = F.get(parts, F.lit(1)).isin("tiles", "slides") & second.isNotNull()
    return F.when(known, F.try_url_decode(F.replace(second, F.lit("+"), F.lit("%2B"))))


def access_decision(secret: str, path: Column, params: Column, now: Column) -> Column:
    """Null if the request may pass, else the error. params: all query parameters, array<struct<k,v>>.

    Parameters are read in order: a repeated sig or vt is a malformed signature, a repeated
    or non-numeric exp a malformed expiry. A missing expiry is reported before a missing
    signature; a viewer token counts where the path names a slide.
    """

    def number(text: Column) -> Column:
        digits = F.when(text.rlike(r"^\+?[0-9]+\z"), F.regexp_replace(text, r"^\+?0*(?=[0-9])", ""))
        wide = F.when(F.length(digits) <= 20, digits).try_cast("decimal(20,0)")
        return F.when(wide <= F.lit(str(MAX_U64)).cast("decimal(20,0)"), wide)

    def fault(p: Column, i: Column) -> Column:
        again = F.exists(F.slice(params, F.lit(1), i), lambda q: q["k"] == p["k"])
        return (
            F.when(p["k"].isin("sig", "vt") & again, "invalid_signature_format")
            .when((p["k"] == "exp") & (again | number(p["v"]).isNull()), "invalid_expiry_format")
        )

    of = lambda k: F.get(F.transform(F.filter(params, lambda p: p["k"] == k), lambda p: p["v"]), F.lit(0))
    malformed = F.get(F.filter(F.transform(params, fault), lambda x: x.isNotNull()), F.lit(0))
    exp, slide = number(of("exp")), slide_id_of_path(path)
    rest = F.filter(params, lambda p: ~p["k"].isin("sig", "exp", "vt"))
    by_token = of("vt").isNotNull() & slide.isNotNull()
    given = F.when(by_token, of("vt")).otherwise(of("sig"))
    wanted = F.when(by_token, viewer_token(secret, slide, exp)).otherwise(sign(secret, path, rest, exp))
    return (
        F.when(malformed.isNotNull(), malformed)
        .when(exp.isNull(), "missing_expiry")
        .when(given.isNull(), "missing_signature")
        .when(now > exp, "signature_expired")
        .when(~given.rlike(r"^([0-9a-fA-F]{2})*\z"), "invalid_signature_format")
        .when(F.lower(given) != wanted, "invalid_signature")
    )


def has_signature(query: Column) -> Column:
    """Whether a raw query string carries a signature at all."""
    return F.coalesce(F.contains(query, F.lit("sig=")) & F.contains(query, F.lit("exp=")), F.lit(False))
