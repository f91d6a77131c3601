"""URL columns: domain, clipping, normal form, percent-encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.binding import let, with_groups

# Parameters and digits of Punycode (RFC 3492), codes of characters that need no escape (RFC 3986).
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
UNRESERVED = "^(2D|2E|5F|7E|3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])$"


def derive_domain(url: Column, base: Column | None = None, strict: bool = False) -> Column:
    """Authority of a URL; a bare host counts, a relative path takes ``base``'s domain.

    A missing URL, or a relative one without a usable base, is null, or an error
    when ``strict``.
    """
    domain = _own_domain(url)
    if base is not None:
        domain = F.when(_is_relative(url), _own_domain(base)).otherwise(domain)
    if strict:
        reason = F.concat(F.lit("Invalid URL: "), F.coalesce(url, F.lit("null")))
        domain = F.coalesce(domain, F.raise_error(reason).cast("string"))
    return domain


def _is_relative(url: Column) -> Column:
    return url.startswith("/") & ~F.regexp_like(url, F.lit("^//[^/?#]"))


def _own_domain(url: Column) -> Column:
    with_scheme = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]+)", 1)
    bare = F.when(~url.startswith("/") & (url != ""), F.substring_index(url, "/", 1))
    return F.coalesce(F.nullif(with_scheme, F.lit("")), F.nullif(bare, F.lit("")))


def clip_url(url: Column) -> Column:
    """Host and path: no scheme, no leading ``www.``, no query, no single final ``/``."""
    out = F.regexp_replace(url, r"^https?://", "")
    out = F.regexp_replace(out, r"^www\.", "")
    out = F.regexp_replace(out, r"\?[\s\S]*$", "")
    return F.regexp_replace(out, r"/\z", "")


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot segments: ``.`` vanishes, ``..`` takes its parent along."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc)
        .when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    trailing = F.regexp_like(path, F.lit(r"/\.{1,2}\z"))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(trailing & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def _whole(value: Column) -> Column:
    return F.floor(value).cast("bigint")


def _adapted(delta: Column, length: Column, first: Column) -> Column:
    """The bias after a delta. Each division by 35 is a round; a name of 63 letters needs 4 at most."""
    start = F.when(first, _whole(delta / DAMP)).otherwise(_whole(delta / 2))
    limit, step = (BASE - T_MIN) * T_MAX // 2, BASE - T_MIN
    rounds = F.aggregate(
        F.sequence(F.lit(1), F.lit(6)),
        F.struct(_whole(start + _whole(start / length)).alias("d"), F.lit(0).cast("bigint").alias("k")),
        lambda acc, _: F.struct(
            F.when(acc["d"] > limit, _whole(acc["d"] / step)).otherwise(acc["d"]).alias("d"),
            F.when(acc["d"] > limit, acc["k"] + BASE).otherwise(acc["k"]).alias("k"),
        ),
    )
    return let(rounds, lambda r: r["k"] + _whole((step + 1) * r["d"] / (r["d"] + SKEW)))


def _digits(delta: Column, bias: Column) -> Column:
    """A delta as digits whose value depends on their place."""
    def digit(acc: Column, place: Column) -> Column:
        t = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), BASE * place - bias)).cast("bigint")
        last = acc["q"] < t
        value = F.when(last, acc["q"]).otherwise(t + F.pmod(acc["q"] - t, BASE - t))
        char = F.substring(F.lit(DIGITS), (value + 1).cast("int"), F.lit(1))
        return F.when(~acc["open"], acc).otherwise(F.struct(
            F.when(last, acc["q"]).otherwise(_whole((acc["q"] - t) / (BASE - t))).alias("q"),
            F.concat(acc["out"], char).alias("out"), (~last).alias("open"),
        ))

    start = F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(True).alias("open"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, digit, lambda acc: acc["out"])


def _punycode(label: Column) -> Column:
    """A label with letters beyond ASCII in its ASCII form (RFC 3492).

    Those letters are taken in the order of code and place; what is written for each is how far its code and
    the place it is put in are from those of the letter before, in the name built so far.
    """
    letters = F.filter(F.split(label, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.ascii(c).cast("bigint"))

    def encoded(codes: Column) -> Column:
        n_basic = F.size(F.filter(codes, lambda c: c < FIRST_CODE)).cast("bigint")
        others = F.array_sort(F.filter(
            F.transform(codes, lambda c, i: F.struct(c.alias("code"), i.alias("at"))), lambda e: e["code"] >= FIRST_CODE
        ))

        def put(acc: Column, letter: Column) -> Column:
            place = F.size(F.filter(F.slice(codes, F.lit(1), letter["at"]), lambda c: c <= letter["code"])).cast("bigint")
            delta = (letter["code"] - acc["code"]) * (acc["length"] + 1) + place - acc["place"]
            return let(F.struct(delta.alias("d"), place.alias("p")), lambda now: F.struct(
                letter["code"].alias("code"), (now["p"] + 1).alias("place"), (acc["length"] + 1).alias("length"),
                _adapted(now["d"], acc["length"] + 1, acc["length"] == n_basic).alias("bias"),
                F.concat(acc["out"], _digits(now["d"], acc["bias"])).alias("out"),
            ))

        start = F.struct(
            F.lit(FIRST_CODE).cast("bigint").alias("code"), F.lit(0).cast("bigint").alias("place"), n_basic.alias("length"),
            F.lit(FIRST_BIAS).cast("bigint").alias("bias"), F.lit("").alias("out"),
        )
        return F.aggregate(others, start, put, lambda acc: acc["out"])

    basic = F.regexp_replace(label, r"[^\x00-\x7F]", "")
    return F.concat(F.lit("xn--"), basic, F.when(basic != "", F.lit("-")).otherwise(F.lit("")), let(codes, encoded))


def ascii_host(host: Column) -> Column:
    """Host in lower case, its labels with letters beyond ASCII written ``xn--``.

    Letters stay what they are (the rules of 2008: no folding of sharp s); they are not composed.
    """
    low = F.lower(host)
    dotted = F.translate(low, "\u3002\uff0e\uff61", "...")
    labels = F.transform(F.split(dotted, r"\.", -1), lambda v: F.when(F.rlike(v, F.lit(r"[^\x00-\x7F]")), _punycode(v)).otherwise(v))
    return F.when(F.rlike(low, F.lit(r"[^\x00-\x7F]")), F.array_join(labels, ".")).otherwise(low)


def normal_escapes(text: Column) -> Column:
    """Percent-escapes in their one normal form (RFC 3986).

    Escapes of letters, digits and ``-._~`` are undone, others written in capitals; a ``%`` that begins none, blanks
    and what is beyond ASCII is escaped. Reserved characters stay as they are, escaped or not: those differ.
    """
    def piece(p: Column) -> Column:
        code, rest = F.upper(F.substring(p, 1, 2)), F.substring(p, F.lit(3), F.length(p))
        return (
            F.when(~F.rlike(p, F.lit("^[0-9A-Fa-f]{2}")), F.concat(F.lit("%25"), p))
            .when(F.rlike(code, F.lit(UNRESERVED)), F.concat(F.char(F.conv(code, 16, 10).cast("bigint")), rest))
            .otherwise(F.concat(F.lit("%"), code, rest))
        )

    pieces = F.transform(F.split(text, "%", -1), lambda p, i: F.when(i == 0, p).otherwise(piece(p)))
    escaped = lambda c: F.when(F.rlike(c, F.lit("^[!-~]*$")), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))
    return F.when(~F.rlike(text, F.lit("%|[^!-~]")), text).otherwise(
        F.array_join(F.transform(F.split(F.array_join(pieces, ""), ""), escaped), "")
    )


_URL = (
    r"\A([A-Za-z][A-Za-z0-9+.\-]*)://((?:[^/?#]*@)?)([^/?#@]*)([^?#]*)((?:\?[^#]*)?)((?:#[\s\S]*)?)\z"
)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, at least ``/``, no dot segments; host in ASCII, normal escapes."""
    full = F.when(F.regexp_like(url, F.lit("^[A-Za-z][A-Za-z0-9+.\\-]*://")), url).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(url, "^//", ""))
    )

    def build(parts: list[Column]) -> Column:
        scheme, user, host, path, query, fragment = parts
        scheme, host = F.lower(scheme), ascii_host(host)
        path, query, fragment = normal_escapes(path), normal_escapes(query), normal_escapes(fragment)
        host = (
            F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", ""))
            .when(scheme == "https", F.regexp_replace(host, ":(443)?$", ""))
            .otherwise(F.regexp_replace(host, ":$", ""))
        )
        clean = (
            F.when(F.contains(path, F.lit("/.")), _remove_dot_segments(path))
            .when(path == "", F.lit("/"))
            .otherwise(path)
        )
        return F.concat(scheme, F.lit("://"), user, host, clean, query, fragment)

    return with_groups(F.nullif(full, F.lit("https://")), _URL, 6, build)


def resolve_link(link: Column, page_url: Column) -> Column:
    """Absolute form of a link found on a page."""
    scheme = F.regexp_extract(page_url, "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1)
    origin = F.regexp_extract(page_url, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(page_url, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(?:/[^?#]*)?/)", 1)
    return (
        F.when(F.regexp_like(link, F.lit("^[A-Za-z][A-Za-z0-9+.\\-]*:")), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.isNotNull(), F.concat(F.coalesce(F.nullif(folder, F.lit("")), origin), link))
    )


def url_quote(text: Column) -> Column:
    """Percent-encode everything but letters, digits and ``_.-~/``."""
    out = F.url_encode(text)
    for encoded, plain in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out
