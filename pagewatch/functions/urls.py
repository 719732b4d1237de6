"""URL parsing and normalisation as Column expressions.

Follows the parts of the URL standard that decide whether two addresses are
the same: case of scheme and host, percent-encoded hosts, spellings of IPv4
addresses, default ports, dot segments and percent encoding. International
host names are lower-cased, not converted to punycode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewatch.functions.text import let, replace_regex

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
OTHER_SCHEME = r"^(?!(?i:https?):)[A-Za-z][A-Za-z0-9+.-]*:"
# Groups: scheme, user info with @, host, port, path, query, fragment.
HTTP_URL = (
    r"(?is)^(https?):[/\\]*([^/\\?#]*@)?"
    r"(\[[0-9a-f:.]+\]|[^\s/\\?#@:<>\[\]^|\x00-\x20\x7f]+)"
    r"(?::0*([0-9]*))?((?:[/\\][^?#]*)?)(\?[^#]*)?(#.*)?\z"
)
# Characters that no decoded host may hold, and hosts that must be IPv4 addresses.
NOT_IN_HOST = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f\uFFFD]"
ENDS_IN_NUMBER = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z"
# First digits, pattern and base of an address part; longer numbers are beyond 32 bits.
NUMBER_FORMS = (
    (r"^0x0*", r"^0x0*[0-9a-f]{0,8}\z", 16),
    (r"^0+", r"^0+[0-7]{0,11}\z", 8),
    (r"^", r"^[1-9][0-9]{0,9}\z", 10),
)
DOT_SEGMENT = r"(?i)/(?:\.|%2e){1,2}(?:/|\z)"

# Characters each URL part must percent-encode.
ENCODE_IN_PATH = r"[^\x21\x24-\x3B\x3D\x40-\x5D\x5F\x61-\x7A\x7C\x7E]"
ENCODE_IN_QUERY = r"[^\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E]"
ENCODE_IN_FRAGMENT = r"[^\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7E]"


def _clean(url: Column) -> Column:
    """Drop what a URL parser ignores: outer blanks and control characters, inner tabs and newlines."""
    outer = replace_regex(url, r"^[\x00-\x20]+|[\x00-\x20]+\z")
    return F.translate(outer, "\t\n\r", "")


def _part(cleaned: Column, group: int) -> Column:
    return F.regexp_extract(cleaned, HTTP_URL, group)


def _decoded_host(host: Column) -> Column:
    """Lower-case host without percent encoding, null if it then holds what no host may."""
    plain = F.lower(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))))
    decoded = let(plain, lambda h: F.when(~h.rlike(NOT_IN_HOST) & (h != ""), h))
    return F.when(host.contains("%"), decoded).otherwise(F.lower(host))


def _address_part(part: Column) -> Column:
    """Number of a hexadecimal, octal or decimal part, null if it is none or too long."""
    number = F.lit(None).cast("long")
    for first, form, base in reversed(NUMBER_FORMS):
        digits = F.concat(F.lit("0"), F.regexp_replace(part, first, ""))
        number = F.when(part.rlike(form), F.conv(digits, base, 10).cast("long")).otherwise(number)
    return number


def _ipv4(host: Column) -> Column:
    """Dotted spelling of an address of up to four parts, whose last one fills all bytes left; null if it does not fit."""
    def dotted(numbers: Column) -> Column:
        count = F.size(numbers)
        before = F.slice(numbers, 1, count - 1)
        room = F.pow(F.lit(256), 5 - count).cast("long")
        last = F.element_at(numbers, -1)
        fits = (count <= 4) & F.forall(numbers, lambda n: n.isNotNull()) & F.forall(before, lambda n: n < 256)
        high = F.aggregate(before, F.lit(0).cast("long"), lambda kept, n: kept * 256 + n)
        spelled = let(
            high * room + last,
            lambda v: F.concat_ws(".", *[F.shiftright(v, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]),
        )
        return F.when(fits, F.when(last < room, spelled))

    parts = F.split(F.regexp_replace(host, r"\.\z", ""), r"\.")
    return let(F.transform(parts, _address_part), dotted)


def _host(cleaned: Column) -> Column:
    """Host as a parser spells it, null if it is none."""
    return let(
        _decoded_host(_part(cleaned, 3)),
        lambda h: F.when(h.rlike(ENDS_IN_NUMBER), _ipv4(h)).otherwise(h),
    )


def _is_http(cleaned: Column) -> Column:
    port = _part(cleaned, 4)  # without leading zeros
    port_fits = (F.length(port) < 5) | ((F.length(port) == 5) & (port <= "65535"))
    return F.coalesce(cleaned.rlike(HTTP_URL) & port_fits & _host(cleaned).isNotNull(), F.lit(False))


def _has_other_scheme(cleaned: Column) -> Column:
    return F.coalesce(cleaned.rlike(OTHER_SCHEME), F.lit(False))


def is_http_url(url: Column) -> Column:
    """Absolute http or https URL with a plausible host and port."""
    return let(_clean(url), _is_http)


def is_any_url(url: Column) -> Column:
    """Anything with a scheme; only http and https must also have a host."""
    return let(_clean(url), lambda c: _is_http(c) | _has_other_scheme(c))


def url_host(url: Column) -> Column:
    """Lower-case host of an http(s) URL, null if the URL is not valid."""
    return let(_clean(url), lambda c: F.when(_is_http(c), _host(c)))


def url_path(url: Column) -> Column:
    """Path of an http(s) URL, at least `/`, null if the URL is not valid."""
    return let(_clean(url), lambda c: F.when(_is_http(c), _resolved_path(_part(c, 5))))


def is_home_page(url: Column) -> Column:
    return F.coalesce(url_path(url) == "/", F.lit(False))


def _percent_encode(text: Column, needs_encoding: str) -> Column:
    """Encode the listed characters one by one; a text without any is passed through."""
    def encoded(char: Column) -> Column:
        escaped = F.replace(F.url_encode(char), F.lit("+"), F.lit("%20"))
        return F.when(char.rlike(needs_encoding), escaped).otherwise(char)

    def whole(value: Column) -> Column:
        characters = F.transform(F.split(value, ""), encoded)
        return F.when(value.rlike(needs_encoding), F.array_join(characters, "")).otherwise(value)

    return let(text, whole)


def _resolve_dots(path: Column) -> Column:
    """Remove `.` and `..` segments; the last one leaves its slash behind."""
    def step(kept: Column, segment: Column) -> Column:
        plain = replace_regex(F.lower(segment), "%2e", ".")
        return (
            F.when(plain == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(plain == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    segments = F.split(F.substring(path, 2, 2147483647), "/")
    kept = F.aggregate(segments, F.expr("cast(array() as array<string>)"), step)
    ends_in_dots = path.rlike(r"(?i)/(?:\.|%2e){1,2}\z")
    return let(
        F.concat(F.lit("/"), F.array_join(kept, "/")),
        lambda joined: F.when(
            ends_in_dots & (joined != "/"), F.concat(joined, F.lit("/"))
        ).otherwise(joined),
    )


def _resolved_path(path: Column) -> Column:
    def resolved(slashed: Column) -> Column:
        return (
            F.when(slashed == "", F.lit("/"))
            .when(slashed.rlike(DOT_SEGMENT), _resolve_dots(slashed))
            .otherwise(slashed)
        )

    return let(F.replace(path, F.lit("\\"), F.lit("/")), resolved)


def normalize_url(url: Column) -> Column:
    """Canonical spelling of an absolute URL, null if it cannot be parsed."""
    def http_href(cleaned: Column) -> Column:
        scheme = F.lower(_part(cleaned, 1))
        given = F.regexp_extract(cleaned, r"(?is)^https?:[/\\]*(?:[^/\\?#]*@)?(?:\[[^\]]*\]|[^/\\?#:]+):([0-9]+)", 1)
        port = F.when((_part(cleaned, 4) == "") & (given != ""), F.lit("0")).otherwise(_part(cleaned, 4))
        default = F.when(scheme == "http", F.lit("80")).otherwise(F.lit("443"))
        return F.concat(
            scheme,
            F.lit("://"),
            _part(cleaned, 2),
            _host(cleaned),
            F.when((port == "") | (port == default), F.lit("")).otherwise(
                F.concat(F.lit(":"), port)
            ),
            _percent_encode(_resolved_path(_part(cleaned, 5)), ENCODE_IN_PATH),
            _percent_encode(_part(cleaned, 6), ENCODE_IN_QUERY),
            _percent_encode(_part(cleaned, 7), ENCODE_IN_FRAGMENT),
        )

    def other_href(cleaned: Column) -> Column:
        scheme = F.regexp_extract(cleaned, SCHEME, 0)
        return F.concat(F.lower(scheme), F.substr(cleaned, F.length(scheme) + 1))

    return let(
        _clean(url),
        lambda c: F.when(_is_http(c), http_href(c)).when(_has_other_scheme(c), other_href(c)),
    )
