"""Places in text counted in code points or in UTF-16 units, and whether a cited range names its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from plumbline.functions.checks import allowed_host, first_reason
from plumbline.functions.text import let

#: Fixed value: the signs that take two UTF-16 units.
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def astral_places(text: Column) -> Column:
    """The places, in code points from 0, of the signs of two units."""
    pieces = F.transform(F.split(text, ASTRAL, -1), F.length)
    ends = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, n: F.struct((s["at"] + n + 1).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out")), lambda s: s["out"])
    return F.slice(ends, 1, F.size(ends) - 1)  # the last piece has no such sign behind it


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.size(F.split(text, ASTRAL, -1)) - 1


def from_utf16(index: Column, astral: Column, length: Column) -> Column:
    """A place in UTF-16 units as one in code points; null inside a pair and outside the text."""
    ahead = F.size(F.filter(F.transform(astral, lambda p, j: p + j), lambda u: u < index))
    within = F.exists(F.transform(astral, lambda p, j: p + j + 1), lambda u: u == index)
    return F.when(~within & (index >= 0) & (index - ahead <= length), (index - ahead).cast("int"))


def to_utf16(index: Column, astral: Column) -> Column:
    return index + F.size(F.filter(astral, lambda p: p < index))


def https_host(url: Column) -> tuple[Column, Column]:
    """The host of an https address in small letters, and the reason why there is none."""
    lower = F.lower(url)
    authority = F.regexp_extract(lower, r"^https://([^/?#]*)", 1)
    host = F.regexp_replace(authority, r"\.$", "")
    reason = first_reason((~lower.startswith("https://"), "not_https"), (~host.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)*$"), "bad_host"))
    return host, reason


def placed(text: Column, url: Column, title: Column, start: Column, end: Column, hosts: Sequence[str]) -> Column:
    """struct(start, end, unit, reason) of a citation's range of text: in code points from 0, read in code points if the
    text there names the address, its host or the title, else in UTF-16 units if it does then.

    Reasons: malformed (something missing or negative), not_https, bad_host, domain_not_allowed, range_outside_text (or
    within a sign, or turned round, in both units), range_does_not_name_source."""
    host, no_host = https_host(url)
    refused = first_reason((text.isNull() | url.isNull() | title.isNull() | start.isNull() | end.isNull() | (start < 0) | (end < 0), "malformed"))
    refused = F.coalesce(refused, no_host, F.when(~allowed_host(F.concat(F.lit("https://"), host), hosts), "domain_not_allowed"))

    def within(astral: Column) -> Column:
        def of(unit: str, s: Column, e: Column) -> Column:
            ok = F.coalesce((s >= 0) & (e >= s) & (e <= F.length(text)), F.lit(False))
            span = F.lower(F.substr(text, s + 1, e - s))
            names = span.contains(F.lower(url)) | span.contains(host) | ((F.trim(title) != "") & span.contains(F.lower(F.trim(title))))
            return F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(unit).alias("unit"), ok.alias("ok"), (ok & names).alias("names"))

        units = F.array(of("code_points", start, end), of("utf16", from_utf16(start, astral, F.length(text)), from_utf16(end, astral, F.length(text))))

        def choose(found: Column) -> Column:
            best = F.get(F.filter(found, lambda u: u["names"]), F.lit(0))
            reason = F.coalesce(refused, F.when(best.isNull(), F.when(F.exists(found, lambda u: u["ok"]), "range_does_not_name_source").otherwise("range_outside_text")))
            mine = lambda c: F.when(reason.isNull(), best[c]).alias(c)
            return F.struct(mine("start"), mine("end"), mine("unit"), reason.alias("reason"))

        return let(units, choose)

    return let(astral_places(text), within)
