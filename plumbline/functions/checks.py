"""Guards on values and payloads, as predicates and reason codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The code of the first case that holds, or null."""
    out = F.lit(None).cast("string")
    for condition, code in reversed(cases):
        out = F.when(condition, code).otherwise(out)
    return out


def structured_payload(fields: Column, total: int = 8000, each: int = 2000) -> Column:
    """A reason to refuse an array of text fields: too long in all, one too long, or prose instead of data."""
    size = F.aggregate(fields, F.lit(0), lambda a, x: a + F.length(x))
    prose = F.exists(fields, lambda x: (F.size(F.regexp_extract_all(x, F.lit(r"([.!?]+(?:\s|$))"), 1)) > 8) & (F.length(x) > 400))
    return first_reason((size > total, "payload_too_large"), (F.exists(fields, lambda x: F.length(x) > each), "field_too_long"), (prose, "free_text"))


def allowed_host(url: Column, hosts: Sequence[str]) -> Column:
    """An https address at one of the hosts or below it."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    at = F.lit(False)
    for h in hosts:
        at |= (host == h) | host.endswith("." + h)
    return F.coalesce(url.startswith("https://") & at, F.lit(False))


def external_link(url: Column, schemes: Sequence[str] = ("http", "https", "mailto")) -> Column:
    """A reason not to open a link: too long, no scheme or one that is not listed, no host; else null."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.coalesce(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#\s]+)", 1), F.lit(""))
    return first_reason((url.isNull() | (url == ""), "empty"), (F.length(url) > 2048, "too_long"), (~scheme.isin(*schemes), "scheme"), ((scheme != "mailto") & (host == ""), "no_host"))


def reviewer_guidance(url: Column, title: Column, subjects: Column) -> Column:
    """A page of guidance for reviewers: named so, or about review and two subjects or more."""
    named = F.lower(F.concat_ws(" ", url, title)).rlike(r"reviewer|peer[- ]?review")
    return named | ((F.size(subjects) >= 2) & F.exists(subjects, lambda s: F.lower(s).contains("review")))


def title_ok(title: Column, most: int = 120) -> Column:
    return first_reason((F.trim(F.coalesce(title, F.lit(""))) == "", "empty"), (F.length(title) > most, "too_long"))


def vector_ok(vector: Column, dim: int) -> Column:
    return first_reason((vector.isNull(), "missing"), (F.size(vector) != dim, "dimension"), (F.exists(vector, lambda x: x.isNull() | F.isnan(x)), "not_finite"))


def exclusion(group: Column, outcome: Column, levels: Sequence[str], missing_codes: Sequence[float] = ()) -> Column:
    """Why a row is not used in a comparison of groups; the first reason counts, "used" if there is none."""
    return F.coalesce(
        first_reason((group.isNull() | (group == ""), "missing_group"), (~group.isin(*levels), "other_level"), (outcome.isNull(), "missing_outcome"), (outcome.isin(*missing_codes) if missing_codes else F.lit(False), "missing_code")),
        F.lit("used"),
    )


def can_move(state: Column, event: Column, moves: dict[tuple[str, str], str]) -> Column:
    """The state after an event, null where the table of moves has none."""
    out = F.lit(None).cast("string")
    for (source, name), target in moves.items():
        out = F.when((state == source) & (event == name), target).otherwise(out)
    return out
