"""List queries as columns: arguments checked, told in words, and written in one way."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dates import PERIOD_BUCKETS

AUDIENCES = ("public", "sector", "unknown")
SORTS = ("deadline", "published", "newest", "clicks")
SINCE_DAYS = ("1", "3", "7", "14", "30")
MONTH = r"^\d{4}-(0[1-9]|1[0-2])$"
#: Parts of a query in the order in which they are told and written.
PARTS = ("audience", "tag", "agency", "from", "to", "q", "source", "since", "period", "sort", "page")
TOLD = {"from": "from", "to": "to", "q": "text", "since": "days"}


def parsed(args: Column) -> Column:
    """A query's parts from its arguments (a map); what isn't valid is null, as are both ends of a range turned round."""
    raw = lambda k: F.nullif(F.trim(F.try_element_at(args, F.lit(k))), F.lit(""))
    one_of = lambda k, values: F.when(raw(k).isin(*values), raw(k))
    month = lambda k: F.when(raw(k).rlike(MONTH), raw(k))
    turned = F.coalesce(month("from") > month("to"), F.lit(False))
    values = {
        "audience": one_of("audience", AUDIENCES),
        "tag": raw("tag"),
        "agency": raw("agency"),
        "from": F.when(~turned, month("from")),
        "to": F.when(~turned, month("to")),
        "q": F.substring(raw("q"), 1, 200),
        "source": raw("source"),
        "since": one_of("since", SINCE_DAYS),
        "period": one_of("period", [name for name, _, _ in PERIOD_BUCKETS]),
        "sort": F.when(raw("sort").isin(*SORTS) & (raw("sort") != SORTS[0]), raw("sort")),  # the usual order goes without saying
        "page": F.when(raw("page").rlike(r"^[1-9]\d{0,8}$") & (raw("page") != "1"), raw("page")),
    }
    return F.struct(*[values[k].alias(k) for k in PARTS])


def described(query: Column) -> Column:
    """The query in words; its order and page are no part of what is listed."""
    parts = [F.concat(F.lit(TOLD.get(k, k) + " "), query[k]) for k in PARTS if k not in ("sort", "page")]
    said = F.concat_ws("; ", *parts)
    return F.when(said == "", "all notices").otherwise(said)


def canonical(query: Column, path: str = "/") -> Column:
    """The query's address: its parts in a fixed order, encoded, so that one query has one address."""
    parts = F.concat_ws("&", *[F.concat(F.lit(k + "="), F.url_encode(query[k])) for k in PARTS])
    return F.when(parts == "", path).otherwise(F.concat(F.lit(path + "?"), parts))
