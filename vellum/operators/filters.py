"""Filters over notices: conditions that are composed into one predicate, queues, and rule matching.

A notice has (at least) the columns id, title, body, agency, agencies, tags, source_id, status,
audience, published, deadline, fetched_at, first_seen, clicks. "Today" is always a parameter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import PERIOD_BUCKETS
from ..functions.text import search_terms

MONTH = re.compile(r"\d{4}-(0[1-9]|1[0-2])")
SORTS = ("deadline", "published", "newest", "clicks")
SINCE_DAYS = (1, 3, 7, 14, 30)


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions, F.lit(True))


def audience_is(value: str) -> Column:
    """``unknown`` also takes what was never judged."""
    same = F.col("audience") == value
    return same | F.col("audience").isNull() if value == "unknown" else same


def has_tag(tag: str) -> Column:
    return F.array_contains("tags", tag)


def has_agency(name: str, lead_only: bool = False) -> Column:
    if lead_only:
        return F.coalesce(F.try_element_at("agencies", F.lit(1)) == name, F.lit(False))
    return (F.col("agency") == name) | F.coalesce(F.array_contains("agencies", name), F.lit(False))


def in_months(first: str | None = None, last: str | None = None) -> Column:
    month = F.date_format("published", "yyyy-MM")
    return all_of(*([month >= first] if first else []), *([month <= last] if last else []))


def has_keywords(query: str, fields: tuple[str, ...] = ("title", "body")) -> Column:
    """Every term, taken literally, in any of the fields; without terms everything passes."""
    lower = [F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    return all_of(*[reduce(or_, [F.contains(f, F.lit(t)) for f in lower]) for t in search_terms(query)])


def still_open(today: str) -> Column:
    return (F.col("status") == "open") & (F.col("deadline").isNull() | (F.col("deadline") >= F.lit(today).cast("date")))


def seen_since(now: str, days: int) -> Column:
    """Within days times 24 hours before ``now``; what was there before counts as never seen."""
    return F.coalesce(F.col("first_seen") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)), F.lit(False))


def in_period_bucket(name: str) -> Column:
    low, high = next((low, high) for n, low, high in PERIOD_BUCKETS if n == name)
    days = F.datediff("deadline", "published")
    return all_of(days.isNotNull(), *([days >= low] if low is not None else []), *([days <= high] if high is not None else []))


def effective_status(today: str) -> Column:
    return F.when((F.col("status") == "open") & (F.col("deadline") < F.lit(today).cast("date")), "closed").otherwise(F.col("status"))


def ingest_status(today: str, label: Column) -> Column:
    """The deadline decides; without one the source's label; without either it is open."""
    by_deadline = F.when(F.col("deadline").isNotNull(), F.when(F.col("deadline") < F.lit(today).cast("date"), "closed").otherwise("open"))
    return F.coalesce(by_deadline, label, F.lit("open"))


@dataclass(frozen=True)
class NoticeQuery:
    """A validated list query; what isn't valid is left out, a range turned round is dropped whole."""

    audience: str | None = None
    tag: str | None = None
    agency: str | None = None
    lead_only: bool = False
    first_month: str | None = None
    last_month: str | None = None
    keywords: str = ""
    source_id: str | None = None
    open_on: str | None = None
    since_days: int | None = None
    now: str | None = None
    period: str | None = None
    sort: str = "deadline"
    page: int = 1
    extra: tuple[Column, ...] = field(default=(), compare=False)

    @classmethod
    def parse(cls, args: dict[str, str], today: str, now: str) -> NoticeQuery:
        month = {k: v for k in ("from", "to") if (v := args.get(k, "")) and MONTH.fullmatch(v)}
        if len(month) == 2 and month["from"] > month["to"]:
            month = {}
        since = args.get("since", "")
        page = args.get("page", "1")
        return cls(
            audience=args.get("audience") if args.get("audience") in ("public", "sector", "unknown") else None,
            tag=args.get("tag") or None,
            agency=args.get("agency") or None,
            lead_only=args.get("lead") == "1",
            first_month=month.get("from"),
            last_month=month.get("to"),
            keywords=args.get("q", "").strip()[:200],
            source_id=args.get("source") or None,
            open_on=today if args.get("open") == "1" else None,
            since_days=int(since) if since.isdigit() and int(since) in SINCE_DAYS else None,
            now=now,
            period=args.get("period") if args.get("period") in {n for n, _, _ in PERIOD_BUCKETS} else None,
            sort=args.get("sort") if args.get("sort") in SORTS else "deadline",
            page=int(page) if page.isdigit() and int(page) > 0 else 1,
        )

    def condition(self) -> Column:
        parts = [*self.extra]
        if self.audience:
            parts.append(audience_is(self.audience))
        if self.tag:
            parts.append(has_tag(self.tag))
        if self.agency:
            parts.append(has_agency(self.agency, self.lead_only))
        if self.first_month or self.last_month:
            parts.append(in_months(self.first_month, self.last_month))
        if self.keywords:
            parts.append(has_keywords(self.keywords))
        if self.source_id:
            parts.append(F.col("source_id") == self.source_id)
        if self.open_on:
            parts.append(still_open(self.open_on))
        if self.since_days:
            parts.append(seen_since(self.now, self.since_days))
        if self.period:
            parts.append(in_period_bucket(self.period))
        return all_of(*parts)

    def describe(self) -> str:
        """The query in words, in a fixed order of its parts."""
        named = (("audience", self.audience), ("tag", self.tag), ("agency", self.agency), ("from", self.first_month), ("to", self.last_month), ("text", self.keywords), ("source", self.source_id), ("open on", self.open_on), ("days", self.since_days), ("period", self.period))
        return "; ".join(f"{k} {v}" for k, v in named if v) or "all notices"


def summary_queue(notices: DataFrame, limit: int) -> DataFrame:
    """What waits for a summary, the oldest fetch first."""
    waits = F.col("summary").isNull() & (F.col("summary_status") == "pending") & (F.col("status") != "closed")
    return notices.where(waits).orderBy("fetched_at", "id").limit(limit)


def review_queue(notices: DataFrame) -> DataFrame:
    return notices.where(F.col("summary_status") == "failed_review")


def extraction_due(status: Column, fetched_at: Column, attempts: Column, now: str, blocked_days: int = 7, refresh_days: int = 30, most_attempts: int = 3) -> Column:
    """Whether an attachment is due: pending ones always, others by their state's own rule."""
    age = F.datediff(F.lit(now).cast("date"), fetched_at)
    return (
        F.when(status == "pending", True)
        .when(status == "blocked", age >= blocked_days)
        .when(status == "error", attempts < most_attempts)
        .when(status == "ok", age >= refresh_days)
        .otherwise(False)
    )


def open_with_deadline(notices: DataFrame) -> DataFrame:
    return notices.where((F.col("status") == "open") & F.col("deadline").isNotNull())


def active_subscriptions(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.where(F.col("confirmed_at").isNotNull() & F.col("unsubscribed_at").isNull())


def audience_passes(rule_audiences: Column, audience: Column) -> Column:
    return (F.size(rule_audiences) == 0) | F.array_contains(rule_audiences, F.coalesce(audience, F.lit("unknown")))


def rule_matches(scope: Column, categories: Column, agencies: Column, keywords: Column, audiences: Column, tags: Column, notice_agencies: Column, text: Column, audience: Column, strict_audience: bool = False) -> Column:
    """The rule operator: audiences narrow; ``all`` passes; else any category, agency or keyword does.

    A rule of audiences alone passes what they let through, an empty rule nothing. With audiences
    and no keywords, a rule whose categories and agencies miss passes too, unless ``strict_audience``.
    """
    overlap = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    lower = F.lower(text)
    by_words = F.coalesce(F.exists(keywords, lambda k: F.contains(lower, F.lower(k))), F.lit(False))
    any_of = overlap(categories, tags) | overlap(agencies, notice_agencies) | by_words
    only_audience = F.size(audiences) > 0
    if strict_audience:
        only_audience = only_audience & (F.size(categories) == 0) & (F.size(agencies) == 0)
    only_audience = only_audience & (F.size(keywords) == 0)
    return audience_passes(audiences, audience) & ((scope == "all") | any_of | only_audience)


#: Marks of clients whose clicks don't count.
ROBOTS = r"(?i)bot|spider|crawl|slurp|facebookexternalhit|preview|monitor|headless"
SCRIPTS = r"(?i)^(curl|wget|python|go-http|java|okhttp|libwww|axios|node-fetch)"


def not_countable_reason(agent: Column, method: Column, purpose: Column) -> Column:
    """Why a click doesn't count; null if it does."""
    agent = F.trim(F.coalesce(agent, F.lit("")))
    return (
        F.when(F.upper(method) == "HEAD", "head")
        .when(F.lower(F.coalesce(purpose, F.lit(""))).contains("prefetch"), "prefetch")
        .when(agent == "", "no agent")
        .when(agent.rlike(ROBOTS), "robot")
        .when(agent.rlike(SCRIPTS), "script")
    )


def rule_problem(scope: Column, categories: Column, agencies: Column, keywords: Column, audiences: Column, known_categories: list[str], known_audiences: list[str]) -> Column:
    known = lambda names: F.array(*[F.lit(n) for n in names])
    empty = all_of(scope != "all", *[F.size(x) == 0 for x in (categories, agencies, keywords, audiences)])
    return (
        F.when(empty, "no rules")
        .when(F.size(F.array_except(categories, known(known_categories))) > 0, "unknown category")
        .when(F.size(F.array_except(audiences, known(known_audiences))) > 0, "unknown audience")
    )


def token_status(confirmed_at: Column, unsubscribed_at: Column, found: Column) -> Column:
    return F.when(~found, "invalid").when(unsubscribed_at.isNotNull(), "unsubscribed").when(confirmed_at.isNotNull(), "confirmed").otherwise("confirmable")


def is_new(first_seen: Column, now: str, days: int = 7) -> Column:
    return F.coalesce(first_seen > F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)), F.lit(False))


