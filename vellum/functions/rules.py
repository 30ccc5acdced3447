"""Normalizers with caps, shapes of texts, and sentences about what was read."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import anchor_count, cjk_count, collapsed

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
HEADING = r"^\s*([一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|第[一二三四五六七八九十]+部分)\S"
DRAFT_CJK, DRAFT_ANCHORS = 800, 3


def email(raw: Column) -> Column:
    """A mail address in lower case; null if it isn't one."""
    value = F.lower(F.trim(raw))
    return F.when(value.rlike(EMAIL) & (F.length(value) <= 254), value)


def keywords(raw: Column, most: int = 10, longest: int = 40) -> Column:
    """Words of a list written with commas or lines, each once, in order, at most so many."""
    parts = F.transform(F.split(raw, "[,，、;；\n]"), lambda k: collapsed(k))
    return F.slice(F.array_distinct(F.filter(parts, lambda k: (k != "") & (F.length(k) <= longest))), 1, most)


def listed(raw: Column, allowed: list[str]) -> Column:
    """Values of an array that are allowed, each once."""
    return F.array_distinct(F.filter(raw, lambda v: v.isin(allowed)))


def looks_like_draft(body: Column) -> Column:
    """Whether a body is itself the draft: long enough and divided into articles."""
    return (cjk_count(body) >= DRAFT_CJK) & (anchor_count(body) >= DRAFT_ANCHORS)


def heading_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(HEADING))


def document_names(text: Column) -> Column:
    """Titles between book marks, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("《([^《》]{2,80})》"), F.lit(1)))


def document_kind(name: Column) -> Column:
    return F.when(name.rlike("条例|法$|办法|规定"), "rule").when(name.rlike("标准|规范|规程"), "standard").when(name.rlike("规划|方案|计划"), "plan").otherwise("other")


def guidance(shown: Column, chars: Column, files: Column, readable: Column) -> Column:
    """(reason, files): why no way to comment is shown and where one may stand; nulls where one is.

    A text that never came is told apart from one that names no way.
    """
    reason = F.when(chars > 0, "not in the text").otherwise("no text")
    where = F.when(files == 0, "none").when(readable > 0, "readable").otherwise("unreadable")
    return F.struct(F.when(~shown, reason).alias("reason"), F.when(~shown, where).alias("files"))


def gap_attribution(sources: Column) -> Column:
    """What of the sources (chars, cut, starved) went into a summary, and what a gap may be due to.

    Only what was reported as cut or not fed may be named as a cause; without a record none is.
    """
    fed = F.filter(sources, lambda s: ~s["starved"])
    n, n_fed = F.size(sources), F.size(fed)
    cut = F.size(F.filter(fed, lambda s: s["cut"]))
    chars = F.aggregate(fed, F.lit(0).cast("long"), lambda a, s: a + s["chars"])
    parts = F.concat(F.when(cut > 0, F.format_string(", %d in part", cut)).otherwise(""), F.when(n_fed < n, F.format_string(", %d not at all", n - n_fed)).otherwise(""))
    told = F.when(n == 0, "nothing was fed").when(n_fed == 0, F.format_string("%d sources were read, none was fed", n)).otherwise(F.concat(F.format_string("%d sources were read, %d characters fed", n, chars), F.when((cut == 0) & (n_fed == n), ", each of them whole").otherwise(parts)))
    gap = F.when((cut > 0) | (n_fed < n), "; the gap may lie in what was not fed, or in what the model left out").otherwise("; the gap lies in what the model left out")
    return F.when(sources.isNull(), "no record of what was fed").otherwise(F.concat(told, gap))


def intake_sentence(files: Column, fed: Column, chars: Column, cut: Column) -> Column:
    """How much of the files went into a summary."""
    base = F.format_string("%d of %d files, %d characters", fed, files, chars)
    return F.when(files == 0, "no files").otherwise(F.concat(base, F.when(cut, ", cut to the budget").otherwise("")))


def change_note(rows: Column, facts: Column) -> Column:
    return F.when((rows == 0) & (facts == 0), "no changes are marked").when(rows == 0, F.format_string("%d statements of change", facts)).otherwise(F.format_string("%d changes, %d statements", rows, facts))


def summary_after(outcome: Column, old: Column, new: Column) -> tuple[Column, Column]:
    """(summary, status) after an attempt: saved, failed review (the old one stays), cleared, reset."""
    summary = F.when(outcome == "saved", new).when(outcome == "cleared", F.lit(None).cast("string")).otherwise(old)
    status = F.when(outcome == "saved", "done").when(outcome == "failed_review", "failed_review").when(outcome.isin("cleared", "reset"), "pending")
    return summary, status


def backoff(attempt: Column, base: int = 2, most: int = 60) -> Column:
    """Seconds to wait before another attempt: twice as long each time, up to a bound."""
    return F.least(F.lit(base).cast("long") * F.pow(F.lit(2), attempt).cast("long"), F.lit(most).cast("long"))


def seeded_failures(unhealthy: Column, alert_at: int = 2) -> Column:
    """The run of failures that a source starts with after a restart: one short of an alert, if it was unhealthy."""
    return F.when(F.coalesce(unhealthy, F.lit(False)), alert_at - 1).otherwise(0)
