"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

QUOTE_GLYPHS = "“”„‟«»「」『』〝〞＂"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}]"
SENTENCE_ENDS = "。；！？"
LEAST_SEGMENT = 8


def collapsed(text: Column) -> Column:
    """White space, of any script, to single spaces, and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def cjk_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, CJK.replace("[", "[^", 1), ""))


def anchor_count(text: Column) -> Column:
    """Article anchors: 第…条 at a line's start."""
    return F.regexp_count(text, F.lit(r"(?m)^\s*第[0-9一二三四五六七八九十百千零〇]+条"))


def fingerprint(quote: Column) -> Column:
    """A quotation's key: its quotation marks made one, no white space, not wrapped in marks."""
    one = F.translate(quote, QUOTE_GLYPHS, '"' * len(QUOTE_GLYPHS))
    return F.regexp_replace(stripped(one), '^"+|"+$', "")


def segments(quote: Column) -> Column:
    """The parts of a quotation between ellipses, as fingerprints."""
    return F.filter(F.transform(F.split(quote, "…+|\\.{3,}"), fingerprint), lambda s: s != "")


def contains_in_order(haystack: Column, parts: Column) -> Column:
    """Whether all parts, each long enough, stand in ``haystack`` one after another."""
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"))

    def step(state, part):
        found = F.when(state["ok"] & (F.length(part) >= LEAST_SEGMENT), F.call_function("locate", part, haystack, state["at"])).otherwise(0)
        return F.struct((found + F.length(part)).alias("at"), (found > 0).alias("ok"))

    return (F.size(parts) > 0) & F.aggregate(parts, start, step, lambda s: s["ok"])


def sentences(text: Column) -> Column:
    """Sentences with their marks, trimmed and not empty."""
    return F.filter(F.transform(F.split(text, f"(?<=[{SENTENCE_ENDS}\\n])"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def sanitized(text: Column, limit: int = 200_000) -> Column:
    """Without control characters (but tab and line feed), cut at the limit."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", ""), 1, limit)


def filled(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(stripped(text))


def spaced_cjk(text: Column) -> Column:
    """A space after each CJK character, for an index of single characters."""
    return F.trim(F.regexp_replace(text, f"({CJK})", "$1 "))


def clean_quote(quote: Column, limit: int = 300) -> Column:
    bare = F.regexp_replace(F.trim(F.translate(quote, QUOTE_GLYPHS, '"' * len(QUOTE_GLYPHS))), '^"+|"+$', "")
    return F.when((F.length(bare) > 0) & (F.length(bare) <= limit), bare)


def search_terms(query: str, limit: int = 10) -> list[str]:
    return query.lower().split()[:limit]


def searchable(query: Column) -> Column:
    return query.rlike(r"[\p{L}\p{N}]")


def escaped_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def masked_quotes(text: Column) -> Column:
    """What is quoted becomes one mark, so that messages of one form meet in a group."""
    return F.regexp_replace(text, r"\"[^\"]*\"|'[^']*'", "\"…\"")

