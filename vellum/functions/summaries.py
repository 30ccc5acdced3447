"""Stored summaries: JSON documents read tolerantly, their state, and what is said of them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

QUOTED = "array<struct<text:string,quote:string>>"
SUMMARY = f"struct<what:string,who:{QUOTED},changes:{QUOTED},impacts:array<struct<party:string,kind:string,text:string,quote:string>>>"
SECTIONS = ("who", "changes", "impacts")
MOST_ITEMS, MOST_CHARS = 12, 300


def has_key(doc: Column, key: str) -> Column:
    """Whether a JSON object has the key, be its value null."""
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def parsed(doc: Column) -> Column:
    """The summary, or null if it doesn't parse or lacks what it must have."""
    value = F.from_json(doc, SUMMARY)
    return F.when(F.trim(value["what"]) != "", value)


def template(doc: Column) -> Column:
    """The age of a summary's form, by the keys it has."""
    return F.when(F.json_object_keys(doc).isNull(), "none").when(has_key(doc, "impacts"), "impacts").when(has_key(doc, "changes"), "changes").otherwise("plain")


def redraft_reason(doc: Column, status: Column, manual: Column) -> Column:
    """Why a summary is drafted anew, or stays; the first reason that holds."""
    keys = F.json_object_keys(doc)
    return (
        F.when(status == "closed", "closed")
        .when(manual, "manual")
        .when(keys.isNull(), "unparseable")
        .when(~has_key(doc, "who"), "missing sections")
        .when(~has_key(doc, "impacts"), "no impacts key")
        .when(F.from_json(doc, SUMMARY)["impacts"].isNull(), "old shape")
    )


def normalized(items: Column, most: int = MOST_ITEMS) -> tuple[Column, Column]:
    """Items that have a text and are not too long, at most so many; and how many were dropped, by reason."""
    full = F.filter(items, lambda i: F.trim(F.coalesce(i["text"], F.lit(""))) != "")
    short = F.filter(full, lambda i: F.length(i["text"]) <= MOST_CHARS)
    kept = F.slice(short, 1, most)
    tally = F.struct((F.size(items) - F.size(full)).alias("empty"), (F.size(full) - F.size(short)).alias("too_long"), (F.size(short) - F.size(kept)).alias("over_limit"))
    return kept, tally


def display_state(summary: Column, status: Column, attachments: Column) -> Column:
    return F.when(summary.isNotNull(), "shown").when(status == "failed_review", "in review").when(status == "pending", F.when(attachments > 0, "coming").otherwise("waiting for files")).otherwise("none")


def provenance(basis: Column) -> Column:
    """Whether a summary's basis can be bettered."""
    return F.when(basis == "draft", "final").when(basis.isin("explanation", "body_as_draft"), "upgradeable by draft").when(basis.isin("body", "title"), "upgradeable").when(basis == "manual", "fixed").otherwise("unknown")


def coverage(total: Column, traced: Column) -> Column:
    return F.when(total == 0, "none").when(traced == total, "complete").otherwise("partial")


def marks(impacts: Column, changes: Column) -> Column:
    return F.array_compact(F.array(F.when(impacts > 0, "impacts"), F.when(changes > 0, "changes")))


def shows_who(audience: Column) -> Column:
    return F.coalesce(audience == "sector", F.lit(False))


def impact_line(party: Column, kind: Column, text: Column) -> Column:
    return F.concat_ws(": ", F.concat_ws(" ", F.nullif(F.trim(party), F.lit("")), F.when(F.trim(kind) != "", F.concat(F.lit("("), kind, F.lit(")")))), text)


def verdicts(output: Column) -> Column:
    """Review verdicts of a model's answer: the outermost list, complete items only; null for a status that is unknown."""
    items = F.from_json(F.regexp_extract(output, r"(?s)(\[.*\])", 1), "array<struct<quote:string,status:string,revised:string>>")
    whole = F.filter(items, lambda i: i["quote"].isNotNull() & i["status"].isNotNull())
    return F.when(~F.exists(whole, lambda i: ~i["status"].isin("kept", "revised", "rejected")), whole)


def independence(host_a: Column, host_b: Column, key_a: Column, key_b: Column) -> Column:
    """Why a reviewer isn't independent of the author; null if it is."""
    return F.when(host_a.isNull() | host_b.isNull(), "invalid address").when(host_a == host_b, "same host").when(key_a == key_b, "same key")


def diagnostics_line(model: Column, ms: Column, dropped: Column) -> Column:
    return F.concat_ws("; ", model, F.when(ms.isNotNull(), F.format_string("%.1f s", ms / 1000.0)), F.when(dropped > 0, F.concat(dropped.cast("string"), F.lit(" dropped"))))


def capped(output: Column, most: int = 20_000) -> Column:
    return F.struct(F.substring(output, 1, most).alias("text"), (F.length(output) > most).alias("cut"))


def usage(doc: Column) -> Column:
    """Token counts of a JSON text; bad numbers count nothing."""
    value = F.from_json(doc, "struct<prompt_tokens:long,completion_tokens:long>")
    safe = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")
    return F.struct(safe(value["prompt_tokens"]).alias("prompt"), safe(value["completion_tokens"]).alias("completion"))


def budgeted(blocks: Column, budget: int) -> Column:
    """Blocks in order, each cut to what is left of the budget."""
    start = F.struct(F.lit(budget).cast("int").alias("left"), F.array().cast("array<string>").alias("out"))

    def step(s, block):
        part = F.substr(block, F.lit(1), s["left"])
        return F.struct((s["left"] - F.length(part)).cast("int").alias("left"), F.when(part == "", s["out"]).otherwise(F.array_append(s["out"], part)).alias("out"))

    return F.aggregate(blocks, start, step, lambda s: F.array_join(s["out"], "\n"))


def encoded(draft: Column) -> Column:
    """A struct as URL-safe base64 of its JSON."""
    return F.rtrim(F.translate(F.base64(F.to_json(draft).cast("binary")), "+/\r\n", "-_"), F.lit("="))


def decoded(token: Column, schema: str) -> Column:
    """The struct again; null for what isn't one."""
    pad = F.rpad(token, (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    text = F.call_function("try_to_binary", F.translate(pad, "-_", "+/"), F.lit("base64")).cast("string")
    return F.from_json(text, schema)


#: Kinds of change and the words that mark them.
CHANGE_MARKS = {"added": "新增|增加|added|new ", "removed": "删除|取消|removed|deleted", "modified": "修改|调整|amended|changed"}


def change_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(f"(?i){words}")).alias(f"n_{kind}") for kind, words in CHANGE_MARKS.items()]


def error_kind(message: Column) -> Column:
    """What went wrong with a supplier: quota and time run out break the supply, others don't."""
    return F.when(message.rlike(r"(?i)quota|insufficient|balance|429|rate.?limit"), "quota").when(message.rlike(r"(?i)time.?out|timed out|ETIMEDOUT|aborted"), "timeout").otherwise("other")


def client_key(forwarded: Column, remote: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.element_at(F.split(F.coalesce(forwarded, F.lit("")), ","), 1)), F.lit("")), remote, F.lit("unknown"))


def probe_term(title: Column) -> Column:
    quoted = F.regexp_extract(title, "《([^》]{4,40})》", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.substring(title, 1, 10))


def agency_in_title(title: Column) -> Column:
    """What stands before 关于, if it looks like an agency's name."""
    head = F.regexp_extract(title, "^(.{2,30}?)关于", 1)
    return F.when(head.rlike("[部局委院署会办厅]$"), head)


def without_status(title: Column) -> Column:
    """A title without a mark of its state at either end."""
    mark = r"[\[【(（](已结束|进行中|已截止|征集中|open|closed)[\]】)）]"
    return F.trim(F.regexp_replace(title, f"^\\s*{mark}\\s*|\\s*{mark}\\s*$", ""))


def reminder_note(stage: Column, days: Column) -> Column:
    return F.when(days == 0, "closes today").when((stage == "d7") & (days < 7), F.concat(F.lit("catching up: "), days.cast("string"), F.lit(" days left"))).otherwise(F.concat(days.cast("string"), F.lit(" days left")))
