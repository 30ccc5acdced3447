"""Keys of titles, roles of attachments, names of agencies; domains, genres and audiences are in ``rulebook``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ROUND_MARK = r"(?=[第一二三四五六七八九十\d征公修草送])(?:第?[一二三四五六七八九十\d]+次)?(?:征求意见稿|公开征求意见|修订草案|草案|修订稿|二次审议稿|三次审议稿|送审稿)"


def title_key(title: Column, least: int = 4, passes: int = 8) -> Column:
    """The key of a title's versions: its longest quoted part, without marks of rounds, letters and digits only."""
    quoted = F.array_sort(F.regexp_extract_all(title, F.lit("《([^》]+)》"), F.lit(1)), lambda a, b: F.when(F.length(a) == F.length(b), 0).when(F.length(a) > F.length(b), -1).otherwise(1))
    text = F.coalesce(F.try_element_at(quoted, F.lit(1)), title)
    text = F.regexp_replace(text, r"[（(][^（）()]*[)）]$", "")
    text = F.regexp_replace(text, f"(?:{ROUND_MARK}){{1,{passes}}}$", "")
    key = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.get(F.filter(F.array(key), lambda k: F.length(k) >= least), F.lit(0))  # the key is made once


def attachment_role(name: Column) -> Column:
    return F.when(F.lower(name).rlike("说明|解读|explanation"), "explanation").when(F.lower(name).rlike("征求意见稿|草案|修订稿|draft"), "draft").otherwise("other")


def agencies_of(raw: Column, aliases: dict[str, str]) -> Column:
    """Names of a joint issue, in order, each in its canonical form, once."""
    parts = F.filter(F.transform(F.split(raw, "[、,，;；]|\\s+和\\s+"), lambda p: F.trim(p)), lambda p: p != "")
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return F.array_distinct(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p) if table is not None else p))
