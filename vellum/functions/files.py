"""What a file is, by its first bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: First bytes in hexadecimal, and the kind they mark.
MAGIC = (("25504446", "pdf"), ("504B0304", "zip"), ("504B0506", "zip"), ("D0CF11E0A1B11AE1", "ole"))


def kind_of(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = None
    for magic, kind in MAGIC:
        out = F.when(F.startswith(head, F.lit(magic)), kind) if out is None else out.when(F.startswith(head, F.lit(magic)), kind)
    return out.when(looks_like_html(content), "html").otherwise("other")


def looks_like_html(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    return head.rlike(r"(?i)^\W{0,4}\s*(<!doctype\s+html|<html|<head|<body|<script|<!--)")
