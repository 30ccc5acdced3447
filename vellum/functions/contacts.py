"""Ways to comment that a text names: web addresses, bare domains, e-mail, post, telephone, fax."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# What introduces a contact and what one looks like.
URL = re.compile(r"https?://[^\s，,。；;、）)】」\"'<>]+")
DOMAIN = re.compile(r"(?<![\w.@/])(?:www\.[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[A-Za-z0-9-]+\.gov\.cn)")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
NUMBER = r"(?:0\d{2,3}[-－\s]?\d{7,8}(?:[-－转]\d{1,6})?|1[3-9]\d{9})"
NUMBERS = rf"({NUMBER}(?:\s*[，,、；;和及]\s*{NUMBER})*)"
PHONE = re.compile(rf"(?:联系电话|咨询电话|联系方式|电话)(?!及传真)\s*[:：]?\s*{NUMBERS}")
FAX = re.compile(rf"(?:传真号码|传真)(?:电话)?\s*[:：]?\s*{NUMBERS}")
ZIP = r"[；;]\s*(?:邮政编码|邮编)\s*[:：]?\s*\d{6}"
POST = [re.compile(rf"(?:{words})\s*[:：]{colon}\s*([^\n。；;]{{6,80}}(?:{ZIP})?)") for words, colon in (("通信地址|通讯地址|邮寄地址|联系地址|收件地址|地址", ""), ("信函邮寄至|邮寄至|寄至", "?"))]
POST_CODE = re.compile(r"[（(].{0,6}?(?:邮\s*政?\s*编\s*码?|\d{6}).{0,12}?[）)]")
POST_END = re.compile("[，,](?:并|来信|请在|邮寄时|信封|邮件|注明|联系)")
FILES = re.compile(r"\.(?:pdf|docx?|wps|xls[xm]?|zip|rar|png|jpe?g|gif|svg)$", re.I)
NOT_WAYS = ("beian.miit.gov.cn", "www.beian.gov.cn")
KINDS = ("online", "email", "address", "phone", "fax")
MOST, CONTEXT, ADDRESS = 8, 120, 60

FOUND = "array<struct<kind:string,value:string,href:string,context:string>>"
_SENTENCE = re.compile("[^。；！？\n]+[。；！？]?")


def _clipped(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "…"


def _address(raw: str) -> str | None:
    """A postal address: to its post code, or to what is said after it."""
    text = " ".join(raw.split())
    if not text or "@" in text or re.search("https?://", text):
        return None
    if code := POST_CODE.search(text):
        return _clipped(text[: code.end()], ADDRESS)
    end = POST_END.search(text)
    return _clipped(text[: end.start()] if end and end.start() >= 6 else text, ADDRESS)


def contacts_of(text: str | None, page: str | None = None, most: int = MOST) -> list[dict]:
    """Contacts in order of kind and place, each value of a kind once.

    A stretch of text is claimed by the first kind that takes it, so a domain within a web address or
    an e-mail's, and a number that a telephone's and a fax's word both introduce, is one contact. A post
    address may hold a domain, which is a way of its own.
    """
    text, out, claimed, seen = text or "", [], [], set()

    def add(kind: str, value: str, href: str | None, start: int, end: int, claim: bool = True) -> None:
        key = kind, value.lower()
        if key in seen or claim and any(a < end and start < b for a, b in claimed):
            return
        seen.add(key)
        if claim:
            claimed.append((start, end))
        sentence = next((m[0] for m in _SENTENCE.finditer(text) if m.start() <= start < m.end()), "")
        out.append({"kind": kind, "value": value, "href": href, "context": _clipped(" ".join(sentence.split()), CONTEXT)})

    for pattern, scheme in ((URL, ""), (DOMAIN, "http://")):
        for m in pattern.finditer(text):
            href = scheme + m[0]
            try:
                host = urlsplit(href).hostname
            except ValueError:
                continue
            if host and host not in NOT_WAYS and href != page and not FILES.search(href):
                add("online", href, href, *m.span())
    for m in EMAIL.finditer(text):
        add("email", m[0], f"mailto:{m[0]}", *m.span())
    for pattern in POST:
        for m in pattern.finditer(text):
            if address := _address(m[1]):
                add("address", address, None, *m.span(1), claim=False)
    for kind, pattern in (("fax", FAX), ("phone", PHONE)):  # a fax's word may hold a telephone's
        for m in pattern.finditer(text):
            for n in re.finditer(NUMBER, m[1]):
                number = " ".join(n[0].split())
                add(kind, number, "tel:" + re.sub(r"[^\d+]", "", number.split("转")[0]), m.start(1) + n.start(), m.start(1) + n.end())
    return sorted(out, key=lambda x: KINDS.index(x["kind"]))[:most]


def contacts(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(id, rank, kind, value, href, context) of texts (id, text, and url of the page itself, if there is one)."""

    def run(texts: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([contacts_of(t, p, most) for t, p in zip(texts, pages)])

    page = F.col("url") if "url" in docs.columns else F.lit(None).cast("string")
    found = docs.select("id", F.posexplode(F.pandas_udf(run, FOUND)("text", page)).alias("rank", "c"))
    return found.select("id", (F.col("rank") + 1).alias("rank"), "c.*")


def contact_audit(docs: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """Per group of documents (id, ``by``): how many there are, how many name no way to comment, and how many each kind."""
    kinds = found.groupBy("id").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in KINDS])
    per = docs.select("id", by).join(kinds, "id", "left").groupBy(by)
    return per.agg(F.count("*").alias("n"), F.count_if(F.coalesce(*KINDS).isNull()).alias("n_none"), *[F.coalesce(F.sum(k), F.lit(0)).alias(f"n_{k}") for k in KINDS])
