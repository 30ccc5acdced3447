"""Total orders, pages, samples and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PAGE_SIZE = 50


def default_order() -> list[Column]:
    """Open ones first, then the nearest deadline, none last, the latest fetch, the least id."""
    return [F.when(F.col("status") == "open", 0).otherwise(1).asc(), F.col("deadline").asc_nulls_last(), F.col("fetched_at").desc_nulls_last(), F.col("id").asc()]


ORDERS = {
    "deadline": default_order,
    "published": lambda: [F.col("published").desc_nulls_last(), F.col("id").asc()],
    "newest": lambda: [F.col("first_seen").desc_nulls_last(), F.col("id").asc()],
    "clicks": lambda: [F.col("clicks").desc_nulls_last(), F.col("id").asc()],
}


def page_of(df: DataFrame, order: str, page: int, total: int | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """One page; a page beyond the last one gives the last one."""
    if total is not None:
        page = max(1, min(page, -(-total // size)))
    return df.orderBy(*ORDERS[order]()).offset((page - 1) * size).limit(size)


def top_clicked(df: DataFrame, n: int) -> DataFrame:
    return df.where("clicks > 0").orderBy(F.desc("clicks"), "id").limit(n)


def every_kth(df: DataFrame, k: int, most: int, *order: Column | str) -> DataFrame:
    """A systematic sample: rows 0, k, 2k, ... of the order, at most ``most``; ranked within a sorted range."""
    return df.orderBy(*order).limit(k * (most - 1) + 1).withColumn("_row", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("_row") % k == 0).drop("_row")


#: Extensions' priors and words that raise or lower an attachment's rank.
EXTENSION_SCORES = (("docx", 30), ("doc", 25), ("pdf", 20), ("wps", 10))
DRAFT_WORDS, EXPLANATION_WORDS, FORM_WORDS = "征求意见稿|草案|修订稿|draft", "说明|解读|explanation", "反馈表|意见表|回执|form|table"


def attachment_score(name: Column) -> Column:
    lower = F.lower(name)
    score = F.lit(0)
    for ext, points in EXTENSION_SCORES:
        score = F.when(F.endswith(lower, F.lit("." + ext)), points).otherwise(score) if ext else score
    score = score + F.when(lower.rlike(DRAFT_WORDS), 40).otherwise(0) + F.when(lower.rlike(EXPLANATION_WORDS), 30).otherwise(0)
    return score - F.when(lower.rlike(FORM_WORDS), 50).otherwise(0)


def ranked_attachments(files: DataFrame, most: int) -> DataFrame:
    """The best ``most`` files of each notice, at least one of them explanatory if there is any."""
    by_score = Window.partitionBy("notice_id").orderBy(F.desc("score"), "name")
    scored = files.withColumn("score", attachment_score(F.col("name"))).withColumn("explains", F.lower("name").rlike(EXPLANATION_WORDS))
    ranked = scored.withColumn("rank", F.row_number().over(by_score))
    best = F.min(F.when(F.col("explains"), F.col("rank"))).over(Window.partitionBy("notice_id"))
    chosen = ranked.withColumn("first_explains", best)
    swap = F.col("first_explains") > most
    keep = F.when(swap, (F.col("rank") < most) | (F.col("rank") == F.col("first_explains"))).otherwise(F.col("rank") <= most)
    return chosen.where(F.coalesce(keep, F.col("rank") <= most)).drop("first_explains")


# What a file's name says of its part in a notice, and files that aren't fetched.
NAME_PRIORS = {"pdf": 2, "docx": 2, "doc": 1}
STRONG_NAMES = ("草案", "征求意见稿", "标准文本", "正文", "办法", "规定", "实施细则", "起草说明", "编制说明")
WEAK_NAMES = ("通知", "方案")
FORM_NAMES = ("回执", "反馈表", "意见表", "征求表", "填写表", "模板", "登记表", "汇总表", "申报书", "报名表", "附图", "照片")
EXPLAINING_NAMES = ("编制说明", "起草说明", "修订说明", "修改说明", "编制解释")
NOT_FETCHED = ("zip", "rar", "7z", "xls", "xlsx", "csv", "ppt", "pptx", "ofd", "caj", "txt", "md", "jpg", "jpeg", "png", "gif", "bmp")


def file_score(name: Column) -> Column:
    """How likely a file is the draft itself, by its name."""
    says = lambda words: name.rlike("|".join(words))
    extension = F.lower(F.regexp_extract(F.trim(name), r"\.([A-Za-z0-9]{1,5})$", 1))
    prior = F.coalesce(*[F.when(extension == e, n) for e, n in NAME_PRIORS.items()], F.lit(0))
    return prior + F.when(says(STRONG_NAMES), 3).when(says(WEAK_NAMES), 1).otherwise(0) - F.when(says(FORM_NAMES), 4).otherwise(0)


def file_role(name: Column) -> Column:
    return F.when(name.rlike("|".join(EXPLAINING_NAMES)), "explanation").when(file_score(name) >= 3, "draft").otherwise("other")


def chosen_files(files: DataFrame, most: int = 3) -> DataFrame:
    """The files of each notice (notice_id, name, pos) that are fetched, with score, role and rank.

    The best ``most`` by score, then by place; files of kinds that aren't fetched don't count. If none of
    them explains, the first file that does takes the last one's place, unless no draft would be left.
    """
    name = F.coalesce("name", F.lit(""))
    extension = F.lower(F.regexp_extract(F.trim(name), r"\.([A-Za-z0-9]{1,5})$", 1))
    wanted = files.where(~extension.isin(*NOT_FETCHED)).withColumn("score", file_score(name)).withColumn("role", file_role(name))
    per = Window.partitionBy("notice_id")
    ranked = wanted.withColumn("rank", F.row_number().over(per.orderBy(F.desc("score"), "pos", "name")))
    first = F.min(F.when(F.col("role") == "explanation", F.col("rank"))).over(per)
    drafts = F.count_if((F.col("role") == "draft") & (F.col("rank") < most)).over(per)
    swap = F.coalesce((first > most) & (drafts > 0), F.lit(False)) if most >= 2 else F.lit(False)
    marked = ranked.withColumn("_first", first).withColumn("_swap", swap)
    kept = F.when(F.col("_swap"), (F.col("rank") < most) | (F.col("rank") == F.col("_first"))).otherwise(F.col("rank") <= most)
    return marked.where(kept).withColumn("rank", F.least("rank", F.lit(most))).drop("_first", "_swap")
