"""Chains of versions: the findings by brute force, and how often titles are read for them."""

import random
import re

from pyspark.sql import functions as F

from vellum.functions.classify import title_key
from vellum.operators import audits

NOTICES = "id long, title string, agency string, version_of long"


def some(spark, n=400):
    r = random.Random(1)
    acts = ["甲乙丙丁法", "甲乙丙丁法（草案）", "甲乙（试点）丙丁法", "甲乙丙丁法第二次征求意见稿", "征求意见稿", "草案修订草案公开征求意见稿", "a b-c d", "x"]
    rows = [(r.randrange(350), r.choice(["关于《%s》的通知", "%s", "《%s》和《乙》"]) % r.choice(acts), r.choice(["A", "B", None]), r.choice([None, *range(350)])) for _ in range(n)]
    return spark.createDataFrame([*rows, (1, None, "A", 2)], NOTICES)


def test_findings_by_brute_force(spark):
    notices = some(spark)
    rows = notices.select("*", title_key(F.col("title")).alias("key"), audits.act_name(F.col("title")).alias("name")).collect()
    group = {(x.agency, x.key, x.id) for x in rows if x.key is not None and x.agency is not None}
    want = [("dirty", x.id, x.agency, x.key, x.version_of, None, None) for x in rows if x.key is not None and x.version_of is not None and (x.agency, x.key, x.version_of) not in group]
    for x in rows:
        same = [y.key for y in rows if x.agency is not None and y.agency == x.agency and x.name is not None and y.name == x.name]
        if same and len(x.name) >= audits.LEAST_NAME and len(set(same)) > 1:
            want.append(("split", x.id, x.agency, x.name, x.version_of, len(same), len(set(same))))
    got = [tuple(x) for x in audits.chain_audit(notices).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len({x[0] for x in want}) == 2


def test_titles_are_read_few_times(spark):
    plan = audits.chain_audit(some(spark, 20))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < len(re.findall("修订草案", plan)) <= 2  # once for the rows, once for their predecessors


def test_marks_of_rounds_go_up_to_the_passes(spark):
    titles = ["甲乙丙丁" + "草案" * 8, "甲乙丙丁" + "草案" * 9, "甲乙丙丁第三次征求意见稿修订草案", "甲乙丙丁公开征求意见稿", "草案"]
    got = [r.k for r in spark.createDataFrame(list(enumerate(titles)), "n int, t string").orderBy("n").select(title_key(F.col("t")).alias("k")).collect()]
    assert got == ["甲乙丙丁", "甲乙丙丁草案", "甲乙丙丁", "甲乙丙丁公开", None]
