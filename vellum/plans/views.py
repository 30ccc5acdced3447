"""The notice model over the star schema: views, and the same views in SQL for the counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TODAY, NOW = "1998-06-01", "1998-06-01 00:00:00"


class Tables:
    """The tables of a folder, and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def notices(self) -> DataFrame:
        deadlines = self.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("deadline"))
        people = self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "n_name")
        key = F.col("o_orderkey")
        return (
            self.orders.join(deadlines, "o_orderkey", "left")
            .join(people, "o_custkey", "left")
            .select(
                key.alias("id"),
                F.concat(F.lit("Order "), F.col("o_orderpriority"), F.lit(" "), (key % 500).cast("string")).alias("title"),
                F.concat_ws(" ", "c_name", "c_mktsegment", "o_orderpriority").alias("body"),
                F.col("n_name").alias("agency"),
                F.array("n_name", "c_mktsegment").alias("agencies"),
                F.array("o_orderpriority", "c_mktsegment").alias("tags"),
                F.concat(F.lit("S"), (F.col("o_custkey") % 12).cast("string")).alias("source_id"),
                F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"),
                F.when(F.col("o_orderpriority") == "1-URGENT", "public").when(F.col("o_orderpriority") == "2-HIGH", "sector").when(F.col("o_orderpriority") == "5-LOW", "unknown").alias("audience"),
                F.to_date("o_orderdate").alias("published"),
                "deadline",
                (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (key % 48).cast("int"))).alias("fetched_at"),
                F.col("o_orderdate").alias("first_seen"),
                (key * 7 % 100).alias("clicks"),
                F.when(key % 3 == 0, F.concat(F.lit("Summary of "), key.cast("string"))).alias("summary"),
                F.when(key % 3 == 0, "done").when(key % 3 == 1, "pending").otherwise("failed_review").alias("summary_status"),
            )
        )

    @property
    def files(self) -> DataFrame:
        name = F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
        return self.lineitem.select(
            F.col("l_orderkey").alias("notice_id"),
            F.concat(F.lit("http://f.example.org/"), F.col("l_orderkey").cast("string"), F.lit("/"), name).alias("url"),
            F.concat(F.when(F.col("l_linestatus") == "F", "draft ").when(F.col("l_linenumber") == 3, "explanation ").otherwise("form "), name, F.when(F.col("l_returnflag") == "A", ".pdf").otherwise(".docx")).alias("name"),
            F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_returnflag") == "N", "pending").when(F.col("l_linenumber") % 2 == 0, "error").otherwise("blocked").alias("status"),
            (F.col("l_quantity") * 100).cast("long").alias("chars"),
            (F.col("l_linenumber") % 5).alias("attempts"),
            F.col("l_shipdate").alias("fetched_at"),
        )

    @property
    def subscriptions(self) -> DataFrame:
        k = F.col("s_suppkey")
        empty = F.array().cast("array<string>")
        return self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            k.alias("id"),
            F.when(k % 40 == 0, "all").otherwise("some").alias("scope"),
            F.when(k % 4 == 0, F.array(F.lit("1-URGENT"))).otherwise(empty).alias("categories"),
            F.when(k % 3 == 0, F.array("n_name")).otherwise(empty).alias("agencies"),
            F.when(k % 10 == 1, F.array(F.lit("machinery"), F.lit("#00000001"))).otherwise(empty).alias("keywords"),
            F.when(k % 5 == 0, F.array(F.lit("public"), F.lit("unknown"))).otherwise(empty).alias("audiences"),
            F.when(k % 7 != 0, F.lit("1998-01-01")).alias("confirmed_at"),
            F.when(k % 11 == 0, F.lit("1998-02-01")).alias("unsubscribed_at"),
        )

    @property
    def clicks(self) -> DataFrame:
        return self.events.where("event_type = 'click'").select("event_id", F.col("user_id").alias("notice_id"), F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai")).alias("day"))

    @property
    def run_log(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("source_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))


NOTICES = """select o.o_orderkey as id, 'Order ' || o_orderpriority || ' ' || (o.o_orderkey % 500) as title, concat_ws(' ', c_name, c_mktsegment, o_orderpriority) as body,
 n_name as agency, [n_name, c_mktsegment] as agencies, [o_orderpriority, c_mktsegment] as tags, 'S' || (o.o_custkey % 12) as source_id,
 case when o_orderstatus = 'F' then 'closed' else 'open' end as status,
 case o_orderpriority when '1-URGENT' then 'public' when '2-HIGH' then 'sector' when '5-LOW' then 'unknown' end as audience,
 o_orderdate::date as published, deadline, o_orderdate + to_hours((o.o_orderkey % 48)::int) as fetched_at, o_orderdate as first_seen, o.o_orderkey * 7 % 100 as clicks,
 case when o.o_orderkey % 3 = 0 then 'Summary of ' || o.o_orderkey end as summary,
 case o.o_orderkey % 3 when 0 then 'done' when 1 then 'pending' else 'failed_review' end as summary_status
 from orders o left join (select l_orderkey, max(l_shipdate)::date as deadline from lineitem group by 1) d on d.l_orderkey = o.o_orderkey
 left join customer c on c.c_custkey = o.o_custkey left join nation n on n.n_nationkey = c.c_nationkey"""

FILES = """select l_orderkey as notice_id, 'http://f.example.org/' || l_orderkey || '/' || nm as url,
 (case when l_linestatus = 'F' then 'draft ' when l_linenumber = 3 then 'explanation ' else 'form ' end) || nm || (case when l_returnflag = 'A' then '.pdf' else '.docx' end) as name,
 case when l_returnflag = 'A' then 'ok' when l_returnflag = 'N' then 'pending' when l_linenumber % 2 = 0 then 'error' else 'blocked' end as status,
 (l_quantity * 100)::bigint as chars, l_linenumber % 5 as attempts, l_shipdate as fetched_at
 from (select *, l_linenumber || '-' || l_partkey || '-' || l_suppkey as nm from lineitem)"""

SUBSCRIPTIONS = """select s_suppkey as id, case when s_suppkey % 40 = 0 then 'all' else 'some' end as scope,
 case when s_suppkey % 4 = 0 then ['1-URGENT'] else []::varchar[] end as categories, case when s_suppkey % 3 = 0 then [n_name] else []::varchar[] end as agencies,
 case when s_suppkey % 10 = 1 then ['machinery', '#00000001'] else []::varchar[] end as keywords, case when s_suppkey % 5 = 0 then ['public', 'unknown'] else []::varchar[] end as audiences,
 case when s_suppkey % 7 <> 0 then '1998-01-01' end as confirmed_at, case when s_suppkey % 11 = 0 then '1998-02-01' end as unsubscribed_at
 from supplier left join nation on n_nationkey = s_nationkey"""

CLICKS = "select event_id, user_id as notice_id, (ts + interval 8 hour)::date as day from events where event_type = 'click'"
RUN_LOG = '''select user_id as source_id, ts as "at", event_id as seq, event_type <> 'error' as ok from events'''


def with_views(sql: str) -> str:
    """The SQL with the views that it names in front."""
    views = {"notices": NOTICES, "files": FILES, "subscriptions": SUBSCRIPTIONS, "clicks": CLICKS, "run_log": RUN_LOG}
    import re

    used = [f"{name} as ({text})" for name, text in views.items() if re.search(rf"\b(from|join)\s+{name}\b", sql)]
    if not used:
        return sql
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ", ".join(used) + ", " + body[15:]
    return "with " + ", ".join(used) + (", " + body[5:] if body.lower().startswith("with ") else " " + body)
