"""Corpora for the driver's tables: documents as notes, and entities rendered to note files.

Rendered files go through the real parser, so the queries over them test it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.constants import PAYLOAD_BEGIN, PAYLOAD_END
from ..functions.parse import notes
from ..operators import store

S = F.lit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def first_words(c: Column, n: int) -> Column:
    """The first words of a text; only its beginning is read where that has more than them."""
    near = X.tokens(F.substring(c, 1, 32 * n))
    return F.array_join(F.slice(F.when(F.size(near) > n, near).otherwise(X.tokens(c)), 1, n), " ")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as searchable notes."""
    return as_notes(table(spark, sf_dir, "documents"))


def as_notes(d: DataFrame) -> DataFrame:
    """The path from language, source and id, the title from the first words."""
    title = first_words(F.col("text"), 6)
    updated = F.date_format(F.date_add(F.to_date(S("2024-01-01")), F.pmod("doc_id", S(365)).cast("int")), "yyyy-MM-dd")
    return d.select(
        F.concat_ws("/", "lang", "source", "doc_id").alias("path"),
        title.alias("title"),
        F.concat_ws(" ", "lang", "source").alias("meta"),
        F.col("text").alias("body"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("source").alias("type"),
        F.array("lang").alias("tags"),
        updated.alias("updated"),
        "doc_id",
    )


def file(path: Column, head: list[tuple[str, Column]], body: Column) -> list[Column]:
    """path and content of a note file; a null value leaves its line out."""
    lines = [F.concat(S(f"{k}: "), v.cast("string"), S("\n")) for k, v in head]
    text = F.concat(S("---\n"), *(F.coalesce(line, S("")) for line in lines), S("---\n\n"), body)
    return [path.alias("path"), text.alias("content")]


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    head = [("id", F.concat(S("nat-"), r)), ("type", F.when(r < 2, "moc").otherwise("resource")), ("status", S("active")), ("created", S("2020-01-01")), ("updated", S("2020-01-02"))]
    body = F.concat(S("# "), F.col("n_name"), S("\n\nPart of [[region-"), r, S("]].\n"))
    return table(spark, sf_dir, "nation").select(*file(F.concat(S("40-knowledge/nation-"), k, S(".md")), head, body))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    head = [("id", F.concat(S("reg-"), k)), ("type", S("area")), ("status", S("active")), ("created", S("2020-01-01")), ("updated", S("2020-01-02"))]
    return table(spark, sf_dir, "region").select(*file(F.concat(S("20-areas/region-"), k, S(".md")), head, F.concat(S("# "), F.col("r_name"), S("\n"))))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    head = [("id", F.concat(S("sup-"), k)), ("type", S("organization")), ("status", S("active")), ("created", S("2020-01-01")), ("updated", S("2020-01-02"))]
    link = F.when(k % 2 == 0, F.concat(S("[[40-knowledge/nation-"), F.col("s_nationkey"), S(".md|home]]"))).otherwise(F.concat(S("[[nowhere-"), k, S("]]")))
    body = F.concat(S("# "), F.col("s_name"), S("\n\nFrom "), link, S("; not `[[code-link]]`.\n"))
    return table(spark, sf_dir, "supplier").select(*file(F.concat(S("40-knowledge/organizations/supplier-"), k, S(".md")), head, body))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    head = [
        ("id", F.concat(S("cust-"), k)),
        ("type", S("person")),
        ("status", F.when(k % 3 == 0, "draft").otherwise("active")),
        ("tags", F.concat(S("["), F.col("c_mktsegment"), S(', "n'), F.col("c_nationkey"), S('"]'))),
        ("created", S("2020-01-01")),
        ("updated", S("2020-01-02")),
        ("review_on", F.when(k % 4 == 0, S("1995-06-01")).when(k % 4 == 1, S("2999-01-01"))),
    ]
    link = F.when(k % 7 != 0, F.concat(S("Lives in [[nation-"), F.col("c_nationkey"), S("#Top]].\n"))).otherwise(S("Nowhere.\n"))
    folder = F.when(k % 5 == 0, "00-inbox").otherwise("40-knowledge/people")
    rows = store.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_name"))
    return rows.select(*file(F.concat(folder, S("/customer-"), k, S(".md")), head, F.concat(S("# "), F.col("c_name"), S("\n\n"), link)))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of regions, nations, suppliers and customers: foreign keys are links."""
    return notes(regions(spark, sf_dir).union(nations(spark, sf_dir)).union(suppliers(spark, sf_dir)).union(customers(spark, sf_dir)))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order notes: relation to the customer, freshness, dates."""
    k = F.col("o_orderkey")
    target = F.when(k % 11 == 0, "customer-none").otherwise(F.concat(S("customer-"), F.col("o_custkey")))
    head = [
        ("id", F.concat(S("order-"), k)),
        ("type", S("project")),
        ("status", F.when(F.col("o_orderstatus") == "O", "active").otherwise("done")),
        ("created", day(F.col("o_orderdate"))),
        ("updated", day(F.col("o_orderdate"))),
        ("freshness", F.when(k % 3 == 0, "pointer").when(k % 3 == 1, "snapshot")),
        ("truth_source", F.when(k % 6 == 0, S("ledger")).when(k % 6 == 3, S("[a, b]"))),
        ("last_verified", day(F.col("o_orderdate"))),
        ("freshness_window_days", (k % 50) * 10),
        ("depends_on", F.concat(S('["[['), target, S(']]"]'))),
    ]
    return table(spark, sf_dir, "orders").select(*file(F.concat(S("10-projects/order-"), k, S(".md")), head, F.concat(S("# Order "), k, S("\n"))))


def order_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer notes that declare their even orders."""
    link = F.concat(S('  - "[[order-'), F.col("o_orderkey"), S(']]"\n'))
    own = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0 and o_orderkey % 11 <> 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.sort_array(F.collect_list(link)), "").alias("items"))
    rows = table(spark, sf_dir, "customer").join(own, "c_custkey", "left")
    k = F.col("c_custkey")
    head = F.concat(S("---\nid: cust-"), k, S("\ntype: person\nstatus: active\ncreated: 2020-01-01\nupdated: 2020-01-02\n"))
    listed = F.coalesce(F.concat(S("required_by:\n"), F.col("items")), S(""))
    return rows.select(F.concat(S("40-knowledge/people/customer-"), k, S(".md")).alias("path"), F.concat(head, listed, S("---\n\n# "), F.col("c_name"), S("\n")).alias("content"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part notes with gaps in the metadata, odd types, odd folders and headings that jump."""
    k, size = F.col("p_partkey"), F.col("p_size")
    head = [
        ("id", F.concat(S("part-"), k)),
        ("type", F.when(size % 7 == 0, "gadget").otherwise("resource")),
        ("status", F.when(size % 5 != 0, "active")),
        ("created", S("2020-01-01")),
        ("updated", F.when(size % 4 != 0, "2020-01-02").otherwise("")),
        ("tags", F.concat(S("#"), F.replace("p_brand", S(" "), S("-")), S(", "), F.replace("p_type", S(" "), S("-")))),
    ]
    body = F.concat(S("# "), F.col("p_name"), S("\n\n## Use\n\nText.\n\n"), F.when(size % 3 == 0, "#### Deep").otherwise("### Near"), S("\n\n```\n##### Not one\n```\n\n## "), F.when(size % 2 == 0, "USE").otherwise("End"), S("\n"))
    folder = F.when(size % 2 == 0, "10-projects").otherwise("30-resources")
    return store.spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_name")).select(*file(F.concat(folder, S("/part-"), k, S(".md")), head, body))


def task_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order notes with a checkbox for each line item, and one in a fence that is none."""
    li = table(spark, sf_dir, "lineitem")
    line = F.concat(F.when(F.col("l_linestatus") == "F", "- [x]").otherwise("- [ ]"), S(" ship part "), F.col("l_partkey"))
    each = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("t")))).alias("rows"))
    body = F.concat(S("# Order\n\n"), F.array_join(F.transform("rows", lambda r: r["t"]), "\n"), S("\n~~~\n- [ ] not this\n~~~\n"))
    head = [("id", F.concat(S("order-"), F.col("l_orderkey"))), ("type", S("project"))]
    return each.select(*file(F.concat(S("10-projects/order-"), F.col("l_orderkey"), S(".md")), head, body))


def sealed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sources with their digest, which is wrong, missing or without a boundary for some."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    digest = F.when(k % 10 == 0, F.sha2(F.concat("text", S("x")), 256)).when(k % 10 != 3, F.sha2("text", 256))
    head = [("id", F.concat(S("raw-"), k)), ("type", S("raw-source")), ("status", F.when(k % 10 == 7, "draft").otherwise("immutable")), ("content_sha256", digest)]
    body = F.concat(S("# Source\n\n" + PAYLOAD_BEGIN + "\n"), F.col("text"), S("\n"), F.when(k % 10 == 5, "").otherwise(PAYLOAD_END + "\n"))
    return d.select(*file(F.concat(S("30-resources/sources/raw/"), k, S(".md")), head, body))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as session activity: views and clicks are turns, purchases captures, errors failures, sign-ups edits."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "capture").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "edit").otherwise("turn")
    path = F.when(F.col("event_type") == "signup", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(S("p"), F.col("event_id") % 5))).otherwise("")
    return e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), path.alias("path"), S("").alias("call"))
