"""Entity tables derived from the driver's tables with DataFrames.

Customers stand for students, suppliers for professors, documents for project
templates, part names for skills, nations for majors and events for a change feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRINGS = "array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def make_id(kind: str, value: Column | str) -> Column:
    """UUID-shaped text derived from a kind and a value; null for a null value."""
    value = F.col(value) if isinstance(value, str) else value
    digest = F.md5(F.concat(F.lit(f"{kind}:"), value.cast("string")))
    pieces = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    parts = [F.substring(digest, start, length) for start, length in pieces]
    return F.when(value.isNotNull(), F.concat_ws("-", *parts))


def make_ids(kind: str, values: str) -> Column:
    """The same for each element of an array; an empty array for null."""
    return F.coalesce(
        F.transform(values, lambda value: make_id(kind, value)), F.array().cast(STRINGS)
    )


def names_per(rows: DataFrame, key: str, output: str) -> DataFrame:
    """Sorted distinct part names per key."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("p_name")).alias(output))


def texts_of(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """Texts of the documents that may have these ids: the range of the ids reaches the scan, so that
    texts outside are not shuffled."""
    ends = keys.agg(F.min("doc_id"), F.max("doc_id")).first()
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("about_me"))
    return texts.where(F.col("doc_id").between(*ends))


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select(make_id("skill", "name").alias("id"), "name")


def majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        make_id("major", "n_name").alias("id"), F.col("n_name").alias("name")
    )


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bought = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    has_major = F.col("c_custkey") % 10 != 0
    customers = table(spark, sf_dir, "customer")
    texts = texts_of(spark, sf_dir, customers.select(F.col("c_custkey").alias("doc_id")))
    return (
        customers
        .join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(names_per(bought, "o_custkey", "skill_names"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(texts, F.col("doc_id") == F.col("c_custkey"), "left")
        .select(
            make_id("student", "c_custkey").alias("id"),
            F.col("c_name").alias("full_name"),
            F.when(has_major, make_id("major", "n_name")).alias("major_id"),
            F.when(has_major, F.col("n_name")).alias("major_name"),
            F.when(F.col("c_custkey") % 7 != 0, F.array("c_mktsegment")).alias("specialty_names"),
            "skill_names",
            "about_me",
            F.col("c_custkey").alias("place"),
        )
    )


def professors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    supplied = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_name")
    balance = F.col("s_acctbal")
    suppliers = table(spark, sf_dir, "supplier")
    texts = texts_of(spark, sf_dir, suppliers.select((F.col("s_suppkey") + 500).alias("doc_id")))
    return (
        suppliers
        .join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
        .join(names_per(supplied, "l_suppkey", "interest_areas"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(texts, F.col("doc_id") == F.col("s_suppkey") + 500, "left")
        .select(
            make_id("professor", "s_suppkey").alias("id"),
            F.col("s_name").alias("full_name"),
            F.col("n_name").alias("department"),
            F.when(balance >= 6000, "Full Professor")
            .when(balance >= 2000, "Associate Professor")
            .otherwise("Assistant Professor")
            .alias("rank"),
            (balance > 0).alias("is_accepting_projects"),
            "interest_areas",
            "about_me",
        )
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    documents = table(spark, sf_dir, "documents")
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey")
        .join(documents.select(F.col("doc_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    )
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .join(documents.select(F.col("doc_id").alias("o_orderkey")), "o_orderkey", "left_semi")
    )
    ordered = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_name")
    doc = F.col("doc_id")
    # Texts come last, so that they are shuffled once.
    placed = (
        orders.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(names_per(ordered, "l_orderkey", "skill_names"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    )
    return (
        documents.join(placed, F.col("o_orderkey") == doc)
        .select(
            make_id("project", doc).alias("id"),
            F.concat_ws(" ", "source", "lang", doc.cast("string")).alias("title"),
            F.col("text").alias("description"),
            make_id("provider", "source").alias("provider_id"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            "skill_names",
            F.when(doc % 5 != 0, make_id("major", "n_name")).alias("major_id"),
            F.when(doc % 5 != 0, F.col("n_name")).alias("major_name"),
            F.when(doc % 3 != 0, F.col("c_mktsegment")).alias("specialty_name"),
            doc.alias("place"),
        )
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        make_id("student", "user_id").alias("id"),
        F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"),
        F.col("event_type").alias("payload"),
    )


def student_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students with the id columns of the stored table and default labels."""
    return students(spark, sf_dir).withColumns(
        {
            "major_name": F.coalesce("major_name", F.lit("Undeclared")),
            "specialty_ids": make_ids("specialty", "specialty_names"),
            "skill_ids": make_ids("skill", "skill_names"),
        }
    )


def professor_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return professors(spark, sf_dir).withColumn(
        "research_interest_ids", make_ids("interest", "interest_areas")
    )


def project_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects(spark, sf_dir).withColumns(
        {
            "skill_ids": make_ids("skill", "skill_names"),
            "specialty_id": make_id("specialty", "specialty_name"),
        }
    )


def change_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed as student commands: the event's type becomes the profile text."""
    return changes(spark, sf_dir).select(
        "seq",
        "op",
        "id",
        F.concat(F.lit("Student "), F.substring("id", 1, 8)).alias("full_name"),
        F.lit(None).cast("string").alias("major_id"),
        F.array().cast(STRINGS).alias("specialty_ids"),
        F.array().cast(STRINGS).alias("skill_ids"),
        F.col("payload").alias("about_me"),
        F.lit("Undeclared").alias("major_name"),
        F.array().cast(STRINGS).alias("specialty_names"),
        F.array().cast(STRINGS).alias("skill_names"),
    )


def student_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per student; the default limit, their own major where they have one."""
    return students(spark, sf_dir).select(
        F.col("id").alias("request_id"),
        F.coalesce("major_name", F.lit("Undeclared")).alias("major_name"),
        "specialty_names",
        "skill_names",
        "about_me",
        F.col("major_id").alias("restrict_to_major_id"),
    )


def advisor_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per project; limits from 1 to 20."""
    return projects(spark, sf_dir).select(
        F.col("id").alias("request_id"),
        "title",
        "description",
        "major_name",
        "specialty_name",
        "skill_names",
        (F.col("place") % 20 + 1).cast("int").alias("limit"),
    )


def digest(vector: Column | str) -> Column:
    """A vector as text: its non-zero places with millionths."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    placed = F.transform(vector, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x")))
    shown = F.transform(
        F.filter(placed, lambda p: p["x"] != 0),
        lambda p: F.concat(
            p["i"].cast("string"),
            F.lit(":"),
            F.floor(p["x"] * 1e6 + 0.5).cast("long").cast("string"),
        ),
    )
    return F.array_join(shown, ",")
