"""Derived entity tables, on rows of their own."""

from catalogue import derived as d
from catalogue import spark_queries as q
from pairwright.schemas import SKILLS


def tables(spark, root):
    for name, rows, schema in (
        ("documents", [(1, "a", "en", "s"), (2, "b", "de", "t"), (501, "c", None, "s"), (9, "x", "en", "s")],
         "doc_id long, text string, lang string, source string"),
        ("orders", [(1, 7, "2020-01-01"), (2, 7, "2020-01-02"), (2, 8, "2020-01-03"), (5, 8, "2020-01-04")],
         "o_orderkey long, o_custkey long, o_orderdate string"),
        ("customer", [(7, 0, "m"), (8, 0, "n")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        ("nation", [(0, "N")], "n_nationkey int, n_name string"),
        ("part", [(1, "p"), (2, "q")], "p_partkey long, p_name string"),
        ("lineitem", [(1, 1, 1), (1, 2, 1), (5, 1, 1)], "l_orderkey long, l_partkey long, l_suppkey long"),
        ("supplier", [(1, "S", 0, 10.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def joins_above(df, column):
    """Joins that the relation with this column goes through."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Relation" in line and f"{column}#" in line)
    depth, n = len(lines[at]) - len(lines[at].lstrip(" :+-")), 0
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            depth, n = own, n + ("Join" in line)
    return n


def test_texts_of_projects_are_joined_once(spark, tmp_path):
    found = d.projects(spark, tables(spark, tmp_path))
    assert joins_above(found, "text") == 1
    rows = sorted((r.title, r.skill_names, r.specialty_name) for r in found.collect())
    assert rows == [("s en 1", ["p", "q"], "m"), ("t de 2", None, "m"), ("t de 2", None, "n")]


def test_only_texts_in_the_range_of_the_ids_are_joined(spark, tmp_path):
    found = d.professors(spark, tables(spark, tmp_path))
    assert [r.about_me for r in found.collect()] == ["c"]
    assert "doc_id" in found._jdf.queryExecution().optimizedPlan().toString().split("<= 501")[0]


def test_json_commands_are_written_compressed(spark, tmp_path):
    commands = spark.createDataFrame([("a", "n")], "id string, name string")
    files = q.as_json(spark, commands, SKILLS).inputFiles()
    assert files and all(name.endswith(".json.gz") for name in files)
