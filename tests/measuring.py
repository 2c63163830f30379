
from __future__ import annotations

import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pyspark.sql import functions as F

import __spark_entry__ as contract
import checking
from catalogue import derived as d
from catalogue import spark_queries as q
from pairwright.operators.embed import hashing_embedder
from pairwright.operators.knn import nearest
from pairwright.plans.recommend import recommend_projects, recommend_skills, suggest_professors
from pairwright.plans.sync import bulk_sync, sync
from pairwright.schemas import (
    ADVISOR_REQUESTS,
    PROFESSORS,
    PROJECT_REQUESTS,
    PROJECTS,
    SKILLS,
    STUDENTS,
)
from pairwright.sources.payloads import accept_requests
from pairwright.sources.store import VersionedTable, scratch_root

sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
spark = checking.session(int(os.environ.get("BENCH_CPUS", "8")))
contract.ship(spark)
embedder = hashing_embedder()


def kept(df):
    path = f"{scratch_root(spark)}/kept"
    df.write.parquet(path)
    return spark.read.parquet(path)


def measure(name, run, units=0, unit="rows"):
    times = []
    for _ in range(6):
        start = time.perf_counter()
        df = run()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    seconds = statistics.median(times[1:])
    rate = f" {units / seconds:,.0f} {unit}/s" if units else ""
    print(f"| {name} | {seconds:.2f} s |{rate} |", flush=True)


vectors = q.vector_requests(spark, sf_dir)
candidates = q.vector_candidates(spark, sf_dir)
n = candidates.count()
for plan in ("candidates", "requests", "grid"):
    for m in (500, n):
        few = kept(vectors.limit(m))
        measure(
            f"search, {plan}, {m} x {n}, 64-d, top 10",
            lambda: nearest(few, candidates, dimension=64, plan=plan, n_candidates=n),
            m * n,
            "pairs",
        )

students = kept(d.student_commands(spark, sf_dir))
projects = kept(d.project_commands(spark, sf_dir))
tables = {}
for spec, commands in (
    (STUDENTS, students),
    (PROJECTS, projects),
    (PROFESSORS, kept(d.professor_commands(spark, sf_dir))),
    (SKILLS, kept(d.skills(spark, sf_dir))),
):
    tables[spec.table] = VersionedTable(spark, scratch_root(spark), spec)
    rows = commands.count()
    measure(
        f"bulk sync, {rows} {spec.table}",
        lambda: bulk_sync(tables[spec.table], commands, embedder) and None,
        rows,
    )

asked = kept(accept_requests(d.student_requests(spark, sf_dir), PROJECT_REQUESTS)[0])
m = asked.count()
for name, run, table in (
    ("recommend projects", recommend_projects, tables["project_templates"]),
    ("recommend skills", recommend_skills, tables["skills"]),
):
    measure(f"{name}, {m} requests", lambda: run(asked, table.read(), embedder, table.row_bound()), m, "requests")
asked = kept(accept_requests(d.advisor_requests(spark, sf_dir), ADVISOR_REQUESTS)[0])
m = asked.count()
table = tables["professors"]
measure(
    f"suggest professors, {m} requests",
    lambda: suggest_professors(asked, table.read(), embedder, table.row_bound()),
    m,
    "requests",
)

for share in (0.01, 0.5):
    changed = kept(students.where(F.pmod(F.xxhash64("id"), F.lit(1000)) < int(share * 1000)))
    rows = changed.count()

    def merge():
        fresh = VersionedTable(spark, scratch_root(spark), STUDENTS)
        state = tables["students"].state()
        # The same base under a new table, so that every run merges into one change set.
        fresh.path = tables["students"].path
        fresh.state = lambda: state
        fresh._commit = lambda before, **changes: {**before, **changes}
        fresh.merge(changed.withColumn("vector", F.lit(None).cast("array<float>")))

    measure(f"merge of {rows} changed students ({share:.0%})", merge, rows)
feed = kept(d.change_commands(spark, sf_dir))
rows = feed.count()
measure(
    f"sync of {rows} changes, {feed.select('id').distinct().count()} ids",
    lambda: sync(VersionedTable(spark, scratch_root(spark), STUDENTS), feed, embedder) and None,
    rows,
)
measure(f"stream of {rows} changes, 3 files a batch", lambda: q.stream_change_feed(spark, sf_dir), rows)
