"""Embedding, lookups, pipelines and streams."""

import dataclasses
import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwright.errors import EmbeddingError, StoreError
from pairwright.functions import l2_normalize
from pairwright.operators.embed import (
    Embedder,
    embed,
    embed_once,
    hashing_embedder,
    sentence_transformer_embedder,
    text_batches,
)
from pairwright.operators.lookup import enrich, lookup, name_of, names_by_ids, row_of
from pairwright.operators.metrics import append_run, chunk_plan, observed, run_metrics
from pairwright.plans.recommend import id_lists, recommend_projects, recommend_skills, suggest_professors
from pairwright.plans.sync import bulk_sync, sync
from pairwright.schemas import (
    ADVISOR_REQUESTS,
    PROFESSORS,
    PROJECT_REQUESTS,
    PROJECTS,
    SKILL_REQUESTS,
    SKILLS,
)
from pairwright.sources.payloads import accept_requests, read_feed, typed
from pairwright.sources.store import VersionedTable
from pairwright.streaming.feed import stream_sync


def ident(number):
    return f"00000000-0000-0000-0000-{number:012d}"


def vectors(df):
    return np.array([r.vector for r in df.collect()], "f8")


def recording(path, dimension=4, fail=None, rows=2):
    """An embedder that writes the texts of each call to a file and may fail."""

    def load():
        def predict(texts):
            with open(path, "a") as log:
                log.write(json.dumps(list(texts)) + "\n")
            if fail and any(fail in t for t in texts):
                raise RuntimeError("out of memory")
            return np.array([[len(t), 1.0, 0.0, 0.0][:dimension] for t in texts])

        return predict

    return Embedder(load, 4, rows)


def calls(path):
    return [json.loads(line) for line in open(path)]


# -- embedding ---------------------------------------------------------------------


def test_prefix_batch_size_order_and_unit_length(spark, tmp_path):
    log = str(tmp_path / "log")
    texts = [f"text {'x' * n}" for n in range(7)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    got = embed(df, "t", recording(log, rows=3), kind="query").collect()
    assert [t for call in calls(log) for t in call] == [f"search_query: {t}" for t in texts]
    assert [len(call) for call in calls(log)] == [3, 3, 1]
    lengths = [len("search_query: ") + len(t) for t in texts]
    for row, length in zip(got, lengths):
        assert row.vector[0] / row.vector[1] == pytest.approx(length, rel=1e-6)
        assert np.linalg.norm(row.vector) == pytest.approx(1.0, abs=1e-6)


def test_equal_texts_of_a_batch_are_embedded_once(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([(t,) for t in ("a", "b", "a", "a")], "t string").coalesce(1)
    got = embed(df, "t", recording(log, rows=128))
    assert got.select("vector").distinct().count() <= 2
    assert sorted(calls(log)[0]) == ["search_document: a", "search_document: b"]


def test_batches_are_bounded_by_rows_and_characters():
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = rng.integers(0, 40, int(rng.integers(0, 60)))
        lengths[rng.random(len(lengths)) < 0.1] = 500
        batches = list(text_batches(lengths, 7, 120))
        assert sorted(np.concatenate(batches).tolist() if batches else []) == list(range(len(lengths)))
        for batch in batches:
            assert len(batch) <= 7
            assert len(batch) == 1 or lengths[batch].max() * len(batch) <= 120


def test_one_long_text_does_not_widen_the_others(spark, tmp_path):
    log = str(tmp_path / "log")
    texts = ["x" * 5000] + [f"t{i:02d}" for i in range(40)]
    embedder = dataclasses.replace(recording(log, rows=16), batch_chars=16 * 30)
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    got = {r.n: r.vector for r in embed(df, "t", embedder).collect()}
    assert sorted(len(call) for call in calls(log)) == [1, 8, 16, 16]
    assert [len(call[0]) > 5000 for call in calls(log)] == [False, False, False, True]
    for n, text in enumerate(texts):
        assert got[n][0] / got[n][1] == pytest.approx(len("search_document: ") + len(text), rel=1e-6)


def test_each_distinct_text_of_a_table_is_embedded_once(spark, tmp_path, monkeypatch):
    """A third of the rows are one text; by broadcast and by shuffle."""
    from pairwright.operators import joins

    texts = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"text {i % 40}") for i in range(300)]
    df = spark.createDataFrame(texts, "n int, t string").repartition(5)
    for fits in (1 << 20, 300):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", fits)
        log = str(tmp_path / f"log{fits}")
        got = {r.n: r.vector for r in embed_once(df, "t", recording(log), kind="query").collect()}
        asked = [t for call in calls(log) for t in call]
        assert sorted(asked) == sorted({f"search_query: {t}" for _, t in texts if t is not None})
        for n, text in texts:
            if text is None:
                assert got[n] is None
            else:
                assert got[n][0] / got[n][1] == pytest.approx(len("search_query: ") + len(text), rel=1e-6)
        assert len(got) == 300


def test_null_text_has_no_vector_and_no_rows_are_fine(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    got = {r.t: r.vector for r in embed(df, "t", hashing_embedder()).collect()}
    assert got[None] is None and len(got["a"]) == 768
    assert embed(df.where("false"), "t", hashing_embedder()).count() == 0


def test_wrong_dimension_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match="EmbeddingError: model returned shape"):
        embed(df, "t", recording(str(tmp_path / "log"), dimension=3)).collect()


@pytest.mark.parametrize("pinned", [{}, {"revision": "abc", "trust_remote_code": True}])
def test_sentence_transformer_model(spark, tmp_path, pinned):
    """A stand-in for the library records how it is called; an older one knows no revision."""
    log = tmp_path / "log"
    name = f"stand_in_{len(pinned)}"
    (tmp_path / f"{name}.py").write_text(
        "import numpy as np\n"
        "class SentenceTransformer:\n"
        "    def __init__(self, name, device, trust_remote_code" + (", revision" if pinned else "") + "):\n"
        "        given = f'{trust_remote_code} " + ("{revision}" if pinned else "-") + "'\n"
        f"        open({str(log)!r}, 'a').write(f'load {{name}} {{device}} {{given}}\\n')\n"
        "    def encode(self, texts, normalize_embeddings):\n"
        f"        open({str(log)!r}, 'a').write(f'encode {{len(texts)}} {{normalize_embeddings}}\\n')\n"
        "        return np.array([[1.0, len(t)] for t in texts])\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    embedder = sentence_transformer_embedder("some-model", 2, "cpu", **pinned)

    def load():
        import importlib
        import sys

        sys.modules["sentence_transformers"] = importlib.import_module(name)
        return embedder.load()

    df = spark.range(300).selectExpr("cast(id as string) as t").coalesce(1)
    got = embed(df, "t", Embedder(load, 2, embedder.batch_rows)).collect()
    assert log.read_text().splitlines() == [
        "load some-model cpu " + ("True abc" if pinned else "False -"),
        "encode 128 True",
        "encode 128 True",
        "encode 44 True",
    ]
    assert all(np.linalg.norm(r.vector) == pytest.approx(1.0, abs=1e-6) for r in got)


def test_model_that_does_not_load_is_named(spark):
    df = spark.createDataFrame([("a",)], "t string")

    def load():
        raise RuntimeError("no weights")

    with pytest.raises(Exception, match="EmbeddingError: model did not load"):
        embed(df, "t", Embedder(load)).collect()


def test_hashing_reads_whole_texts_and_words_of_all_scripts(spark):
    long = "filler " * 50_000
    df = spark.createDataFrame(
        [(long,), (long + "übermut",), ("übermut naïve 東京",), ("ÜBERMUT, naïve; 東京!",)], "t string"
    ).coalesce(1)
    got = vectors(embed(df, "t", hashing_embedder()))
    assert (got[0] != got[1]).any()
    assert (got[2] == got[3]).all()


def test_normalize_keeps_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [list(r[0]) for r in df.select(l2_normalize("v")).collect()]
    assert got[1] == [0.0, 0.0] and got[0] == pytest.approx([0.6, 0.8])


# -- lookups -----------------------------------------------------------------------


def test_names_lookup_and_labels(spark):
    table = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, name string")
    ids = spark.createDataFrame([("b",), ("a",), ("b",), ("z",)], "id string")
    for n in (None, 4):
        assert sorted(r.name for r in names_by_ids(table, ids, n_ids=n).collect()) == ["A", "B"]
        found = lookup(table, ids, ["name"], n_ids=n)
        got = sorted((r.id, r.name or "", r.found) for r in found.collect())
        assert got == [("a", "A", True), ("b", "B", True), ("b", "B", True), ("z", "", False)]
    assert names_by_ids(table, ids.where("false")).count() == 0
    records = spark.createDataFrame(
        [("1", ["c", "z", "a", "c"]), ("2", []), ("3", None)], "id string, ids array<string>"
    )
    single = spark.createDataFrame([("1", "a"), ("2", "z"), ("3", None)], "id string, ref string")
    named = {r.id: r.label for r in name_of(single, "ref", table, "label").collect()}
    assert named == {"1": "A", "2": None, "3": None}
    named = {r.id: r.names for r in enrich(records, "ids", table, "names").collect()}
    assert named == {"1": ["C", "A", "C"], "2": [], "3": []}


def test_lookup_only_scans_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("cast(id as string) as id", "'n' as name", "'x' as other").write.parquet(path)
    ids = spark.createDataFrame([("5",)], "id string")
    plan = lookup(spark.read.parquet(path), ids, ["name"], n_ids=1)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,name:string>" in plan
    assert "BroadcastHashJoin [id" in plan and "LeftSemi" in plan
    stored = spark.read.parquet(path).withColumn("id", F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad("id", 12, "0")))
    assert row_of(stored, ident(7)).count() == row_of(stored, ident(7).replace("-", "")).count() == 1
    assert row_of(stored, "bad").count() == row_of(stored, ident(5000)).count() == 0


def test_metrics(spark, tmp_path):
    items = spark.range(300).withColumnRenamed("id", "pos")
    plan = sorted(map(tuple, chunk_plan(items).collect()))
    assert plan == [(1, 128, 3), (2, 128, 3), (3, 44, 3)]
    assert tuple(run_metrics(items, "s").first()) == ("s", 300, 3)
    assert tuple(run_metrics(items.where("false"), "s").first()) == ("s", 0, 0)
    counted, observation = observed(items, "write")
    counted.write.parquet(str(tmp_path / "out"))
    assert observation.get == {"n_rows": 300}
    for n in (300, 5):
        figures = {"run": "r1", "stage": "bulk", "rows": n, "chunks": -(-n // 128), "at": "2024-05-06T07:08:09+00:00"}
        append_run(spark, str(tmp_path / "runs"), figures)
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert sorted((r.n_rows, r.n_chunks, r.n_calls) for r in runs.collect()) == [(5, 1, None), (300, 3, None)]


# -- pipelines ---------------------------------------------------------------------


def skills(spark, *names):
    return spark.createDataFrame([(ident(i), n) for i, n in enumerate(names)], "id string, name string")


def test_only_the_newest_command_is_embedded(spark, root, tmp_path):
    log = str(tmp_path / "log")
    commands = spark.createDataFrame(
        [("a", "old", 1), ("a", "new", 2), ("b", "only", 1)], "id string, name string, seq long"
    )
    table = VersionedTable(spark, root, SKILLS)
    bulk_sync(table, commands, recording(log))
    texts = sorted(t.rsplit(" ", 1)[1] for call in calls(log) for t in call)
    assert texts == ["new", "only"]
    assert {r.id: r.name for r in table.read().collect()} == {"a": "new", "b": "only"}


def test_failed_embedding_is_named_and_leaves_the_table(spark, root, tmp_path):
    table = VersionedTable(spark, root, SKILLS)
    bulk_sync(table, skills(spark, "one"), hashing_embedder())
    before = table.state()
    broken = recording(str(tmp_path / "log"), fail="boom")
    for run in (sync, bulk_sync):
        with pytest.raises(EmbeddingError):
            run(table, skills(spark, "fine", "boom"), broken)
    with pytest.raises(StoreError):
        sync(table, skills(spark, "x").withColumn("name", F.raise_error(F.lit("no"))), hashing_embedder())
    assert table.state() == before


def test_replaced_table_is_ordered_for_its_filter(spark, root):
    table = VersionedTable(spark, root, PROFESSORS)
    commands = spark.range(200).selectExpr(
        "concat('p', id) as id", "'n' as full_name", "'d' as department", "'r' as rank",
        "id % 2 = 0 as is_accepting_projects", "array() as research_interest_ids",
        "'t' as about_me", "array() as interest_areas",
    )
    bulk_sync(table, commands, hashing_embedder(8))
    stored = spark.read.parquet(f"{table.path}/data/{table.state()['base']}")
    per_file = stored.groupBy(F.input_file_name()).agg(F.count_distinct("is_accepting_projects").alias("n"))
    mixed = per_file.where("n > 1").count()
    assert mixed <= 1
    accepting = table.read().where("is_accepting_projects").select("id")
    plan = accepting._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_accepting_projects," in plan and "vector" not in plan
    assert accepting.count() == 100


PROJECT = (
    "id string, title string, description string, provider_id string, created_at string, "
    "skill_ids array<string>, major_id string, specialty_id string, "
    "major_name string, specialty_name string, skill_names array<string>"
)


def test_recommendations(spark, root):
    embedder = hashing_embedder()
    projects = VersionedTable(spark, root, PROJECTS)
    given = [
        (ident(1), "Pond", "ferns", ident(9), "2026-01-01", [], ident(50), None, "Botany", None, []),
        (ident(2), "Lake", "boats", ident(9), "2026-01-01", [], ident(51), None, "Geography", None, []),
        (ident(3), "Open", "ferns ferns", ident(9), "2026-01-01", [], None, None, None, None, []),
    ]
    bulk_sync(projects, typed(spark.createDataFrame(given, PROJECT), PROJECTS), embedder)
    asked = spark.createDataFrame(
        [("free", "Botany", "ferns", None), ("own", "Botany", "ferns", ident(50)), ("none", "Botany", "ferns", ident(77))],
        "request_id string, major_name string, about_me string, restrict_to_major_id string",
    )
    requests, _ = accept_requests(asked, PROJECT_REQUESTS)
    got = recommend_projects(requests, projects.read(), embedder, projects.row_bound()).collect()
    found = {}
    for row in sorted(got, key=lambda r: r.rank):
        found.setdefault(row.request_id, []).append(row.id)
    # Restricted requests do not get the project without a major.
    assert found["own"] == [ident(1)] and "none" not in found
    assert set(found["free"]) == {ident(1), ident(2), ident(3)}
    ranked = recommend_projects(requests, projects.read(), embedder, projects.row_bound())
    assert {r.request_id: r.ids for r in id_lists(ranked, requests).collect()} == {**found, "none": []}

    professors = VersionedTable(spark, f"{root}/p", PROFESSORS)
    people = spark.createDataFrame(
        [(ident(1), True), (ident(2), False), (ident(3), True)], "id string, is_accepting_projects boolean"
    ).selectExpr(
        "*", "'N' as full_name", "'D' as department", "'R' as rank", "cast(array() as array<string>) as research_interest_ids",
        "cast(null as string) as about_me", "array('ferns') as interest_areas",
    )
    bulk_sync(professors, people, embedder)
    asked = spark.createDataFrame([("r", "T", "ferns", 2)], "request_id string, title string, description string, limit int")
    requests, _ = accept_requests(asked, ADVISOR_REQUESTS)
    got = suggest_professors(requests, professors.read(), embedder)
    assert [r.id for r in got.orderBy("rank").collect()] == [ident(1), ident(3)]

    known = VersionedTable(spark, f"{root}/s", SKILLS)
    bulk_sync(known, skills(spark, "ferns", "boats", "rust"), embedder)
    asked = spark.createDataFrame(
        [("r", "Botany", ["ferns"])], "request_id string, major_name string, skill_names array<string>"
    )
    requests, _ = accept_requests(asked, SKILL_REQUESTS)
    got = recommend_skills(requests, known.read(), embedder)
    # A skill the student has is not taken out.
    assert got.where("rank = 1").first().id == ident(0) and got.count() == 3


# -- streams -----------------------------------------------------------------------


def land(folder, name, *changes):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(c) for c in changes))


def up(seq, number, name):
    return {"seq": seq, "op": "U", "skill": {"id": ident(number), "name": name}}


FILES = [
    [up(1, 1, "a"), up(2, 2, "b")],
    [up(3, 1, "a2"), {"seq": 4, "op": "D", "id": ident(2)}, {"seq": 5, "op": "U", "skill": {"id": "bad"}}],
    [up(6, 3, "c"), up(7, 3, "c2")],
]


def drain(spark, folder, table, checkpoint, name):
    feed = read_feed(spark, SKILLS, str(folder), maxFilesPerTrigger="1")
    stream_sync(feed, table, hashing_embedder(8), checkpoint, name=name, available_now=True).awaitTermination()


def skill_rows(spark, embedder):
    names = spark.createDataFrame([(ident(i), "skill " + "x" * i) for i in range(12)], "id string, name string")
    return embed(names, "name", embedder).select("id", "name", "vector")


def skill_requests(spark, n):
    """A third of them ask the same, others alike but for the limit."""
    hot = ("always", ["this"])
    rows = [(f"r{i:03d}", *(hot if i % 3 == 0 else (f"about {i % 7}", [f"y{i % 5}"])), 3 + i % 2) for i in range(n)]
    requests = spark.createDataFrame(rows, "request_id string, major_name string, specialty_names array<string>, limit int")
    return accept_requests(requests, SKILL_REQUESTS)[0]


def test_questions_are_embedded_and_answered_once(spark, tmp_path, monkeypatch):
    from pairwright.operators import joins

    skills = skill_rows(spark, recording(str(tmp_path / "skills")))
    requests = skill_requests(spark, 90)
    expected = sorted(map(tuple, recommend_skills(requests, skills, recording(str(tmp_path / "all"))).collect()))
    assert len(expected) == sum(3 + i % 2 for i in range(90))
    distinct = {t for call in calls(str(tmp_path / "all")) for t in call}
    for fits in (1 << 20, 64 * 101 * 2):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", fits)
        log = str(tmp_path / f"log{fits}")
        got = recommend_skills(requests, skills, recording(log), once=True)
        assert sorted(map(tuple, got.collect())) == expected
        asked = [t for call in calls(log) for t in call]
        assert len(asked) == len(set(asked)) and set(asked) == distinct


def test_one_pass_embeds_and_searches(spark, tmp_path):
    """One Python node, and texts of a scan with enough splits are not shuffled."""
    skills = skill_rows(spark, hashing_embedder())
    cores = spark.sparkContext.defaultParallelism
    path = str(tmp_path / "requests")
    skill_requests(spark, 90).repartition(cores).write.parquet(path)
    wide = recommend_skills(spark.read.parquet(path), skills, hashing_embedder())
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "Exchange" not in plan
    skill_requests(spark, 90).coalesce(1).write.parquet(path + "1")
    narrow = recommend_skills(spark.read.parquet(path + "1"), skills, hashing_embedder())
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, narrow.collect()))


@pytest.mark.parametrize("plan", ["requests", "grid"])
def test_texts_are_embedded_for_large_sides_too(spark, plan):
    from pairwright.operators.knn import nearest

    skills = skill_rows(spark, hashing_embedder())
    asked = skill_requests(spark, 30).select("request_id", "limit", F.col("major_name").alias("t"))
    settings = {"embedder": hashing_embedder(), "text": "t"}
    expected = sorted(map(tuple, nearest(asked, skills, plan="candidates", **settings).collect()))
    got = nearest(asked, skills, plan=plan, **settings)
    assert expected and sorted(map(tuple, got.collect())) == expected


def test_requests_of_large_sides_are_derived_once(spark, monkeypatch):
    from pairwright.operators import knn

    skills = skill_rows(spark, hashing_embedder())
    asked = skill_requests(spark, 30).select("request_id", "limit", F.col("major_name").alias("t"))
    settings = {"embedder": hashing_embedder(), "text": "t", "n_candidates": 12}
    expected = sorted(map(tuple, knn.nearest(asked, skills, **settings).collect()))
    derived = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            derived.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(knn, "BROADCAST_BYTES", 10 * 4 * 768)
    got = knn.nearest(asked.mapInArrow(passed, asked.schema), skills, **settings)
    assert expected and sorted(map(tuple, got.collect())) == expected
    assert derived.value == 30


def test_stream_in_order_late_and_replayed_end_alike(spark, root, tmp_path):
    expected = {ident(1): "a2", ident(3): "c2"}
    for case, order in {"in_order": (0, 1, 2), "late": (2, 1, 0)}.items():
        landing = tmp_path / case
        table = VersionedTable(spark, f"{root}/{case}", SKILLS)
        checkpoint = str(tmp_path / f"{case}-progress")
        for place, number in enumerate(order):
            land(landing, f"{place}.json", *FILES[number])
            drain(spark, landing, table, checkpoint, case)
        assert {r.id: r.name for r in table.read().collect()} == expected
        # A lost checkpoint replays everything under the old batch numbers or new ones.
        before = table.state()
        drain(spark, landing, table, str(tmp_path / f"{case}-lost"), case)
        assert table.state() == before
        drain(spark, landing, table, str(tmp_path / f"{case}-other"), f"{case}_other")
        assert {r.id: r.name for r in table.read().collect()} == expected
        rejected = spark.read.parquet(f"{table.path}/rejected/{case}-*")
        assert [sorted(r.reasons) for r in rejected.collect()] == [["id: not a uuid", "name: missing"]]


def test_enrich_by_map_and_by_join(spark, monkeypatch):
    from pairwright.operators import lookup

    dimension = spark.createDataFrame([("x", "X"), ("y", "Y"), (None, "none")], "id string, name string")
    records = spark.createDataFrame(
        [("k", ["x", "?", "y", "x"]), ("k", ["y"]), ("k", ["y"]), ("m", []), ("n", None), (None, ["x", None])],
        "key string, ids array<string>",
    )
    expected = sorted(["X,Y,X", "Y", "Y", "", "", "X"])
    for rows in (256, 1):
        monkeypatch.setattr(lookup, "MAP_ROWS", rows)
        named = lookup.enrich(records, "ids", dimension, "names", key="key")
        assert sorted(",".join(r.names) for r in named.collect()) == expected
        plan = named._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" in plan) == (rows == 1)


def test_runs_record_their_figures(spark, root, tmp_path):
    table = VersionedTable(spark, root, SKILLS, dimension=8)
    assert table.runs().count() == 0
    named = [(ident(n), f"skill {n % 200}") for n in range(300)]
    rows = spark.createDataFrame(named, "id string, name string").coalesce(1)
    path = str(tmp_path / "metrics")
    bulk_sync(table, rows, hashing_embedder(8, batch_rows=50), metrics=("run 1", path))
    sync(table, rows.limit(2), hashing_embedder(8), metrics=("run 2", path))
    late = rows.limit(3).select(F.concat(F.lit("x"), "id").alias("id"), "name", F.lit(-1).cast("long").alias("seq"))
    sync(table, late, hashing_embedder(8), metrics=("run 3", path))
    expected = {
        ("run 1", "bulk_sync skills", 300, 0, 3, 200, 4),
        ("run 2", "sync skills", 2, 0, 1, 2, 1),
        ("run 3", "sync skills", 0, 3, 1, 3, 1),
    }
    names = ("run", "stage", "n_rows", "n_rejected", "n_chunks", "n_texts", "n_calls")
    appended = spark.read.parquet(path)
    assert {tuple(r[n] for n in names) for r in appended.collect()} == expected
    names = ("run", "stage", "rows", "rejected", "chunks", "texts", "calls")
    assert {tuple(r[n] for n in names) for r in table.runs().collect()} == expected
    # A run that changes nothing makes no version and has no figures.
    sync(table, rows.limit(0), hashing_embedder(8), metrics=("run 4", path))
    assert spark.read.parquet(path).count() == 3
    # Maintenance makes versions without figures.
    table.compact()
    assert table.runs().count() == 3


def test_batches_of_a_stream_record_their_figures(spark, root, tmp_path):
    table = VersionedTable(spark, root, SKILLS)
    path = str(tmp_path / "metrics")
    for place, number in enumerate((0, 1, 2)):
        land(tmp_path / "landing", f"{place}.json", *FILES[number])
        feed = read_feed(spark, SKILLS, str(tmp_path / "landing"))
        stream_sync(feed, table, recording(str(tmp_path / "log")), str(tmp_path / "progress"), "s", True, metrics=path).awaitTermination()
    appended = sorted((r.run, r.n_rows, r.n_texts) for r in spark.read.parquet(path).collect())
    assert [run for run, _, _ in appended] == ["s 0", "s 1", "s 2"]
    assert sum(texts for _, _, texts in appended) == sum(len(set(call)) for call in calls(str(tmp_path / "log")))
    assert sorted((r.run, r.rows, r.texts) for r in table.runs().collect()) == appended


def test_enrich_treats_null_names_and_repeated_ids_alike_in_both_plans(spark, monkeypatch):
    table = spark.createDataFrame(
        [("a", "A"), ("b", None), ("c", "C2"), ("c", "C1"), (None, "N")], "id string, name string"
    )
    records = spark.createDataFrame(
        [("r", ["c", "b", "a", None, "x"]), ("s", ["b"]), ("t", None)], "id string, ids array<string>"
    )
    for rows in (256, 0):
        monkeypatch.setitem(enrich.__globals__, "MAP_ROWS", rows)
        named = {r.id: r.names for r in enrich(records, "ids", table, "names").collect()}
        assert named == {"r": ["C1", "A"], "s": [], "t": []}


def test_vectors_of_a_batch_are_sent_in_parts(monkeypatch):
    """A worker holds one vector per distinct text and sends few rows at a time; splitting into words
    a part of the texts at a time changes nothing."""
    from pairwright.operators import embed

    texts = pa.array([f"word{i % 700} and other{i % 700}" for i in range(3000)] + [None, ""])
    embedder = embed.hashing_embedder(16)
    whole = embed.unit_vectors(embedder, texts)
    monkeypatch.setattr(embed, "WORD_CHARS", 100)
    monkeypatch.setattr(embed, "_last", {})
    parts = list(embed.unit_parts(embedder, texts))
    assert [len(part) for part in parts] == [1024, 1024, 954]
    assert (np.concatenate(parts) == whole).all()


def test_large_inputs_are_derived_once_and_moved_once(spark, root, tmp_path, monkeypatch):
    from pairwright.operators import changes
    from pairwright.plans import sync as plans

    named = [(ident(n % 40), f"skill {n}", n) for n in range(60)]
    commands = spark.createDataFrame(named, "id string, name string, seq long")
    derived = commands.join(spark.range(50).select(F.col("id").alias("seq")), "seq")
    tables = [VersionedTable(spark, f"{root}/{name}", SKILLS) for name in ("whole", "narrow")]
    bulk_sync(tables[0], derived, hashing_embedder(8))
    kept = []
    real = plans.stored
    monkeypatch.setattr(plans, "stored", lambda rows: kept.append(real(rows)) or kept[-1])
    monkeypatch.setattr(changes, "SHUFFLED_BYTES", 0)
    bulk_sync(tables[1], derived, hashing_embedder(8), metrics=("narrow", str(tmp_path / "runs")))
    rows = [sorted(map(str, table.read().collect())) for table in tables]
    assert rows[0] == rows[1] and len(rows[0]) == 40
    # Its repeated ids are settled in scratch, which is gone.
    assert len(kept) == 1 and not os.path.exists(kept[0]._scratch)
    assert tuple(spark.read.parquet(str(tmp_path / "runs")).select("n_rows", "n_texts").first()) == (40, 40)
    sync(tables[1], derived.withColumn("seq", F.lit(None).cast("long")).limit(7), hashing_embedder(8))
    assert tables[1].read().count() == 40 and len(kept) == 2
