"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import derived as d
from pairwright.errors import EmbeddingError, StoreError
from pairwright.functions import (
    advisor_query,
    canonical_uuid,
    join_or,
    l2_normalize,
    prefixed,
    professor_document,
    project_document,
    project_query,
    skill_document,
    skill_query,
    squared_l2,
    strip_text,
    student_document,
    text_or,
    with_period,
)
from pairwright.functions import wording as w
from pairwright.operators import changes as keyed
from pairwright.operators.embed import (
    BATCH_CHARS,
    BATCH_ROWS,
    Embedder,
    embed,
    embed_once,
    hashing_embedder,
)
from pairwright.operators.knn import nearest, nearest_one
from pairwright.operators.lookup import enrich, lookup, name_of, names_by_ids
from pairwright.operators.metrics import chunk_plan
from pairwright.operators.validate import command_problems, request_problems
from pairwright.plans.recommend import (
    id_lists,
    recommend_projects,
    recommend_skills,
    suggest_professors,
)
from pairwright.plans.sync import bulk_sync, delete_commands, sync, vectorize
from pairwright.schemas import (
    ADVISOR_REQUESTS,
    PROFESSORS,
    PROJECT_REQUESTS,
    PROJECTS,
    SKILL_REQUESTS,
    SKILLS,
    STUDENTS,
    VECTOR,
    EntitySpec,
)
from pairwright.sources.bulkitems import explode_streamed
from pairwright.sources.payloads import (
    accept,
    accept_requests,
    explode_items,
    read_commands,
    read_feed,
    read_requests,
    typed,
    unpack,
)
from pairwright.scratch import in_scope, scope
from pairwright.scratch import stored as derived_once
from pairwright.sources.store import VersionedTable, scratch_root
from pairwright.streaming.feed import stream_sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# White space put around texts to be stripped: plain, no-break, ideographic, separators.
PADDING = "\t\x20\xa0\u3000\x1c\u2028\x20"

EMBEDDING_DIMENSION = 64  # of the driver's `embeddings`


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def listed(column: str) -> Column:
    """An array as text, so that both engines compare it alike."""
    return F.array_join(column, "|")


# -- texts ------------------------------------------------------------------


@query
def doc_skill(spark, sf_dir):
    return d.skills(spark, sf_dir).select("id", skill_document().alias("document"))


@query
def doc_student(spark, sf_dir):
    return d.student_commands(spark, sf_dir).select("id", student_document().alias("document"))


@query
def doc_professor(spark, sf_dir):
    return d.professors(spark, sf_dir).select("id", professor_document().alias("document"))


@query
def doc_project(spark, sf_dir):
    return d.projects(spark, sf_dir).select("id", project_document().alias("document"))


@query
def query_project(spark, sf_dir):
    requests, _ = accept_requests(d.student_requests(spark, sf_dir), PROJECT_REQUESTS)
    return requests.select("request_id", project_query().alias("query"))


@query
def query_skill(spark, sf_dir):
    requests, _ = accept_requests(d.student_requests(spark, sf_dir), SKILL_REQUESTS)
    return requests.select("request_id", skill_query().alias("query"))


@query
def query_advisor(spark, sf_dir):
    requests, _ = accept_requests(d.advisor_requests(spark, sf_dir), ADVISOR_REQUESTS)
    return requests.select("request_id", advisor_query().alias("query"))


def padded(text: str) -> Column:
    return F.concat(F.lit(PADDING), F.col(text), F.lit(PADDING))


@query
def strip_text_(spark, sf_dir):
    documents = d.table(spark, sf_dir, "documents")
    return documents.select("doc_id", strip_text(padded("text")).alias("stripped"))


@query
def join_or_fallback(spark, sf_dir):
    return d.students(spark, sf_dir).select(
        "id",
        join_or("specialty_names", w.STUDENT_NO_SPECIALTIES).alias("specialties"),
        join_or("skill_names", w.STUDENT_NO_SKILLS).alias("skills"),
    )


@query
def text_or_fallback(spark, sf_dir):
    """Null, empty, blank and padded texts; most documents keep theirs."""
    documents = d.table(spark, sf_dir, "documents").select("doc_id", "text")
    case = F.col("doc_id") % 40
    text = (
        F.when(case == 0, F.lit(None).cast("string"))
        .when(case == 1, F.lit(PADDING))
        .when(case == 2, F.lit(""))
        .otherwise(padded("text"))
    )
    return documents.select("doc_id", text_or(text, w.STUDENT_NO_ABOUT).alias("about"))


@query
def normalize_description(spark, sf_dir):
    documents = d.table(spark, sf_dir, "documents")
    return documents.select("doc_id", with_period(padded("text")).alias("description"))


@query
def prefix_text(spark, sf_dir):
    documents = d.table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id",
        prefixed(w.DOCUMENT_PREFIX, "text").alias("document"),
        prefixed(w.QUERY_PREFIX, "text").alias("query"),
    )


# -- ids, defaults, validation ----------------------------------------------


def uuid_text(ident: str, number: str) -> Column:
    """The accepted ways to write a UUID, and one that is not accepted."""
    form = F.col(number) % 6
    ident = F.col(ident)
    return (
        F.when(form == 0, ident)
        .when(form == 1, F.upper(ident))
        .when(form == 2, F.concat(F.lit("{"), ident, F.lit("}")))
        .when(form == 3, F.concat(F.lit("urn:uuid:"), ident))
        .when(form == 4, F.regexp_replace(ident, "-", ""))
        .otherwise(F.concat(F.lit("x"), ident))
    )


@query
def canonical_uuid_(spark, sf_dir):
    events = d.table(spark, sf_dir, "events").select(
        "event_id", d.make_id("event", "event_id").alias("id")
    )
    return events.select(
        "event_id", canonical_uuid(uuid_text("id", "event_id")).alias("canonical")
    )


def nested_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project commands as JSON text, under either of the record's two names."""
    record = F.struct(
        "id",
        "title",
        "description",
        "provider_id",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        "skill_ids",
        "major_id",
        "specialty_id",
    )
    new_name = F.col("place") % 2 == 0
    command = F.struct(
        F.when(new_name, record).alias("project_template"),
        F.when(~new_name, record).alias("template"),
        "major_name",
        "specialty_name",
        "skill_names",
    )
    commands = d.project_commands(spark, sf_dir).select("place", F.to_json(command).alias("json"))
    return commands.select("place", F.from_json("json", PROJECTS.command_schema).alias("command"))


@query
def field_alias_defaults(spark, sf_dir):
    flat = typed(unpack(nested_projects(spark, sf_dir), PROJECTS, "command"), PROJECTS)
    return flat.select(
        "id",
        "title",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.size("skill_ids").cast("int").alias("n_skill_ids"),
        F.size("skill_names").cast("int").alias("n_skill_names"),
        "major_name",
        "specialty_id",
        "specialty_name",
    )


@query
def validate_quarantine(spark, sf_dir):
    """Student commands with malformed ids and missing names: each with its reasons."""
    commands = d.student_commands(spark, sf_dir).withColumns(
        {
            "full_name": F.when(F.col("place") % 4 != 0, F.col("full_name")),
            "id": uuid_text("id", "place"),
            "major_id": F.when(F.col("place") % 9 == 0, F.lit("none")).otherwise(F.col("major_id")),
        }
    )
    return commands.select(
        "place", listed(command_problems(STUDENTS, F.col)).alias("reasons")
    )


@query
def validate_limits(spark, sf_dir):
    """Requests with limits from 0 to 109: those outside 1..100 have a reason."""
    requests = d.advisor_requests(spark, sf_dir).join(
        d.projects(spark, sf_dir).select(F.col("id").alias("request_id"), "place"), "request_id"
    )
    checked = requests.withColumn("limit", (F.col("place") % 110).cast("int"))
    return checked.select(
        "request_id", listed(request_problems(ADVISOR_REQUESTS, F.col)).alias("reasons")
    )


ITEMS_PER_PAYLOAD = 50


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk payloads of 50 students, as JSON text."""
    record = F.struct("id", "full_name", "major_id", "specialty_ids", "skill_ids", "about_me")
    item = F.struct(record.alias("student"), "major_name", "specialty_names", "skill_names")
    place = F.col("place")
    grouped = (
        d.student_commands(spark, sf_dir)
        .groupBy(F.floor(place / ITEMS_PER_PAYLOAD).cast("long").alias("payload"))
        .agg(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))).alias("placed"))
    )
    items = F.transform("placed", lambda p: p["item"])
    schema = T.StructType().add("items", T.ArrayType(STUDENTS.command_schema))
    text = grouped.select("payload", F.to_json(F.struct(items.alias("items"))).alias("json"))
    return text.select("payload", F.from_json("json", schema)["items"].alias("items"))


@query
def explode_bulk_items(spark, sf_dir):
    commands, _ = explode_items(payloads(spark, sf_dir), STUDENTS, keep=("payload",))
    return commands.select(
        "payload",
        F.col("pos").cast("int").alias("pos"),
        "id",
        "full_name",
        "major_name",
        listed("skill_names").alias("skills"),
        (F.size("skill_ids") + F.size("specialty_ids")).cast("int").alias("n_ids"),
    )


@query
def stream_bulk_items(spark, sf_dir):
    """The same payloads written as JSON lines and read item by item."""
    path = f"{scratch_root(spark)}/payloads"
    payloads(spark, sf_dir).select(F.col("payload").alias("seq"), "items").write.json(path)
    commands, _ = explode_streamed(spark, STUDENTS, path)
    return commands.select(
        F.col("seq").alias("payload"),
        "pos",
        "id",
        "full_name",
        "major_name",
        listed("skill_names").alias("skills"),
        (F.size("skill_ids") + F.size("specialty_ids")).cast("int").alias("n_ids"),
    )


@query
def json_commands(spark, sf_dir):
    """Single commands written as JSON lines, read back, validated and typed."""
    commands = d.student_commands(spark, sf_dir).withColumn("major_name", major_or_null())
    typed_commands, _ = accept(as_json(spark, commands, STUDENTS), STUDENTS)
    return typed_commands.select(
        "id",
        "full_name",
        "major_id",
        "major_name",
        listed("skill_names").alias("skills"),
        listed("skill_ids").alias("skill_ids"),
        listed("specialty_names").alias("specialties"),
    )


def major_or_null() -> Column:
    return F.when(F.col("major_id").isNotNull(), F.col("major_name"))


def as_json(spark: SparkSession, commands: DataFrame, spec: EntitySpec) -> DataFrame:
    """Flat commands written as JSON lines in the nested form and read back, unpacked."""
    folder = f"{scratch_root(spark)}/json"
    record = F.struct(*[
        F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(name) if name in spec.timestamps else F.col(name)
        for name, _ in spec.record
    ])
    beside = [name for name, _ in spec.labels] + [c for c in ("seq", "op") if c in commands.columns]
    commands.select(record.alias(spec.payload[-1]), *beside).write.json(folder, compression="gzip")
    return in_scope(folder, read_commands(spark, spec, folder))


@query
def json_other_commands(spark, sf_dir):
    """The same for the three other entities."""
    parts = []
    for spec, commands, name, labels in (
        (PROFESSORS, d.professor_commands(spark, sf_dir), "full_name", listed("interest_areas")),
        (SKILLS, d.skills(spark, sf_dir), "name", F.lit("")),
        (PROJECTS, d.project_commands(spark, sf_dir), "title", listed("skill_names")),
    ):
        valid, _ = accept(as_json(spark, commands, spec), spec)
        parts.append(
            valid.select(F.lit(spec.table).alias("entity"), "id", F.col(name).alias("name"), labels.alias("labels"))
        )
    return parts[0].union(parts[1]).union(parts[2])


@query
def validate_ops(spark, sf_dir):
    """Known, unknown, empty and missing kinds of change: each accepted or not."""
    form = F.col("seq") % 6
    op = (
        F.when(form == 0, "upsert").when(form == 1, "d").when(form == 2, "")
        .when(form == 3, F.col("op")).when(form == 5, "D")
    )
    commands = d.change_commands(spark, sf_dir).withColumn("op", op)
    valid, rejected = accept(commands, STUDENTS)
    # A missing kind is an upsert once it is accepted.
    given = F.when(form != 4, F.col("op"))
    return valid.select("seq", given.alias("op"), F.lit(True).alias("accepted")).union(
        rejected.select("seq", "op", F.lit(False))
    )


@query
def chunk_plan_(spark, sf_dir):
    return chunk_plan(d.students(spark, sf_dir).select("place"), "place")


# -- vectors ------------------------------------------------------------------


@query
def l2_normalize_(spark, sf_dir):
    vectors = d.table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: (x * F.lit(3.0)).cast("float"))
    unit = vectors.select("vec_id", l2_normalize(scaled).alias("unit"))
    return unit.select("vec_id", d.digest("unit").alias("vector"))


@query
def hash_embed(spark, sf_dir):
    documents = d.table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed(documents, "text", hashing_embedder(), spread_by="doc_id").select(
        "doc_id", d.digest("vector").alias("vector")
    )


@query
def hash_embed_query(spark, sf_dir):
    turns = d.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return embed(turns, "text", hashing_embedder(), kind="query", spread_by="conv_id").select(
        "conv_id", "turn", d.digest("vector").alias("vector")
    )


@query
def hash_embed_once(spark, sf_dir):
    """All turns with each distinct text of the table embedded once."""
    turns = d.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return embed_once(turns, "text", hashing_embedder(), kind="query").select(
        "conv_id", "turn", d.digest("vector").alias("vector")
    )


def call_shape() -> Embedder:
    """A stand-in for a model whose vectors tell the call: its texts and their padded size."""

    def load():
        import numpy as np

        def predict(texts):
            width = max(len(text) for text in texts)
            return np.array([[len(texts), len(texts) * width, 1.0]] * len(texts))

        return predict

    return Embedder(load, 3)


@query
def embed_batches(spark, sf_dir):
    """Whether each document's model call keeps its bounds of rows and of padded characters."""
    documents = d.table(spark, sf_dir, "documents").select("doc_id", "text")
    told = embed(documents, "text", call_shape(), spread_by="doc_id")
    ratio = [F.round(F.col("vector")[n] / F.col("vector")[2]) for n in (0, 1)]
    own = F.length("text") + len(w.DOCUMENT_PREFIX)
    return told.select(
        "doc_id",
        ratio[0].between(1, BATCH_ROWS).alias("rows_kept"),
        # Only a text longer than the bound may exceed it, and then it is alone.
        ((ratio[1] <= BATCH_CHARS * (1 + 1e-6)) | ((ratio[0] == 1) & (own > BATCH_CHARS))).alias("chars_kept"),
    )


# -- stored tables --------------------------------------------------------------


@query
def table_scan(spark, sf_dir):
    """A stored table scanned with a filter and three of its columns."""
    table = stored(spark, PROFESSORS, d.professor_commands(spark, sf_dir))
    return table.read().where("is_accepting_projects").select("id", "full_name", "rank")


def current_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.students(spark, sf_dir).select(
        "id", F.lit(-1).cast("long").alias("seq"), F.lit("U").alias("op"), F.col("full_name").alias("payload")
    )


@query
def merge_upsert(spark, sf_dir):
    """The whole change feed merged into the students."""
    merged = keyed.merge(current_students(spark, sf_dir), d.changes(spark, sf_dir))
    return merged.select("id", "seq", "payload")


@query
def delete_by_id(spark, sf_dir):
    """Students without those the feed ever deletes; ids repeat and many are unknown."""
    ids = d.changes(spark, sf_dir).where("op = 'D'").select("id")
    return keyed.delete(d.students(spark, sf_dir).select("id", "full_name"), ids)


@query
def replace_snapshot(spark, sf_dir):
    """Skills replaced by the brands: nothing of the old rows is left."""
    table = stored(spark, SKILLS, d.skills(spark, sf_dir))
    brands = d.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    bulk_sync(table, brands.select(d.make_id("brand", "name").alias("id"), "name"), hashing_embedder())
    return table.read().select("id", "name")


@query
def names_by_ids_(spark, sf_dir):
    """Names of all skills students have; every id many times, and as many unknown ones."""
    students = d.student_commands(spark, sf_dir)
    ids = students.select(F.explode("skill_ids").alias("id")).union(students.select("id"))
    return names_by_ids(d.skills(spark, sf_dir), ids)


@query
def lookup_by_id(spark, sf_dir):
    """Students of the feed's distinct users; some users are no students."""
    ids = d.changes(spark, sf_dir).select("id").distinct()
    return lookup(d.students(spark, sf_dir), ids, ["full_name", "major_id"])


@query
def enrich_labels(spark, sf_dir):
    """Skill ids of students back to names, one id known to no table in front."""
    records = d.student_commands(spark, sf_dir).select(
        "id", F.array_insert("skill_ids", 1, F.col("id")).alias("skill_ids")
    )
    named = enrich(records, "skill_ids", d.skills(spark, sf_dir), "names")
    return named.select("id", listed("names").alias("names"))


@query
def enrich_majors(spark, sf_dir):
    """Names of students' majors; a tenth of the students has none."""
    records = d.students(spark, sf_dir).select("id", "major_id")
    return name_of(records, "major_id", d.majors(spark, sf_dir), "major")


@query
def enrich_interests(spark, sf_dir):
    """Areas of professors' interests by their ids."""
    records = d.professor_commands(spark, sf_dir).select("id", "research_interest_ids")
    areas = d.table(spark, sf_dir, "part").select(F.col("p_name").alias("area")).distinct()
    dimension = areas.select(d.make_id("interest", "area").alias("id"), "area")
    named = enrich(records, "research_interest_ids", dimension, "areas", name="area")
    return named.select("id", listed("areas").alias("areas"))


# -- nearest neighbours -----------------------------------------------------------


def vector_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("request_id"),
        F.col("embedding").alias("vector"),
        F.lit(10).alias("limit"),
        "label",
    )


def vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def search(spark, sf_dir, requests: DataFrame, **options) -> DataFrame:
    candidates = options.pop("candidates", None) or vector_candidates(spark, sf_dir)
    return nearest(requests, candidates, dimension=EMBEDDING_DIMENSION, **options)


@query
def knn_all(spark, sf_dir):
    return search(spark, sf_dir, vector_requests(spark, sf_dir))


@query
def knn_arrow(spark, sf_dir):
    """The plan for few requests: partial top-k where the candidates are."""
    return search(spark, sf_dir, vector_requests(spark, sf_dir), plan="requests")


@query
def knn_grid(spark, sf_dir):
    """The plan for two large sides, with small blocks."""
    return search(spark, sf_dir, vector_requests(spark, sf_dir), plan="grid", block_rows=200)


@query
def knn_one_request(spark, sf_dir):
    """One request with a limit of 100: the first vector."""
    candidates = vector_candidates(spark, sf_dir)
    vector = candidates.orderBy("id").select("vector").first()["vector"]
    return nearest_one(candidates, list(vector), 100)


def restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests within their own label; those of label 0 are not restricted."""
    requests = vector_requests(spark, sf_dir)
    return requests.withColumn("only", F.when(F.col("label") != 0, F.col("label")))


@query
def knn_major_restricted(spark, sf_dir):
    return search(spark, sf_dir, restricted(spark, sf_dir), restrict=("only", "label"))


@query
def knn_restricted_grid(spark, sf_dir):
    return search(
        spark, sf_dir, restricted(spark, sf_dir), restrict=("only", "label"), plan="grid", block_rows=50
    )


@query
def knn_per_request_limit(spark, sf_dir):
    """Limits from 1 to 100, by label."""
    limit = (F.col("label") * 11 + 1).cast("int")
    requests = vector_requests(spark, sf_dir).withColumn("limit", limit)
    return search(spark, sf_dir, requests, plan="requests")


def professor_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorize(d.professor_commands(spark, sf_dir), PROFESSORS, hashing_embedder())


@query
def knn_bool_filter(spark, sf_dir):
    """For every professor the nearest who accept projects."""
    vectors = professor_vectors(spark, sf_dir)
    requests = vectors.select(F.col("id").alias("request_id"), "vector", F.lit(5).alias("limit"))
    return nearest(requests, vectors.where("is_accepting_projects"))


@query
def knn_conjunction(spark, sf_dir):
    """The same under a predicate given as text."""
    vectors = professor_vectors(spark, sf_dir)
    requests = vectors.select(F.col("id").alias("request_id"), "vector", F.lit(5).alias("limit"))
    return nearest(
        requests, vectors, where="is_accepting_projects = true AND rank = 'Full Professor'"
    )


@query
def squared_distance(spark, sf_dir):
    """Distance of every vector to the next one, in millionths."""
    vectors = d.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")
    )
    distance = squared_l2("embedding", "other")
    return vectors.join(following, "vec_id").select(
        "vec_id", F.floor(distance * 1e6 + 0.5).cast("long").alias("millionths")
    )


# -- pipelines ------------------------------------------------------------------


def stored(spark: SparkSession, spec: EntitySpec, commands: DataFrame) -> VersionedTable:
    """A new table with the vectors of all commands."""
    table = VersionedTable(spark, scratch_root(spark), spec)
    bulk_sync(table, commands, hashing_embedder())
    return table


@query
def recommend_projects_(spark, sf_dir):
    projects = stored(spark, PROJECTS, d.project_commands(spark, sf_dir))
    requests, _ = accept_requests(d.student_requests(spark, sf_dir), PROJECT_REQUESTS)
    return recommend_projects(requests, projects.read(), hashing_embedder(), projects.row_bound())


@query
def recommendation_lists(spark, sf_dir):
    """Skills for all students as one ordered list each."""
    skills = stored(spark, SKILLS, d.skills(spark, sf_dir))
    requests, _ = accept_requests(d.student_requests(spark, sf_dir), SKILL_REQUESTS)
    ranked = recommend_skills(requests, skills.read(), hashing_embedder(), skills.row_bound())
    return id_lists(ranked, requests).select("request_id", listed("ids").alias("ids"))


@query
def suggest_professors_(spark, sf_dir):
    professors = stored(spark, PROFESSORS, d.professor_commands(spark, sf_dir))
    requests, _ = accept_requests(d.advisor_requests(spark, sf_dir), ADVISOR_REQUESTS)
    return suggest_professors(
        requests, professors.read(), hashing_embedder(), professors.row_bound()
    )


@query
def recommend_skills_(spark, sf_dir):
    skills = stored(spark, SKILLS, d.skills(spark, sf_dir))
    requests, _ = accept_requests(d.student_requests(spark, sf_dir), SKILL_REQUESTS)
    return recommend_skills(requests, skills.read(), hashing_embedder(), skills.row_bound())


@query
def sync_students(spark, sf_dir):
    """All students in bulk, then the whole change feed on top."""
    table = stored(spark, STUDENTS, d.student_commands(spark, sf_dir))
    sync(table, d.change_commands(spark, sf_dir), hashing_embedder())
    return table.read().select("id", "full_name", "about_me", d.digest("vector").alias("vector"))


@query
def bulk_sync_projects(spark, sf_dir):
    table = stored(spark, PROJECTS, d.project_commands(spark, sf_dir))
    return table.read().select(
        "id",
        "title",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        listed("skill_ids").alias("skill_ids"),
        d.digest("vector").alias("vector"),
    )


@query
def bulk_sync_professors(spark, sf_dir):
    table = stored(spark, PROFESSORS, d.professor_commands(spark, sf_dir))
    return table.read().select(
        "id",
        "is_accepting_projects",
        listed("research_interest_ids").alias("interest_ids"),
        d.digest("vector").alias("vector"),
    )


@query
def bulk_sync_skills(spark, sf_dir):
    table = stored(spark, SKILLS, d.skills(spark, sf_dir))
    return table.read().select("id", "name", d.digest("vector").alias("vector"))


@query
def sync_projects(spark, sf_dir):
    """All projects in bulk, then all again with their titles in upper case."""
    commands = derived_once(d.project_commands(spark, sf_dir))
    table = stored(spark, PROJECTS, commands)
    sync(table, commands.withColumn("title", F.upper("title")), hashing_embedder())
    return table.read().select("id", "title", d.digest("vector").alias("vector"))


@query
def delete_students(spark, sf_dir):
    """Stored students less those the feed ever deletes."""
    table = stored(spark, STUDENTS, d.student_commands(spark, sf_dir))
    table.delete(d.changes(spark, sf_dir).where("op = 'D'").select("id").distinct())
    return table.read().select("id", "full_name")


@query
def delete_commands_(spark, sf_dir):
    """Students deleted by ids in every accepted form; bad, null and unknown ids change nothing."""
    table = stored(spark, STUDENTS, d.student_commands(spark, sf_dir))
    students = d.students(spark, sf_dir).where("place % 7 <> 3")
    ids = students.select(uuid_text("id", "place").alias("id"))
    rough = ids.union(spark.createDataFrame([(None,), ("none\n",), (f"{'0' * 32}\n",)], "id string"))
    delete_commands(table, rough)
    return table.read().select("id", "full_name")


@query
def compact_projects(spark, sf_dir):
    """Projects in bulk, some changed and some deleted, then compacted: a new base, the same rows."""
    commands = d.project_commands(spark, sf_dir)
    table = stored(spark, PROJECTS, commands)
    sync(table, commands.where("place % 3 = 0").withColumn("title", F.upper("title")), hashing_embedder())
    table.delete(commands.where("place % 5 = 0").select("id"))
    table.compact()
    if table.state()["changes"]:
        raise StoreError("changes are left after compaction")
    return table.read().select("id", "title")


def failing_embedder() -> Embedder:
    def load():
        def predict(texts):
            raise MemoryError("out of memory")

        return predict

    return Embedder(load)


@query
def failed_bulk_sync(spark, sf_dir):
    """A replacement whose model fails: the error names the stage, the live rows stay."""
    table = stored(spark, SKILLS, d.skills(spark, sf_dir))
    error = ""
    try:
        bulk_sync(table, d.skills(spark, sf_dir).withColumn("name", F.upper("name")), failing_embedder())
    except EmbeddingError as failed:
        error = str(failed)
    return table.read().select("id", "name", F.lit(error).alias("error"))


@query
def sync_unsequenced(spark, sf_dir):
    """Students in bulk, two JSON syncs of the same ids without a sequence, then new ids."""
    with scope():
        commands = derived_once(d.student_commands(spark, sf_dir))
        table = stored(spark, STUDENTS, commands)

        def named(rows: DataFrame, word: str) -> DataFrame:
            return rows.withColumn("full_name", F.concat(F.lit(f"{word} "), F.col("place").cast("string")))

        new = commands.limit(0).unionByName(
            d.projects(spark, sf_dir).select("id", "place"), allowMissingColumns=True
        )
        for rows in (named(commands, "first"), named(commands.where("place % 2 = 0"), "second"), named(new, "new")):
            with scope():
                valid, _ = accept(as_json(spark, rows, STUDENTS), STUDENTS)
                sync(table, valid, hashing_embedder())
    return table.read().select("id", "full_name")


@query
def late_after_replace(spark, sf_dir):
    """Changes from before a replacement are rejected and shown; those after it are stored."""
    table = VersionedTable(spark, scratch_root(spark), STUDENTS)
    with scope():
        commands = derived_once(d.student_commands(spark, sf_dir))
        numbered = commands.withColumn("seq", F.col("place") + 1000)
        sync(table, numbered, hashing_embedder())
        bulk_sync(table, commands, hashing_embedder())
        high = table.state()["high_seq"]
        late = commands.withColumns({"full_name": F.lit("late"), "seq": F.lit(high).cast("long") - F.col("place") % 2})
        newer = commands.where("place % 3 = 0").withColumns(
            {"full_name": F.lit("newer"), "seq": F.lit(high).cast("long") + 1}
        )
        sync(table, late, hashing_embedder())
        sync(table, newer, hashing_embedder())
    kept = table.read().select("id", "full_name", F.lit("stored").alias("fate"))
    return kept.union(table.rejected().select("id", "full_name", "reason"))


@query
def reject_vectors(spark, sf_dir):
    """Vectors that are missing, short, long or not finite are set aside; the rest can be searched."""
    table = VersionedTable(spark, scratch_root(spark), SKILLS, dimension=EMBEDDING_DIMENSION)
    case, vector = F.col("vec_id") % 7, F.col("embedding")
    broken = (
        F.when(case == 1, F.lit(None).cast(VECTOR))
        .when(case == 2, F.slice(vector, 1, EMBEDDING_DIMENSION - 1))
        .when(case == 3, F.concat(vector, vector))
        .when(case == 4, F.transform(vector, lambda x, i: F.when(i == 5, float("nan")).otherwise(x).cast("float")))
        .otherwise(vector)
    )
    rows = d.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.lit("x").alias("name"), broken.alias("vector")
    )
    table.replace(rows)
    requests = table.read().select(F.col("id").alias("request_id"), "vector", F.lit(1).alias("limit"))
    found = nearest(requests, table.read(), dimension=EMBEDDING_DIMENSION)
    kept = found.select(F.col("request_id").cast("long").alias("vec_id"), F.lit("stored").alias("fate"))
    return kept.union(table.rejected().select(F.col("id").cast("long"), "reason"))


@query
def enrich_repeated_keys(spark, sf_dir):
    """Labels of records whose key is not unique: each record gets its own."""
    records = d.student_commands(spark, sf_dir).select(F.col("major_id").alias("key"), "skill_ids")
    named = enrich(records, "skill_ids", d.skills(spark, sf_dir), "names", key="key")
    return named.select("key", listed("names").alias("names"))


@query
def json_requests(spark, sf_dir):
    """Requests written as JSON lines, read back, validated and rendered."""
    folder = f"{scratch_root(spark)}/requests"
    d.advisor_requests(spark, sf_dir).write.json(folder)
    requests, _ = accept_requests(read_requests(spark, ADVISOR_REQUESTS, folder), ADVISOR_REQUESTS)
    return requests.select("request_id", "limit", advisor_query().alias("query"))


@query
def change_feed_fold(spark, sf_dir):
    """Live rows of the feed alone."""
    folded = keyed.live(keyed.newest(d.changes(spark, sf_dir)))
    return folded.select("id", "seq", "payload")


@query
def stream_change_feed(spark, sf_dir):
    """The feed as JSON files through the stream, several files per batch and many batches."""
    root = scratch_root(spark)
    record = F.struct("full_name", "about_me")
    d.change_commands(spark, sf_dir).repartition(8, "seq").select(
        "seq", "op", "id", record.alias("student")
    ).write.json(f"{root}/landing")
    table = VersionedTable(spark, root, STUDENTS)
    feed = read_feed(spark, STUDENTS, f"{root}/landing", maxFilesPerTrigger="3")
    name = f"feed_{root.rsplit('-', 1)[-1].replace('/', '_')}"
    running = stream_sync(
        feed, table, hashing_embedder(), f"{root}/progress", name=name, available_now=True
    )
    running.awaitTermination()
    return table.read().select("id", F.col("about_me").alias("payload"))


@query
def run_metrics_(spark, sf_dir):
    """Rows and chunks of bulk runs of each entity, from the table the runs wrote."""
    path = f"{scratch_root(spark)}/runs"
    for spec, commands in (
        (SKILLS, d.skills(spark, sf_dir)),
        (STUDENTS, d.student_commands(spark, sf_dir)),
        (PROFESSORS, d.professor_commands(spark, sf_dir)),
        (PROJECTS, d.project_commands(spark, sf_dir)),
    ):
        table = VersionedTable(spark, scratch_root(spark), spec)
        bulk_sync(table, commands, hashing_embedder(), metrics=("run", path))
    stage = F.regexp_replace("stage", "^bulk_sync ", "")
    return spark.read.parquet(path).select(
        stage.alias("stage"), "n_rows", "n_rejected", F.col("n_chunks").cast("int").alias("n_chunks")
    )


def queries() -> dict[str, Query]:
    """Queries by name; a trailing underscore only keeps a name free for its operator."""
    return {name.rstrip("_"): function for name, function in QUERIES.items()}
