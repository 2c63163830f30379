"""SQL that checks the registered queries, written for DuckDB on the driver's tables.

It is written on its own, from the description of each operator: sparse vectors joined
on their places instead of matrices, string concatenation instead of expressions.
"""

from __future__ import annotations


def make_id(kind: str, value: str) -> str:
    digest = f"md5('{kind}:' || cast({value} as varchar))"
    parts = ", ".join(
        f"substr({digest}, {start}, {length})"
        for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    )
    return f"case when {value} is not null then concat_ws('-', {parts}) end"


# -- entity tables --------------------------------------------------------------

SKILLS = f"""
select {make_id('skill', 'p_name')} as id, p_name as name
from (select distinct p_name from part)"""

STUDENTS = f"""
select {make_id('student', 'c_custkey')} as id, c_name as full_name, c_custkey as place,
  case when c_custkey % 10 <> 0 then {make_id('major', 'n_name')} end as major_id,
  case when c_custkey % 10 <> 0 then n_name end as major_name,
  case when c_custkey % 7 <> 0 then [c_mktsegment] end as specialty_names,
  sk.skill_names, d.text as about_me
from customer join nation on n_nationkey = c_nationkey
left join (select o_custkey, list_sort(array_agg(distinct p_name)) as skill_names
  from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey
  group by o_custkey) sk on sk.o_custkey = c_custkey
left join documents d on d.doc_id = c_custkey"""

PROFESSORS = f"""
select {make_id('professor', 's_suppkey')} as id, s_name as full_name, n_name as department,
  case when s_acctbal >= 6000 then 'Full Professor' when s_acctbal >= 2000 then 'Associate Professor'
       else 'Assistant Professor' end as rank,
  s_acctbal > 0 as is_accepting_projects, ia.interest_areas, d.text as about_me
from supplier join nation on n_nationkey = s_nationkey
left join (select l_suppkey, list_sort(array_agg(distinct p_name)) as interest_areas
  from lineitem join part on p_partkey = l_partkey group by l_suppkey) ia
  on ia.l_suppkey = s_suppkey
left join documents d on d.doc_id = s_suppkey + 500"""

PROJECTS = f"""
select {make_id('project', 'd.doc_id')} as id, d.doc_id as place,
  concat_ws(' ', d.source, d.lang, cast(d.doc_id as varchar)) as title, d.text as description,
  {make_id('provider', 'd.source')} as provider_id, o_orderdate as created_at, sk.skill_names,
  case when d.doc_id % 5 <> 0 then {make_id('major', 'n_name')} end as major_id,
  case when d.doc_id % 5 <> 0 then n_name end as major_name,
  case when d.doc_id % 3 <> 0 then c_mktsegment end as specialty_name
from documents d join orders on o_orderkey = d.doc_id join customer on c_custkey = o_custkey
join nation on n_nationkey = c_nationkey
left join (select l_orderkey, list_sort(array_agg(distinct p_name)) as skill_names
  from lineitem join part on p_partkey = l_partkey group by l_orderkey) sk on sk.l_orderkey = d.doc_id"""

CHANGES = f"""
select event_id as seq, {make_id('student', 'user_id')} as id,
  case when event_type = 'error' then 'D' else 'U' end as op, event_type as payload
from events"""

TABLES = f"""skills as ({SKILLS}),
students as ({STUDENTS}),
professors as ({PROFESSORS}),
projects as ({PROJECTS}),
changes as ({CHANGES})"""


def over(select: str, *more: str) -> str:
    """A query over the entity tables and further named ones."""
    return "with " + ",\n".join([TABLES, *more]) + "\n" + select


# -- texts ------------------------------------------------------------------------

SPACES = "||".join(
    f"chr({code})"
    for code in (
        9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203),
        8232, 8233, 8239, 8287, 12288,
    )
)
PADDING = "chr(9)||' '||chr(160)||chr(12288)||chr(28)||chr(8232)||' '"


def strip(text: str) -> str:
    return f"trim({text}, {SPACES})"


def join_or(items: str, fallback: str) -> str:
    return (
        f"case when {items} is null or len({items}) = 0 then '{fallback}' "
        f"else array_to_string({items}, ', ') end"
    )


def text_or(text: str, fallback: str) -> str:
    return f"case when {text} is null or {text} = '' then '{fallback}' else {strip(text)} end"


def with_period(text: str) -> str:
    stripped = strip(text)
    return f"case when {stripped} like '%.' then {stripped} else {stripped} || '.' end"


def optional(value: str, text: str) -> str:
    return f"case when {value} is null or {value} = '' then '' else {text} end"


SKILL_DOCUMENT = "'Technical and professional competency skill: ' || name"

STUDENT_DOCUMENT = (
    "'Student Profile: ' || full_name"
    " || '. Primary Academic Major Path: ' || coalesce(major_name, 'Undeclared')"
    " || '. Sub-Track Concentrations: ' || "
    + join_or("specialty_names", "No specialized sub-tracks designated")
    + " || '. Technical Competency Skill Matrix: ' || "
    + join_or("skill_names", "No technical skills indexed yet")
    + " || '. Personal Background and Career Aspirations: ' || "
    + text_or("about_me", "No professional biography or summary provided.")
)

PROFESSOR_DOCUMENT = (
    "'Academic Faculty Professor Profile: ' || full_name"
    " || '. Department Division: ' || department"
    " || '. Institutional Rank: ' || rank"
    " || '. Active Research Interest Domains: [' || "
    + join_or("interest_areas", "General academic supervision and instruction")
    + " || ']. Biography, Research Focus, and Lab Direction: ' || "
    + text_or("about_me", "No professional biography or lab summary provided.")
)

PROJECT_DOCUMENT = (
    "'Academic Project Assignment Blueprint. Project Title: ' || title"
    " || '. Core Description, Scope, and Deliverable Objectives: ' || "
    + with_period("description")
    + " || ' Academic Requirements: ' || case when major_name is null or major_name = ''"
    " then 'Open to all general majors.'"
    " else 'Targeted primarily toward ' || major_name || ' academic paths.' end || "
    + optional(
        "specialty_name", "' Aligned with the ' || specialty_name || ' specialization track.'"
    )
    + " || ' Required Student Technical Competencies: [' || "
    + join_or("skill_names", "General cross-functional capabilities")
    + " || '].'"
)

PROJECT_QUERY = (
    "'Find academic project assignment blueprints and research opportunities that strongly align "
    "with a student majoring in ' || coalesce(major_name, 'Undeclared')"
    " || ', pursuing concentrations in [' || "
    + join_or("specialty_names", "general curriculum studies")
    + " || '], who possesses technical expertise in [' || "
    + join_or("skill_names", "foundational academic concepts")
    + " || '], and is deeply interested in: ' || "
    + text_or("about_me", "practical applied learning experiences")
)

SKILL_QUERY = (
    "'Identify complementary industry skills, technical frameworks, or professional competencies "
    "that are highly relevant or a natural progression for a '"
    " || coalesce(major_name, 'Undeclared') || ' student'"
    " || case when specialty_names is null then ''"
    " else ' specializing in ' || array_to_string(specialty_names, ', ') end"
    " || ' who currently knows [' || "
    + join_or("skill_names", "beginner academic tracks")
    + " || '].' || "
    + optional("about_me", f"' Career focus: ' || {strip('about_me')}")
)

ADVISOR_QUERY = (
    "'Identify an academic faculty professor and research advisor' || "
    + optional("major_name", "' in the ' || major_name || ' department'")
    + " || "
    + optional("specialty_name", "' focusing on ' || specialty_name")
    + " || ' whose expert research interests, industry backgrounds, and current lab direction "
    "directly align with supervising a student project titled ''' || title"
    " || '''. The project entails: ' || "
    + with_period("description")
    + " || ' The supervisor should have background relevant to these student competencies: [' || "
    + join_or("skill_names", "academic research methods")
    + " || '].'"
)

DOCUMENT, QUERY = "search_document: ", "search_query: "

# -- vectors ----------------------------------------------------------------------


def embedded(name: str, source: str, prefix: str, key: str = "id") -> str:
    """Named tables ending in ``name(key, b, x)``: the non-zero places of hashed vectors.

    ``source`` selects ``key`` and ``text``.
    """
    words = r"string_split_regex(lower('%s' || text), '[^\p{L}\p{N}\p{M}]+')" % prefix
    return f"""{name}_words as (
  select {key}, unnest({words}) as w from ({source})),
{name}_counts as (
  select {key}, ('0x' || substr(md5(w), 1, 8))::bigint % 768 as b,
    cast(sum(case when substr(md5(w), 9, 1) < '8' then 1 else -1 end) as double) as c
  from {name}_words where w <> '' group by all),
{name} as (
  select {key}, b, cast(c / sqrt(sum(c * c) over (partition by {key})) as float) as x
  from {name}_counts where c <> 0)"""


SHOWN = "string_agg(b || ':' || cast(floor(x::double * 1e6 + 0.5) as bigint), ',' order by b)"


def nearest(requests: str, candidates: str, pairs: str) -> str:
    """Named tables ending in ``ranked(request_id, rank, id, "limit")`` over hashed vectors.

    ``pairs`` selects the ``request_id``, ``id`` and ``"limit"`` that may meet.
    """
    return f"""norms_q as (select id, sum(x::double * x::double) as n from {requests} group by id),
norms_c as (select id, sum(x::double * x::double) as n from {candidates} group by id),
dots as (
  select q.id as request_id, c.id as id, sum(q.x::double * c.x::double) as dot
  from {requests} q join {candidates} c on q.b = c.b group by all),
ranked as (
  select p.request_id, p.id, "limit", cast(row_number() over (partition by p.request_id order by
    floor((nq.n + nc.n - 2 * coalesce(dot, 0)) * 1e9 + 0.5), p.id) as integer) as rank
  from ({pairs}) p
  join norms_q nq on nq.id = p.request_id join norms_c nc on nc.id = p.id
  left join dots d on d.request_id = p.request_id and d.id = p.id)"""


TAKE = 'select request_id, rank, id from ranked where rank <= "limit"'


def dense_nearest(pairs: str, limit: str = "10") -> str:
    """Nearest of the driver's own vectors; ``pairs`` is a join condition of q and c."""
    distance = (
        "list_inner_product(q.v, q.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(q.v, c.v)"
    )
    return f"""with e as (select vec_id, embedding::double[] as v, label from embeddings),
ranked as (
  select q.vec_id as request_id, c.vec_id as id, {limit} as "limit",
    cast(row_number() over (partition by q.vec_id
      order by floor(({distance}) * 1e9 + 0.5), c.vec_id) as integer) as rank
  from e q join e c on {pairs})
{TAKE}"""


UUID_TEXT = """case {n} % 6 when 0 then {id} when 1 then upper({id}) when 2 then '{{' || {id} || '}}'
  when 3 then 'urn:uuid:' || {id} when 4 then replace({id}, '-', '') else 'x' || {id} end"""

LATEST = "select * from (select *, row_number() over (partition by id order by seq desc) as r from changes) where r = 1"

STUDENT_TEXT = f"select id, {STUDENT_DOCUMENT} as text from students"
PROFESSOR_TEXT = f"select id, {PROFESSOR_DOCUMENT} as text from professors"
PROJECT_TEXT = f"select id, {PROJECT_DOCUMENT} as text from projects"
SKILL_TEXT = f"select id, {SKILL_DOCUMENT} as text from skills"

PROFESSOR_PAIRS = (
    'select q.id as request_id, c.id as id, 5 as "limit" '
    "from professors q cross join professors c where c.is_accepting_projects"
)

SKILL_ID = make_id("skill", "x")
INTEREST_ID = make_id("interest", "x")


def oracle_sql() -> dict[str, str]:
    synced = f"""final as (
  select id, full_name, about_me, {STUDENT_DOCUMENT} as text from students
    where id not in (select id from latest)
  union all
  select id, full_name, about_me, {STUDENT_DOCUMENT} as text from (
    select id, 'Student ' || substr(id, 1, 8) as full_name, payload as about_me,
      cast(null as varchar) as major_name, cast(null as varchar[]) as specialty_names,
      cast(null as varchar[]) as skill_names from latest where op = 'U'))"""
    fold = over("select id, seq, payload from latest where op = 'U'", f"latest as ({LATEST})")
    return {
        "doc_skill": over(f"select id, {SKILL_DOCUMENT} as document from skills"),
        "doc_student": over(f"select id, {STUDENT_DOCUMENT} as document from students"),
        "doc_professor": over(f"select id, {PROFESSOR_DOCUMENT} as document from professors"),
        "doc_project": over(f"select id, {PROJECT_DOCUMENT} as document from projects"),
        "query_project": over(f"select id as request_id, {PROJECT_QUERY} as query from students"),
        "query_skill": over(f"select id as request_id, {SKILL_QUERY} as query from students"),
        "query_advisor": over(f"select id as request_id, {ADVISOR_QUERY} as query from projects"),
        "strip_text": f"select doc_id, {strip(f'({PADDING} || text || {PADDING})')} as stripped from documents",
        "join_or_fallback": over(
            f"select id, {join_or('specialty_names', 'No specialized sub-tracks designated')} as specialties, "
            f"{join_or('skill_names', 'No technical skills indexed yet')} as skills from students"
        ),
        "text_or_fallback": f"""with given as (
  select doc_id, case doc_id % 40 when 0 then null when 1 then {PADDING}
    when 2 then '' else {PADDING} || text || {PADDING} end as t from documents)
select doc_id, {text_or('t', 'No professional biography or summary provided.')} as about from given""",
        "normalize_description": f"""with given as (
  select doc_id, {PADDING} || text || {PADDING} as t from documents)
select doc_id, {with_period('t')} as description from given""",
        "prefix_text": f"select doc_id, '{DOCUMENT}' || text as document, '{QUERY}' || text as query from documents",
        "canonical_uuid": f"""select event_id,
  case when event_id % 6 < 5 then {make_id('event', 'event_id')} end as canonical from events""",
        "field_alias_defaults": over(
            "select id, title, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, "
            "cast(coalesce(len(skill_names), 0) as integer) as n_skill_ids, cast(coalesce(len(skill_names), 0) as integer) as n_skill_names, "
            f"major_name, {make_id('specialty', 'specialty_name')} as specialty_id, specialty_name from projects"
        ),
        "validate_quarantine": over(
            """select place, concat_ws('|',
  case when place % 4 = 0 then 'full_name: missing' end,
  case when place % 6 = 5 then 'id: not a uuid' end,
  case when place % 9 = 0 then 'major_id: not a uuid' end) as reasons from students"""
        ),
        "validate_limits": over(
            """select id as request_id,
  case when place % 110 between 1 and 100 then '' else 'limit: out of range' end as reasons from projects"""
        ),
        "explode_bulk_items": over(
            """select place // 50 as payload,
  cast(row_number() over (partition by place // 50 order by place) - 1 as integer) as pos,
  id, full_name, coalesce(major_name, 'Undeclared') as major_name,
  coalesce(array_to_string(skill_names, '|'), '') as skills,
  cast(coalesce(len(skill_names), 0) + coalesce(len(specialty_names), 0) as integer) as n_ids from students"""
        ),
        "stream_bulk_items": over(
            """select place // 50 as payload,
  cast(row_number() over (partition by place // 50 order by place) - 1 as integer) as pos,
  id, full_name, coalesce(major_name, 'Undeclared') as major_name,
  coalesce(array_to_string(skill_names, '|'), '') as skills,
  cast(coalesce(len(skill_names), 0) + coalesce(len(specialty_names), 0) as integer) as n_ids from students"""
        ),
        "json_commands": over(
            f"""select id, full_name, major_id, coalesce(major_name, 'Undeclared') as major_name,
  coalesce(array_to_string(skill_names, '|'), '') as skills,
  coalesce(array_to_string(list_transform(skill_names, lambda x: {SKILL_ID}), '|'), '') as skill_ids,
  coalesce(array_to_string(specialty_names, '|'), '') as specialties from students"""
        ),
        "json_other_commands": over(
            """select 'professors' as entity, id, full_name as name,
  coalesce(array_to_string(interest_areas, '|'), '') as labels from professors
union all select 'skills', id, name, '' from skills
union all select 'project_templates', id, title, coalesce(array_to_string(skill_names, '|'), '') from projects"""
        ),
        "validate_ops": over(
            """select seq, case seq % 6 when 0 then 'upsert' when 1 then 'd' when 2 then '' when 3 then op
    when 4 then null else 'D' end as op,
  seq % 6 in (3, 4, 5) as accepted from changes"""
        ),
        "delete_commands": over(
            "select id, full_name from students where place % 6 = 5 or place % 7 = 3"
        ),
        "sync_unsequenced": over(
            """select id, case when place % 2 = 0 then 'second ' || place else 'first ' || place end as full_name
from students union all
select id, 'new ' || place from (select id, place from projects)"""
        ),
        "late_after_replace": over(
            """select id, full_name, 'stored' as fate from students where id not in (select id from newer)
union all select id, 'newer', 'stored' from newer
union all select id, 'late', 'seq: before the last replacement' from students""",
            f"newer as (select {make_id('student', 'c_custkey')} as id from customer where c_custkey % 3 = 0)",
        ),
        "reject_vectors": """select vec_id, case vec_id % 7 when 1 then 'vector: unusable' when 2 then 'vector: unusable'
    when 3 then 'vector: unusable' when 4 then 'vector: unusable' else 'stored' end as fate from embeddings""",
        "enrich_repeated_keys": over(
            """select major_id as key, coalesce(array_to_string(skill_names, '|'), '') as names from students"""
        ),
        "chunk_plan": over(
            """select cast(place // 128 + 1 as integer) as chunk, count(*) as n_records,
  (select cast(ceil(count(*) / 128.0) as integer) from students) as n_chunks
from students group by 1"""
        ),
        "l2_normalize": """with scaled as (
  select vec_id, unnest(embedding) * 3::float as x, unnest(range(64)) as b from embeddings),
unit as (select vec_id, b,
  cast(x::double / sqrt(sum(x::double * x::double) over (partition by vec_id)) as float) as x from scaled)
select vec_id, """ + SHOWN + " as vector from unit where x <> 0 group by vec_id",
        "hash_embed": f"with {embedded('v', 'select doc_id, text from documents', DOCUMENT, 'doc_id')} "
        f"select doc_id, {SHOWN} as vector from v group by doc_id",
        "hash_embed_query": f"with {embedded('v', 'select conv_id, turn, text from conversations', QUERY, 'conv_id, turn')} "
        f"select conv_id, turn, {SHOWN} as vector from v group by conv_id, turn",
        "hash_embed_once": f"with {embedded('v', 'select conv_id, turn, text from conversations', QUERY, 'conv_id, turn')} "
        f"select conv_id, turn, {SHOWN} as vector from v group by conv_id, turn",
        "embed_batches": "select doc_id, true as rows_kept, true as chars_kept from documents",
        "compact_projects": over(
            """select id, case when place % 3 = 0 then upper(title) else title end as title
from projects where place % 5 <> 0"""
        ),
        "failed_bulk_sync": over("select id, name, 'skills: write of base: embedding failed' as error from skills"),
        "table_scan": over("select id, full_name, rank from professors where is_accepting_projects"),
        "merge_upsert": over(
            """select id, cast(-1 as bigint) as seq, full_name as payload from students
  where id not in (select id from latest)
union all select id, seq, payload from latest where op = 'U'""",
            f"latest as ({LATEST})",
        ),
        "delete_by_id": over(
            "select id, full_name from students where id not in (select id from changes where op = 'D')"
        ),
        "replace_snapshot": f"select {make_id('brand', 'p_brand')} as id, p_brand as name "
        "from (select distinct p_brand from part)",
        "names_by_ids": over(
            "select name from skills where name in (select unnest(skill_names) from students)"
        ),
        "lookup_by_id": over(
            "select c.id, full_name, major_id, s.id is not null as found "
            "from (select distinct id from changes) c left join students s on s.id = c.id"
        ),
        "enrich_labels": over(
            "select id, coalesce(array_to_string(skill_names, '|'), '') as names from students"
        ),
        "enrich_majors": over("select id, major_id, major_name as major from students"),
        "enrich_interests": over(
            "select id, coalesce(array_to_string(interest_areas, '|'), '') as areas from professors"
        ),
        "knn_all": dense_nearest("true"),
        "knn_arrow": dense_nearest("true"),
        "knn_grid": dense_nearest("true"),
        "knn_one_request": """with first as (
  select embedding::double[] as v from embeddings where vec_id = (select min(vec_id) from embeddings)),
ranked as (
  select vec_id as id, cast(row_number() over (order by floor(list_sum(list_transform(
      list_zip(embedding::double[], v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 1e9 + 0.5), vec_id)
    as integer) as rank from embeddings, first)
select rank, id from ranked where rank <= 100""",
        "knn_major_restricted": dense_nearest("(q.label = 0 or q.label = c.label)"),
        "knn_restricted_grid": dense_nearest("(q.label = 0 or q.label = c.label)"),
        "knn_per_request_limit": dense_nearest("true", "q.label * 11 + 1"),
        "knn_bool_filter": over(
            TAKE, embedded("v", PROFESSOR_TEXT, DOCUMENT), nearest("v", "v", PROFESSOR_PAIRS)
        ),
        "knn_conjunction": over(
            TAKE,
            embedded("v", PROFESSOR_TEXT, DOCUMENT),
            nearest("v", "v", PROFESSOR_PAIRS + " and c.rank = 'Full Professor'"),
        ),
        "squared_distance": """select a.vec_id, cast(floor(list_sum(list_transform(
  list_zip(a.embedding::double[], b.embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 1e6 + 0.5)
  as bigint) as millionths
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
        "recommend_projects": over(
            TAKE,
            embedded("q", f"select id, {PROJECT_QUERY} as text from students", QUERY),
            embedded("c", PROJECT_TEXT, DOCUMENT),
            nearest(
                "q",
                "c",
                'select s.id as request_id, p.id as id, 10 as "limit" from students s join projects p '
                "on s.major_id is null or s.major_id = p.major_id",
            ),
        ),
        "suggest_professors": over(
            TAKE,
            embedded("q", f"select id, {ADVISOR_QUERY} as text from projects", QUERY),
            embedded("c", PROFESSOR_TEXT, DOCUMENT),
            nearest(
                "q",
                "c",
                'select p.id as request_id, f.id as id, p.place % 20 + 1 as "limit" '
                "from projects p join professors f on f.is_accepting_projects",
            ),
        ),
        "recommend_skills": over(
            TAKE,
            embedded("q", f"select id, {SKILL_QUERY} as text from students", QUERY),
            embedded("c", SKILL_TEXT, DOCUMENT),
            nearest(
                "q",
                "c",
                'select s.id as request_id, k.id as id, 10 as "limit" from students s cross join skills k',
            ),
        ),
        "recommendation_lists": over(
            "select request_id, string_agg(id, '|' order by rank) as ids from ranked "
            'where rank <= "limit" group by request_id',
            embedded("q", f"select id, {SKILL_QUERY} as text from students", QUERY),
            embedded("c", SKILL_TEXT, DOCUMENT),
            nearest(
                "q",
                "c",
                'select s.id as request_id, k.id as id, 10 as "limit" from students s cross join skills k',
            ),
        ),
        "sync_students": over(
            f"select id, full_name, about_me, {SHOWN} as vector from final join v using (id) group by all",
            f"latest as ({LATEST})",
            synced,
            embedded("v", "select id, text from final", DOCUMENT),
        ),
        "bulk_sync_projects": over(
            f"""select id, title, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at,
  coalesce(array_to_string(list_transform(skill_names, lambda x: {SKILL_ID}), '|'), '') as skill_ids,
  {SHOWN} as vector from projects join v using (id) group by all""",
            embedded("v", PROJECT_TEXT, DOCUMENT),
        ),
        "bulk_sync_professors": over(
            f"""select id, is_accepting_projects,
  coalesce(array_to_string(list_transform(interest_areas, lambda x: {INTEREST_ID}), '|'), '') as interest_ids,
  {SHOWN} as vector from professors join v using (id) group by all""",
            embedded("v", PROFESSOR_TEXT, DOCUMENT),
        ),
        "bulk_sync_skills": over(
            f"select id, name, {SHOWN} as vector from skills join v using (id) group by all",
            embedded("v", SKILL_TEXT, DOCUMENT),
        ),
        "sync_projects": over(
            f"select id, title, {SHOWN} as vector from renamed join v using (id) group by all",
            "renamed as (select * replace (upper(title) as title) from projects)",
            embedded("v", f"select id, {PROJECT_DOCUMENT} as text from renamed", DOCUMENT),
        ),
        "delete_students": over(
            "select id, full_name from students where id not in (select id from changes where op = 'D')"
        ),
        "json_requests": over(
            f"""select id as request_id, cast(place % 20 + 1 as integer) as "limit", {ADVISOR_QUERY} as query
from projects"""
        ),
        "change_feed_fold": fold,
        "stream_change_feed": over(
            "select id, payload from latest where op = 'U'", f"latest as ({LATEST})"
        ),
        "run_metrics": over(
            " union all ".join(
                f"select '{stage}' as stage, count(*) as n_rows, cast(0 as bigint) as n_rejected, "
                f"cast(ceil(count(*) / 128.0) as integer) as n_chunks from {source}"
                for stage, source in (
                    ("skills", "skills"),
                    ("students", "students"),
                    ("professors", "professors"),
                    ("project_templates", "projects"),
                )
            )
        ),
    }
