"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations


def _floor_mean(total: str, count: str) -> str:
    """Their quotient rounded down, in whole numbers."""
    return f"(({total} - ((({total} % {count}) + {count}) % {count})) // {count})"


def op12_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rows are places of vectors: every part against every entry, all rounds written out."""
    steps = [
        """kept as materialized (
            select row_number() over () as r, vec_id, label, embedding,
                len(embedding) // 8 as w
            from embeddings
            where embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""parts as materialized (
            select r, p, list_transform(embedding[p * w + 1 : (p + 1) * w],
                lambda x: cast(floor(4096 * cast(x as double)) as hugeint)) as v
            from kept, range({parts}) as places(p))""",
        f"""book0 as materialized (
            select p, row_number() over (partition by p order by vec_id) - 1 as e, v
            from (select * from kept order by vec_id limit {entries}) join parts using (r))""",
    ]
    for n in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(
            f"""near{n} as materialized (
                select r, p, min(struct_pack(d := d, e := e)) as m
                from (select a.r, a.p, b.e, {distance} as d from parts a join book{n} b using (p))
                group by r, p)"""
        )
        if n == rounds:
            break
        steps.append(
            f"""mean{n} as materialized (
                select p, e, list(x order by i) as v
                from (
                    select p, e, i, {_floor_mean("sum(x)", "count(*)")} as x
                    from (
                        select p, m.e as e, unnest(v) as x, generate_subscripts(v, 1) as i
                        from near{n} join parts using (r, p))
                    group by p, e, i)
                group by p, e)"""
        )
        steps.append(
            f"""book{n + 1} as materialized (
                select p, e, coalesce(m.v, b.v) as v from book{n} b left join mean{n} m using (p, e))"""
        )
    last = f"near{rounds}"
    steps.append(
        f"""coded as materialized (
            select r, string_agg(printf('%02x', cast(m.e as int)), '' order by p) as code,
                cast(sum(m.d) as bigint) as error
            from {last} group by r)"""
    )
    steps.append(
        f"""numbers as (
            select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as h from book{rounds})"""
    )
    return (
        f"with {', '.join(steps)} select vec_id, label, code, error, "
        "cast(sum(error) over (partition by label) as bigint) as label_error, "
        "(select h from numbers) as codebooks_sha256 from coded join kept using (r)"
    )


def op11_negatives(positives: int = 5, negatives: int = 3) -> str:
    """Every anchor against every row."""
    return f"""
        with v as materialized (
            select vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label,
                list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        pairs as materialized (
            select a.vec_id as a, b.vec_id as b, a.label = b.label as same,
                cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as s
            from v a join v b on a.vec_id <> b.vec_id
            where a.vec_id % 50 = 0),
        near as (
            select a, b, s from pairs where same
            qualify row_number() over (partition by a order by s desc, b) <= {positives})
        select p.a as anchor_id, p.b as positive_id,
            cast(row_number() over (partition by p.a, p.b order by n.s desc, n.b) as int) as rank,
            n.b as negative_id, p.s as positive_score, n.s as negative_score
        from near p join pairs n using (a)
        where not n.same and 50 * p.s <= 100 * n.s and 100 * n.s <= 95 * p.s
        qualify rank <= {negatives}"""


ORACLE_SQL: dict[str, str] = {
    "op11_negatives": op11_negatives(),
    "op12_codes": op12_codes(),
}
