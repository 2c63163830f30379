"""Fingerprints, edited texts and likeness."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pairwright.llm import fingerprint, queries

SF_DIR = "/root/testdata/sf0.01"


def edited_texts(rows):
    """Row -> edited text; the next of a repeated id is its first text in order."""
    first = {}
    for doc_id, text in rows:
        if doc_id is not None:
            first[doc_id] = min(first.get(doc_id, text), text)
    ids = sorted(first)
    later = dict(zip(ids, ids[1:] + ids[:1]))
    out = []
    for doc_id, text in rows:
        following = first[later[doc_id]] if doc_id is not None else first[ids[0]]
        quarter = len(text) // 4
        out.append((doc_id, text, text[: len(text) - quarter] + following[:quarter]))
    return out


def checked(rows, got):
    expected = sorted(
        ((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e in edited_texts(rows)), key=repr
    )
    assert sorted(((r[0], r.n_chars, r.edited_sha256) for r in got), key=repr) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_documents(spark):
    documents = queries.table(spark, SF_DIR, "documents")
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    got = queries.op1_fingerprint(spark, SF_DIR).collect()
    checked(rows, got)
    text = dict(rows)
    prints = {}
    for r in got:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) > 0.95 * len(prints)
    mean = lambda name: sum(r[name] for r in got) / len(got)
    assert mean("near_edited") > 0.4 and mean("near_next") < 0.05


def test_rough_rows(spark):
    rows = [
        (5, "one two three four five six seven eight"), (1, None), (2, ""), (3, "!!! ???"),
        (5, "one two three four five six seven eight"), (5, "another text of the same id"),
        (7, "one two three four five six seven eight"), (9, "wörd " * 50_000), (None, "no id at all"),
        (-4, "x"),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table = table.withColumn("level", F.lit(1)).withColumn("row", F.lit(2)).withColumn("id", F.lit(3))
    for band in ({}, {"max_share": 0.0001}):
        got = fingerprint.fingerprints(table, **band).collect()
        checked([(d, t or "") for d, t in rows], got)
        same = {r.fingerprint for r in got if r.n_chars == len(rows[0][1]) and r[0] in (5, 7)}
        assert len(same) == 1
    assert fingerprint.fingerprints(table.limit(0)).count() == 0
    alone = fingerprint.fingerprints(table.filter("doc_id = 7")).first()
    assert alone.near_next == 1.0


def test_no_python_in_the_plan(spark):
    plan = queries.op1_fingerprint(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("count", [0, 1, 2, 3, 40])
def test_subsets_hold_what_their_level_leaves(spark, count):
    values = spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(max(count, 1))), lambda n: F.xxhash64(n).bitwiseAND(F.lit(~63).cast("long"))).alias("v")
    )
    if not count:
        values = values.select(F.array().cast("array<bigint>").alias("v"))
    level, whole, hashes = fingerprint._print(F.col("v"), F.lit(9).cast("long"))
    row = values.select(level.alias("level"), whole.alias("whole"), F.size(hashes).alias("n")).first()
    if count:
        assert row.level == count.bit_length() and row.n == 2 * fingerprint.SUBSETS
    else:
        assert row.level == fingerprint.ALL_TERMS and row.whole == 9 and row.n == 0


def near_copies(n, words=200, changed=3):
    """Texts that differ from one in a few words each."""
    base = [f"word{i}" for i in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in range(changed):
            own[(i * 31 + k * 17) % words] = f"own{i}x{k}"
        out.append(" ".join(own))
    return out


def test_a_third_of_the_rows_near_copies(spark):
    rows = [(3 * i, t) for i, t in enumerate(near_copies(100))]
    rows += [(j, " ".join(f"w{(j * 7 + k * k) % 900}" for k in range(60))) for j in range(300) if j % 3]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = fingerprint.lexicon(table, "text").join(
        spark.createDataFrame([(f"word{i}",) for i in range(200)], "word string").select(fingerprint.term("word").alias("term")), "term"
    )
    assert known.count() > 190
    got = [r for r in fingerprint.fingerprints(table).collect() if r.n_chars > 1000]
    assert len(got) == 100 and sum(r.near_edited for r in got) / len(got) > 0.3


def test_texts_without_a_lexicon_term_are_compared_by_degrees(spark):
    table = spark.createDataFrame(list(enumerate(near_copies(30))), "doc_id long, text string")
    # Nothing is in the band: all words are in too few texts or in too many.
    got = fingerprint.fingerprints(table, min_share=0.5, max_share=0.1).collect()
    assert len({r.fingerprint for r in got}) == 30
    assert all(r.fingerprint.count(",") == 2 * fingerprint.SUBSETS - 1 for r in got)
    likeness = [r.near_next for r in got]
    assert any(0 < x < 1 for x in likeness) and sum(likeness) / len(likeness) > 0.4


def test_letters_that_change_their_length_in_lower_case(spark):
    """A dotted capital I becomes two code points, a sigma at the end of a word another letter."""
    dots = "\u0130" * 40
    words = [f"{dots} {' '.join(f'word{k}' for k in range(30))} {end}" for end in ("alpha beta gamma", "delta epsilon zeta")]
    rows = list(enumerate([*words, words[0].lower(), "\u039f\u0394\u039f\u03a3 x", "\u03bf\u03b4\u03bf\u03c2 x"]))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(table, min_share=0.0, max_share=1.0).collect()}
    assert got[0].fingerprint != got[1].fingerprint and got[0].near_next < 1.0
    assert got[0].fingerprint == got[2].fingerprint
    assert got[3].fingerprint == got[4].fingerprint and got[3].near_next == 1.0
