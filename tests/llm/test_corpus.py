"""Language, near-duplicates, repeated strings and the pipeline against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwright.llm import columns, langid, minhash, passages, queries, suffix
from pairwright.llm.components import components

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return queries.table(spark, SF_DIR, "documents")


# --- language --------------------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], hidden=3)
    data = rng.integers(0, 5, (6, 4)).astype(np.uint8)
    inside = (np.arange(6)[:, None] < np.array([6, 4, 2, 6])).astype(np.float32)
    labels = np.array([0, 1, 2, 1])
    _, grads = langid.gradients(net, data, inside, labels)
    for weights, grad in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = weights[at]
        losses = []
        for step in (0.01, -0.01):
            weights[at] = old + step
            losses.append(langid.gradients(net, data, inside, labels)[0])
        weights[at] = old
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(grad[at], rel=0.02, abs=1e-4)


def test_language_of_held_out_documents(spark):
    rows = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op3_language(spark, "/root/testdata/sf0.01").join(rows, "doc_id").collect()
    assert len(got) == rows.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    tested = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang_pred == r.lang for r in tested) / len(tested) >= 0.95


def test_language_of_rough_rows(spark, documents):
    net = langid.learned(documents)
    rough = spark.createDataFrame(
        [(1, None), (2, ""), (3, "123 --- !"), (4, "The theory of the other"), (None, "the"),
         (6, "the other and that " * 20_000), (6, "x")],
        "doc_id long, text string",
    ).withColumn("held_out", F.lit("clash")).withColumn("readable", F.lit("clash"))
    got = langid.predict(rough, net)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {(r.doc_id, r.lang_pred, r.score == 0) for r in got.collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True)} <= rows and got.count() == 7
    assert langid.predict(rough.limit(0), net).count() == 0
    unlabelled = rough.withColumn("lang", F.lit(None).cast("string"))
    assert langid.learned(unlabelled) is None
    assert {r.lang_pred for r in langid.predict(rough, None).collect()} == {"und"}
    kept = langid.keep_known(rough, net)
    assert kept.columns == rough.columns and kept.count() == 4
    assert sorted(langid.keep_known(rough, None).collect(), key=str) == sorted(kept.collect(), key=str)


# --- near-duplicates -------------------------------------------------------------------------


def shingles(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def expected_groups(rows, words):
    """doc_id -> smallest doc_id reachable, from all pairs that share a shingle."""
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, words)) for d, t in rows]
    lists = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(sets):
        common = Counter(j for x in s for j in lists[x] if j < i)
        for j, n in common.items():
            e, o = sets[j]
            if 100 * n >= 80 * (len(s) + len(o) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in parent}, sets


def test_near_duplicates(spark):
    random.seed(2)
    words = [f"w{n}" for n in range(60)]
    rows = [(1000, None), (1001, ""), (1002, " \t "), (1003, "One"), (1004, "one"), (1005, "\x0bone ")]
    base = [random.choice(words) for _ in range(300)]
    number = 0
    for group in range(12):
        text = random.choices(words, k=random.choice([2, 3, 4, 5, 6, 8, 12, 40, 90, 300]))
        for _ in range(random.randint(1, 9)):
            edited = [random.choice(words) if random.random() < 0.03 else w for w in text]
            rows.append((number, " ".join(edited)))
            number += 1
    for _ in range(80):  # one large group, longer than any list
        edited = [random.choice(words) if random.random() < 0.02 else w for w in base]
        rows.append((number, " ".join(edited).title()))
        number += 1
    rows += [rows[30], (2000, rows[40][1]), (2000, rows[50][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    for size in (2, 5):
        expected, sets = expected_groups(rows, size)
        got = minhash.near_duplicates(table, words=size).collect()
        assert len(got) == len(rows)
        assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(s)) for d, s in sets)
        assert {r.doc_id: r.component_id for r in got} == expected
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.keep_one(table, words=2)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == set(expected_groups(rows, 2)[0].values())
    assert minhash.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [3, 1_000_000])
def test_outliers_of_a_crowd(spark, monkeypatch, crowd):
    """Copies at about the limit: some are alike with few others only, or with each other only."""
    random.seed(5)
    words = [f"w{n}" for n in range(400)]
    rows, number = [], 0
    for n_words, copies in ((120, 150), (40, 60)):
        base = random.choices(words, k=n_words)
        for _ in range(copies):
            rate = random.choice([0.0, 0.02, 0.04, 0.06, 0.08])
            edited = [random.choice(words) if random.random() < rate else w for w in base]
            rows.append((number, " ".join(edited)))
            number += 1
        outlier = [random.choice(words) if random.random() < 0.09 else w for w in base]
        for _ in range(20):
            edited = [random.choice(words) if random.random() < 0.03 else w for w in outlier]
            rows.append((number, " ".join(edited)))
            number += 1
    random.shuffle(rows)
    monkeypatch.setattr(minhash, "CROWD", crowd)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected, _ = expected_groups(rows, 2)
    assert len(set(expected.values())) > 10
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table, words=2).collect()}
    assert got == expected


def test_pairs_within_a_crowd_are_those_of_brute_force(spark):
    """Of every pair that is alike, both are linked with the set nearest the base or they meet."""
    random.seed(6)
    base = [f"w{n}" for n in range(60)]
    texts = {0: base}
    for node in range(1, 120):
        texts[node] = [f"x{random.randrange(30)}" if random.random() < 0.06 else w for w in base]
    sets = {n: {(a, b) for a, b in zip(t, t[1:])} for n, t in texts.items()}
    # Roots as if nothing had been linked but the first hundred.
    root = {n: 0 if n < 100 else n for n in texts}
    table = spark.createDataFrame([(n, " ".join(t)) for n, t in texts.items()], "node long, content string")
    near = spark.createDataFrame([(0, n, root[n]) for n in texts], "main long, node long, root long")
    centres = spark.createDataFrame([(0, " ".join(base))], "main long, base string")
    none = np.zeros(0, np.uint64)
    rows = minhash.stored(minhash.deviations(near, table, centres, none, 2, 80))
    pairs = {(r.a, r.b) for r in minhash.among_crowds(rows, 80).collect()}
    best = min(texts, key=lambda n: (180 * len(sets[n] ^ sets[0]) - 20 * len(sets[n]), n))
    alike = [
        (a, b) for a in texts for b in range(max(a + 1, 100), len(texts))
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    assert alike
    for a, b in alike:
        through = all(n == best or root[n] == root[best] or (min(n, best), max(n, best)) in pairs for n in (a, b))
        assert (a, b) in pairs or through
    assert len(pairs) < 120 * 20 / 4


def test_rows_without_a_key_are_nobodys_copy(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "p q r s"), (1, "a b c d"), (2, "a b c d"), (3, "p q r s")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(table, words=2).collect()), key=repr)
    assert got == [(1, 1, True), (2, 1, False), (3, 3, True)] + [(None, None, True)] * 3
    assert minhash.keep_one(table, words=2).count() == 5


def test_near_duplicates_of_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected, _ = expected_groups(rows, 2)
    got = {r.doc_id: r.component_id for r in queries.op4_minhash(spark, SF_DIR).collect()}
    assert got == expected


def test_components(spark):
    random.seed(1)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 200)]
    links = spark.createDataFrame([*chain, *star, (300, 300), (7, 3)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 200)} | {300: 300}
    assert components(links.limit(0)).count() == 0


# --- repeated strings ------------------------------------------------------------------------


def expected_removal(rows, length):
    counts = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        counts.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(
    "length,gram,group,fits",
    [(40, 8, 50_000, 1 << 25), (20, 20, 50_000, 12_000), (30, 7, 3, 1 << 25), (30, 7, 50_000, 0)],
)
def test_repeats(spark, monkeypatch, length, gram, group, fits):
    """Also with spans, or keys as well, that are too large to be broadcast."""
    monkeypatch.setattr(suffix, "BROADCAST_BYTES", fits)
    random.seed(4)
    pieces = ["".join(random.choices("abé ", k=random.randint(1, 30))) for _ in range(25)]
    rows = [(i, None if i % 20 == 9 else "".join(random.choices(pieces, k=random.randint(0, 12)))) for i in range(120)]
    rows += [(200, "a" * 300), (201, "ab" * 100), (202, rows[3][1]), (203, rows[3][1]), (203, rows[3][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = suffix.digests(table, length=length, gram=gram, group=group)
    assert sorted(tuple(r) for r in got.collect()) == expected_removal(rows, length)


def test_rows_of_a_frequent_string_stay_apart(spark):
    same = b"x" * 20 + b"y" * 20
    rows = [(b"%d" % i, 10, 10, same if i % 10 else b"%040d" % i) for i in range(400)]
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        segments = spark.createDataFrame(rows, "key binary, at int, far int, segment binary")
        found = suffix._counted_spans(segments.repartition(8), 40)
        got = found.withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(bytes(r.key) for r in got) == sorted(r[0] for r in rows if r[3] == same)
    assert {(r.first, r.last) for r in got} == {(0, 40)}
    assert max(Counter(r.part for r in got).values()) < len(got) / 4


def test_repeats_of_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = queries.op8_suffix(spark, SF_DIR).collect()
    assert sorted(tuple(r) for r in got) == expected_removal(rows, suffix.LENGTH)
    assert suffix.digests(documents.limit(0)).count() == 0


def test_texts_without_repeats(spark):
    rows = [(1, "é" * 30 + "tail", "k", 34), (2, None, None, None), (3, "short", "k", 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, whole string, n_chars long")
    got = {r.doc_id: tuple(r) for r in suffix.without_repeats(table, length=21, gram=5).collect()}
    assert got == {1: (1, "tail", "k", 4), 2: (2, None, None, None), 3: (3, "short", "k", 5)}


# --- pipeline --------------------------------------------------------------------------------


def most_memory(work):
    """Its result and the bytes it held beyond those from before."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sorting_segments_takes_few_bytes_for_each_symbol():
    rng = np.random.default_rng(5)
    text = rng.bytes(100_000)
    at = np.repeat(rng.integers(0, 99_000, 4000), 2)
    far = rng.integers(60, 337, len(at))
    near = rng.integers(64, 401, len(at))
    segments = [text[a + 400 - f : a + 400 + n] for a, f, n in zip(at, far, near)]
    group = np.repeat(np.arange(4000), 2)
    hit, most = most_memory(lambda: suffix.repeated(segments, group, far, 400))
    assert most < 10 * sum(map(len, segments))
    for i in range(0, len(at), 2):
        # Strings of 400 bytes that both segments of a pair hold start so far before the anchor.
        first, last = 400 - far[i : i + 2].min(), min(near[i : i + 2].min(), 400)
        want = [far[i : i + 2].min() >= d >= 400 - last for d in range(hit.shape[0])]
        assert first >= 0 and hit[:, i].tolist() == want and hit[:, i + 1].tolist() == want


def test_hashing_runs_takes_memory_for_a_bounded_part_of_them():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 3 << 20).astype(np.uint8)
    ends = np.cumsum(np.r_[rng.integers(1, 12, 100_000), 700_000, rng.integers(1, 80, 20_000)])
    starts = np.r_[0, ends[:-1]]
    hashes, most = most_memory(lambda: columns.run_hashes(data, starts, ends))
    assert most < 45 << 20
    for i in [*range(50), *range(99_990, 100_010), 120_000]:
        alone = columns.run_hashes(data[starts[i] : ends[i]], np.array([0]), ends[i : i + 1] - starts[i])
        assert alone[0] == hashes[i]


def test_pipeline_deals_texts_in_small_batches(spark):
    size = corpus_pipeline.BATCH_SIZE
    rows = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.concat(F.lit("some words "), F.col("id").cast("string")), 2000).alias("text"),
        F.lit("en").alias("lang"),
        F.lit("web").alias("source"),
        F.lit(0).cast("long").alias("n_chars"),
    )

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    before = spark.conf.get(size, None)
    try:
        spark.conf.unset(size)
        for _, stage in corpus_pipeline.STAGES[:1]:
            kept = stage(spark, rows.coalesce(1), SF_DIR)
            got = [r.size for r in kept.coalesce(1).mapInArrow(sizes, "size long").collect()]
            assert sum(got) > 12_000_000 and max(got) < 2_000_000
        spark.conf.set(size, "1m")
        corpus_pipeline.prepared(spark)
        assert spark.conf.get(size) == "1m"
        spark.conf.unset(size)
        corpus_pipeline.run(spark, SF_DIR)
        assert spark.conf.get(size, None) is None
    finally:
        spark.conf.unset(size) if before is None else spark.conf.set(size, before)


def test_pipeline(spark, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeats", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, documents, SF_DIR)
    rows = {r.doc_id: r for r in documents.collect()}
    assert {r.doc_id for r in first.collect()} == {
        d for d, r in rows.items() if any(c.isalpha() for c in r.text or "")
    }
    second = stages["near_duplicates"](spark, first, SF_DIR)
    groups, _ = expected_groups([(r.doc_id, r.text) for r in first.collect()], 5)
    assert {r.doc_id for r in second.collect()} == set(groups.values())
    third = stages["repeats"](spark, second, SF_DIR)
    assert first.columns == second.columns == third.columns == documents.columns
    removed = {r[0]: r for r in expected_removal([(r.doc_id, r.text) for r in second.collect()], suffix.LENGTH)}
    for r in third.collect():
        assert len(r.text.encode()) <= removed[r.doc_id][1] - removed[r.doc_id][2]
        assert r.n_chars == len(r.text)
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(groups.values())
    empty = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0


# --- passages --------------------------------------------------------------------------------


def expected_passages(rows, words):
    counts = Counter()
    places = {d: [m.span() for m in re.finditer(r"\S+", t or "")] for d, t in rows}
    runs = {}
    for d, t in rows:
        own = [t[a:b] for a, b in places[d]]
        runs[d] = [tuple(own[i : i + words]) for i in range(len(own) - words + 1)]
        counts.update(runs[d])
    out = {}
    for d, t in rows:
        gone = bytearray(len(t or ""))
        for i, run in enumerate(runs[d]):
            if counts[run] > 1:
                a, b = places[d][i][0], places[d][i + words - 1][1]
                gone[a:b] = b"\1" * (b - a)
        out[d] = None if t is None else "".join(c for c, g in zip(t, gone) if not g)
    return out


@pytest.mark.parametrize("words,gram", [(7, 3), (5, 5), (9, 2)])
def test_repeated_passages(spark, words, gram):
    random.seed(6)
    blank = [" ", "\n", "\u3000", "  ", "\u00a0", "\u2028", "\x85", "\t"]
    word = lambda: "".join(random.choices("abé\u2030", k=random.randint(1, 3)))
    pieces = [[word() for _ in range(random.randint(1, 6))] for _ in range(40)]
    rows = []
    for i in range(150):
        chosen = [w for p in random.choices(pieces, k=random.randint(0, 12)) for w in p]
        rows.append((i, "".join(w + random.choice(blank) for w in chosen)))
    rows += [(200, "a " * 40), (201, " "), (202, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {bytes(r.key): r for r in passages.repeated_passages(table, words, gram=gram).collect()}
    expected = expected_passages(rows, words)
    some = 0
    for d, text in rows:
        r = found.get(hashlib.sha256(text.encode()).digest()[:16])
        kept, runs = suffix._kept(text.encode(), r and r.whole, r and r.spans)
        if not (r and r.whole):
            assert kept.decode() == expected[d]
            some += runs
    assert some > 20


def test_pipeline_takes_out_short_passages_of_over_50_words(spark):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=random.randint(1, 3)))
    own = lambda: " ".join(word() + "x" for _ in range(80))
    passage = [" ".join(word() for _ in range(n)) for n in (51, 50)]
    assert len(passage[0]) < 200
    left, right = " ".join(word() for _ in range(30)), " ".join(word() for _ in range(30))
    texts = {
        1: f"{own()} {passage[0]} {own()}", 2: f"{own()}\n{passage[0]}\n{own()}",
        3: f"{own()} {passage[1]} {own()}", 4: f"{own()} {passage[1]} {own()}",
        # Two short passages side by side, each repeated elsewhere, are no long one.
        5: f"{own()} {left} {right} {own()}", 6: f"{own()} {left} {own()}", 7: f"{own()} {right} {own()}",
        8: None, 9: "",
    }
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["repeats"]
    got = {r.doc_id: r.text for r in stage(spark, table, SF_DIR).collect()}
    expected = texts | {d: texts[d].replace(passage[0], "") for d in (1, 2)}
    assert got == expected


def test_copies_of_enough_words_go_whole(spark):
    short, long = "w" * 70 + " " + "v" * 70, " ".join("abcdefgh"[i % 8] + str(i) for i in range(51))
    table = spark.createDataFrame([(1, short), (2, short), (3, long), (4, long)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix.without_repeats(table, words=51).collect()}
    assert got == {1: short, 2: short, 3: "", 4: ""}
