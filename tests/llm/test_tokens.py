"""Encoding, packing, sharding and chat formatting against brute force."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwright.llm import bpe, chat, packing, queries, sharding

SF_DIR = "/root/testdata/sf0.001"
ROUGH = [
    (1, "plain words, and 12 numbers it's we've  two spaces\n\nlines "),
    (2, None),
    (3, ""),
    (4, "日本語 <|endoftext|>  \x0b ×÷ naïve"),
    (5, "word " * 30_000),
    (6, "x" * 5000),
    (7, "plain words, and 12 numbers it's we've  two spaces\n\nlines "),
    (7, "plain words, and 12 numbers it's we've  two spaces\n\nlines "),
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def rough(spark):
    rows = spark.createDataFrame(ROUGH, "doc_id long, text string")
    return rows.withColumn("start", F.lit("clash")).withColumn("copies", F.lit(1))


def documents(spark):
    return queries.table(spark, SF_DIR, "documents")


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_random_texts_encode_as_the_library(tokenizer):
    random.seed(5)
    parts = list("'strevld \n\t\ra1!Sé") + ["''", "  ", "ß", "Ā", "×", "<|endoftext|>", "日", "\x0b", " "]
    texts = ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(5000)]
    vocab = bpe.vocabulary(queries.tokenizer_path())
    ids, at = bpe.encoded(pa.array(texts), vocab)
    for row, text in enumerate(texts):
        own = ids[at[row] : at[row + 1]].tolist()
        assert own == ids_of(tokenizer, text), text
        assert bpe.decoded(own, vocab).decode() == tokenizer.decode(own, skip_special_tokens=False)


def test_digests(spark, tokenizer, rough):
    for rows in (rough, documents(spark)):
        texts = {(r.doc_id, r.text) for r in rows.collect()}
        expected = set()
        for doc_id, text in texts:
            ids = ids_of(tokenizer, text)
            joined = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            back = tokenizer.decode(ids, skip_special_tokens=False)
            expected.add((doc_id, len(ids), joined, hashlib.sha256(back.encode()).hexdigest()))
        got = bpe.digests(rows, queries.tokenizer_path())
        assert got.count() == rows.count()
        assert {tuple(r) for r in got.collect()} == expected


def check_packed(rows, packed, tokenizer):
    ids = {}
    copies = defaultdict(int)
    for r in rows:
        ids[r.doc_id] = [*ids_of(tokenizer, r.text), 1]
        copies[r.doc_id] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in packed:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and len(own) == p.length
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        pieces[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    for doc_id, own in ids.items():
        covered = sorted(pieces[doc_id])
        per_copy = covered[:: copies[doc_id]]
        assert sorted(per_copy * copies[doc_id]) == covered
        at = 0
        for start, length in per_copy:
            assert start == at
            at += length
        assert at == len(own)
    filled = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        filled += at
    return filled, len(sequences)


def test_pack(spark, tokenizer, rough):
    path = queries.tokenizer_path()
    check_packed(rough.collect(), packing.pack(rough, path).collect(), tokenizer)
    rows = documents(spark)
    filled, windows = check_packed(rows.collect(), packing.pack(rows, path).collect(), tokenizer)
    assert filled / (windows * packing.CAPACITY) > 0.97
    assert packing.pack(rows.limit(0), path).count() == 0


def test_window_count_rises_when_differencing_exceeds_the_capacity():
    import numpy as np

    window = packing.packed_group(np.array([6, 6, 6, 6, 6]), 10)
    assert sorted(np.bincount(window)) == [1, 1, 1, 1, 1]


def test_shard(spark, rough):
    for rows in (rough, documents(spark), rough.limit(0)):
        got = sharding.shard(rows, [1.0] * 4, [1.0] * 5).collect()
        assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
            (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
            for r in rows.collect()
        )
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 4)
        for numbers in slots.values():
            assert sorted(numbers) == list(range(len(numbers)))


def test_shard_of_many_equal_rows_and_weights(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") < 10_000, 7).otherwise(F.col("id")).alias("doc_id"),
        F.lit("same").alias("text"),
    )
    got = sharding.shard(rows, [1.0, 3.0], [1.0, 3.0, 1.0])
    counts = {r.shard: r["count"] for r in got.filter("doc_id <> 7").groupBy("shard").count().collect()}
    assert 2.7 < counts[1] / counts[0] < 3.3
    hot = got.filter("doc_id = 7").agg(F.countDistinct("shard"), F.countDistinct("slot")).first()
    assert tuple(hot) == (1, 10_000)
    with pytest.raises(ValueError):
        sharding.shard(rows, [0.0], [1.0])


def test_templates():
    text = "{% for t in turns %}{% if t.role == 'user' %}U{% elif t.role == 'x' %}X{% else %}" \
        "{{ t.text | trim | upper }}{% endif %}{% endfor %}{# gone #}"
    render = chat.compiled(text)
    turns = [{"role": "user", "text": "a"}, {"role": "x", "text": ""}, {"role": "y", "text": " b"}]
    assert render(turns) == ("UXB", [])
    assert chat.folded(chat.parse("{% if 'a' == 'b' %}x{% else %}y{{ 'q' + 'r' | upper }}{% endif %}!")) == (
        chat.Output(chat.Literal("yqR!")),
    )
    for bad in ("{{ a.__class__ }}", "{{ open('x') }}", "{% for x in y %}{% endfor %}",
                "{% if a %}", "{% endif %}", "{{ a | run }}", "{% import os %}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(bad)


def test_escapes_leave_no_control_string():
    random.seed(4)
    parts = [*chat.CONTROLS, "\\", "<", "s", ">", "|", "[", "]", "/", "INST", "a"]
    for _ in range(20_000):
        text = "".join(random.choices(parts, k=random.randint(0, 9)))
        escaped = chat.escaped(text)
        assert chat.unescaped(escaped) == text
        for control in chat.CONTROLS:
            assert control not in escaped
            # None begins in the text and ends in what the template says next.
            assert all((escaped + other).find(control) in (-1, len(escaped)) or control in other
                       for other in chat.CONTROLS)


def test_conversations(spark):
    random.seed(9)
    parts = [*chat.CONTROLS, "\\", "<", "s", ">", "|", "[", "INST]", "a", "\n", "é"]
    rows = []
    for conv in range(300):
        for turn in range(random.randint(1, 5)):
            text = None if random.random() < 0.1 else "".join(random.choices(parts, k=random.randint(0, 9)))
            role = random.choice(["user", "assistant", "system", None])
            if random.random() < 0.3:
                role = "".join(random.choices(parts, k=random.randint(1, 4)))
            rows.append((conv, turn, role, text))
    rows += [(400, None, "user", "n"), (400, 2, "user", "n"), (400, 2, "user", "n"), (None, 0, "assistant", "z" * 100_000)]
    random.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(table)).collect()}
    whole = defaultdict(list)
    for conv, turn, role, text in rows:
        whole[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(whole)
    for conv, turns in whole.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(table.limit(0)).count() == 0
    assert queries.op10_chat(spark, SF_DIR).filter("conv_id = -1").first().n_turns == 2
