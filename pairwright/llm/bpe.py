"""BPE encoding and decoding by a table of distinct words.

A text is cut into the words of the tokenizer's pattern; no merge crosses a word. A block of
rows has a table of its distinct words: each is encoded once, and its ids are joined back to
the words by position. A worker keeps the table from block to block up to a bound, so frequent
words are encoded once per worker. Decoding joins the ids to the id-to-piece table of the
vocabulary, which has a fixed size, and puts the pieces' bytes together. Texts never move:
one table for the whole corpus would shuffle every word occurrence twice, which takes several
times the input's size on disk, or broadcast a table that grows with the corpus.

Words are merged by tiktoken with the vocabulary of the tokenizer file where the file's merges
are in the order of their ids, which makes both libraries' results equal; by the tokenizers
library otherwise.

Texts are cut by array operations where every character is ASCII (without control characters
other than tab and line breaks) or a Latin letter of U+00C0 to U+017F; any other text, and one
with a special token's string in it, goes through the library whole. Both ways give the
library's ids.

A null text is empty and has no ids. Any text length, ties and repeated rows are allowed: every
row is worked out by itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairwright.llm.columns import run_hashes, text_slices, utf8

# Words kept by a Python worker from one block to the next.
CACHED_WORDS = 500_000
# Words joined by line breaks to one call of the encoder.
WORDS_PER_CALL = 4000
LINE_BREAK = "\n"

# Fixed value: the word pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LETTER, DIGIT, SPACE, OTHER, UNSAFE = range(5)


def _classes() -> np.ndarray:
    table = np.full(256, UNSAFE, np.uint8)
    table[0x20:0x7F] = OTHER
    for first, last, kind in (("A", "Z", LETTER), ("a", "z", LETTER), ("0", "9", DIGIT)):
        table[ord(first) : ord(last) + 1] = kind
    table[[0x09, 0x0A, 0x0D, 0x20]] = SPACE
    table[0x80:0xC0] = LETTER  # second byte of a letter
    table[0xC3:0xC6] = LETTER  # first byte of U+00C0 to U+017F
    return table


CLASSES = _classes()


class Vocabulary:
    """A byte-level tokenizer file: encoding by the library, pieces as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        pieces = {i: piece for piece, i in self.tokenizer.get_vocab(True).items()}
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        byte_of = _byte_alphabet()
        self.pieces = [
            added[i].encode()
            if i in added
            else bytes(byte_of[c] for c in pieces[i]) if i in pieces else b""
            for i in range(max(pieces) + 1)
        ]
        self.decimals = [b"%d" % i for i in range(len(self.pieces))]
        self.cache: dict[int, bytes] = {}
        self._ranked = self._by_rank(spec["model"], added)
        ids = self._ranked.encode_ordinary(LINE_BREAK) if self._ranked else []
        self._break = ids[0] if len(ids) == 1 else None

    def _by_rank(self, model: dict, added: dict[int, str]):
        """An encoder that merges by id, if the file's merges come in that order."""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        base = len(model["vocab"]) - len(made)
        if made != list(range(base, base + len(made))) or base != 256:
            return None
        import tiktoken

        ranks = {piece: i for i, piece in enumerate(self.pieces) if i not in added}
        return tiktoken.Encoding(
            "words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of single words of the pattern as 32-bit integers, many words to a call."""
        if self._ranked is None or self._break is None:
            return [np.array(ids, np.int32).tobytes() for ids in self.encode_each(words)]
        out = [b""] * len(words)
        rest = []
        for i, word in enumerate(words):
            if word.isspace():
                out[i] = np.array(self._ranked.encode_ordinary(word), np.int32).tobytes()
            else:
                rest.append(i)
        for first in range(0, len(rest), WORDS_PER_CALL):
            some = rest[first : first + WORDS_PER_CALL]
            joined = LINE_BREAK.join([words[i] for i in some])
            ids = np.array(self._ranked.encode_ordinary(joined), np.int32)
            ends = np.append(np.flatnonzero(ids == self._break), len(ids)).tolist()
            raw, begin = ids.tobytes(), 0
            for i, end in zip(some, ends, strict=True):
                out[i] = raw[4 * begin : 4 * end]
                begin = end + 1
        return out

    def encode_each(self, texts: list[str]) -> list[list[int]]:
        if not texts:
            return []
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in encoded]


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return alphabet | {chr(0x100 + n): b for n, b in enumerate(rest)}


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pattern's words start in texts of safe characters, laid end to end.

    The pattern takes, in this order: an apostrophe with s, t, re, ve, m, ll or d; runs of
    letters, digits or other signs, each with one space before; white space that no other sign
    follows at once; other white space.
    """
    n = len(data)
    kind = CLASSES[data]
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:n])
    new |= text_start
    # The last character of white space that something follows stands by itself or, if it is a
    # plain space, opens the next word.
    before = np.flatnonzero(new[1:n] & (kind[:-1] == SPACE) & ~text_start[1:n])
    new[before] = True
    joined = before[data[before] == 0x20]
    new[joined + 1] = False
    # An apostrophe alone between letters takes a short ending with it.
    at = np.flatnonzero((data == 0x27) & new[:n])
    at = at[at + 1 < n]
    at = at[new[at + 1] & (kind[at + 1] == LETTER) & ~text_start[at + 1]]
    if len(at):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = padded[at + 1], padded[at + 2]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = one.astype(np.uint16) << 8 | two
        double = np.isin(pair, [int.from_bytes(p, "big") for p in (b"re", b"ve", b"ll")])
        double &= ~text_start[np.minimum(at + 2, n)]
        new[at[single | double] + 1] = False
        for ends in (at[single] + 2, at[double & ~single] + 3):
            new[ends] = True
    return np.flatnonzero(new[:n])


def safe_texts(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Which texts can be cut by `word_starts`."""
    bad = CLASSES[data] == UNSAFE
    # The two signs among the letters of U+00C0 to U+00FF.
    bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    places = np.flatnonzero(bad)
    whole = data.tobytes()
    found = []
    for token in special:
        at = whole.find(token)
        while at >= 0:
            found.append(at)
            at = whole.find(token, at + 1)
    safe = np.ones(len(offsets) - 1, bool)
    for at in (places, np.array(found, np.int64)):
        safe[np.searchsorted(offsets, at, side="right") - 1] = False
    return safe


def encoded(
    texts: pa.Array, vocab: Vocabulary
) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts end to end and the offsets of each text's ids."""
    data, offsets = utf8(texts)
    safe = safe_texts(data, offsets, vocab.special)
    whole: dict[int, np.ndarray] = {}
    if not safe.all():
        rows = np.flatnonzero(~safe)
        strings = [data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in rows]
        for row, ids in zip(rows, vocab.encode_each(strings), strict=True):
            whole[int(row)] = np.array(ids, np.int32)
        sizes = np.where(safe, np.diff(offsets), 0)
        data = data[np.repeat(safe, np.diff(offsets))]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    starts = word_starts(data, offsets)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    hashes, first, inverse = np.unique(
        run_hashes(data, starts, ends), return_index=True, return_inverse=True
    )
    cache = vocab.cache
    table = list(map(cache.get, hashes.tolist()))
    missing = [i for i, ids in enumerate(table) if ids is None]
    if missing:
        at = first[missing]
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if len(cache) + len(missing) > CACHED_WORDS:
            cache.clear()
        for i, ids in zip(missing, vocab.encode_words(words), strict=True):
            table[i] = ids
        if len(missing) <= CACHED_WORDS:
            cache.update((int(hashes[i]), table[i]) for i in missing)
    sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
    flat = np.frombuffer(b"".join(table), np.int32)
    begin = np.cumsum(sizes) - sizes
    per_word = sizes[inverse]
    word_ends = np.cumsum(per_word)
    total = int(word_ends[-1]) if len(word_ends) else 0
    ids = flat[np.arange(total) + np.repeat(begin[inverse] - (word_ends - per_word), per_word)]
    # Words before each text's start give the place of its first id.
    words_before = np.searchsorted(starts, offsets)
    id_offsets = np.concatenate([[0], word_ends])[words_before]
    if whole:
        parts = [
            whole.get(r, ids[id_offsets[r] : id_offsets[r + 1]]) for r in range(len(offsets) - 1)
        ]
        ids = np.concatenate(parts) if parts else ids
        id_offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    return ids, id_offsets


def digests(
    documents: DataFrame, path: str, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row's whole text."""
    schema = documents.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string")
    schema = schema.add("decoded_sha256", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for rows in text_slices(batches, text):
            ids, at = encoded(rows.column(text), vocab)
            counts, id_hash, text_hash = [], [], []
            for row in range(rows.num_rows):
                own = ids[at[row] : at[row + 1]].tolist()
                counts.append(len(own))
                joined = b",".join(map(vocab.decimals.__getitem__, own))
                id_hash.append(hashlib.sha256(joined).hexdigest())
                text_hash.append(hashlib.sha256(decoded(own, vocab)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column(key), pa.array(counts, pa.int64()), pa.array(id_hash), pa.array(text_hash)],
                names=schema.names,
            )

    return documents.select(key, text).mapInArrow(work, schema)


def decoded(ids: list[int], vocab: Vocabulary) -> bytes:
    """The text of the ids as UTF-8; bytes that are no UTF-8 are replaced, as the library does."""
    raw = b"".join(map(vocab.pieces.__getitem__, ids))
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()
