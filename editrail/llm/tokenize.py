"""Encoding of a corpus with a public byte-level BPE vocabulary.

`Encoder` reproduces the merges exactly without merging: the bytes of a piece, mapped to Latin-1, go
through a pyahocorasick automaton that gives the longest token at each place; the encoder then walks
forward over longest tokens and backtracks to shorter ones wherever two neighbours would have merged
otherwise. Whether two tokens may stand side by side is memoised, and so are whole pieces.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from editrail.runtime import read_table, spread

#: Where the vocabularies lie; a parameter of every function that reads one.
TOKENIZERS = os.environ.get("EDITRAIL_TOKENIZERS", "/opt/tokenizers")

# How the vocabulary's makers split text before merging (fixed value). \s is Unicode's White_Space,
# written out since libraries disagree on the information separators.
_WS = r"\t-\r\x20\x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

#: Entries kept in a worker's memory of words; beyond it the memory starts anew. No result depends on it.
MEMORY_WORDS = 200_000
#: Tokens in one outgoing Arrow batch, at least.
BATCH_TOKENS = 1_000_000


class Encoder:
    """text -> token ids, without special tokens. None and empty text give no ids."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.size = {i: len(t) for t, i in self.ranks.items()}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(SPLIT).findall
        # a space before a visible character always begins a piece, so text may be cut there first
        self.cut = re.compile(r" (?=\S)").split

    def merged(self, data: bytes) -> list[int]:
        """By the definition: join the neighbours of lowest rank until none can be joined."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def side_by_side(self, left: int, right: int) -> bool:
        """Do the merges of the two tokens' joint bytes end in just these two?"""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * MEMORY_WORDS:
                self.fits.clear()
            known = self.fits[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of a token, -1 if none."""
        known = self.shorter.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
            self.shorter[token] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece, in time linear in its length."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest = [-1] * len(data)
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = token  # ends ascend, so the last one kept is the longest
        out: list[int] = []
        dead = bytearray(len(data) + 1)  # places from which no way leads on
        at, token = 0, longest[0]
        while True:
            end = at + self.size[token]
            if not dead[end] and (not out or self.side_by_side(out[-1], token)):
                out.append(token)
                if end == len(data):
                    return out
                at, token = end, longest[end]
                continue
            token = self.prefix(token)
            while token < 0:
                dead[at] = 1
                back = out.pop()
                at -= self.size[back]
                token = self.prefix(back)

    def word(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        pieces = self.pieces
        for p in self.split(text):
            known = pieces.get(p)
            if known is None:
                known = tuple(self.piece(p.encode("utf-8", "replace")))
                if len(p) < 64:
                    if len(pieces) > MEMORY_WORDS:
                        pieces.clear()
                    pieces[p] = known
            ids += known
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        words = self.words
        if len(words) > MEMORY_WORDS:
            words.clear()
        first, *rest = self.cut(text)
        out += self.word(first)
        for w in rest:
            ids = words.get(w)
            if ids is None:
                ids = self.word(" " + w)
                if len(w) < 64:
                    words[w] = ids
            out += ids
        return out


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder_of(rank_file: bytes) -> Encoder:
    """One encoder to a Python worker and vocabulary, kept from task to task."""
    return Encoder(rank_file)


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): one row per row of docs. Null and empty texts have an empty list.

    Whole texts of any length; ties, repeated rows and null keys pass through; other columns are
    not read. No shuffle,
    unless the input is too small for the cores. The vocabulary (under a megabyte, whatever the corpus) is broadcast.
    """
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary(name, folder))
    slim = docs.select(key, text)
    schema = f"`{key}` {slim.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(vocab.value).encode

        def batch(keys: pa.Array, flat: list[int], ends: list[int]) -> pa.RecordBatch:
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            return pa.RecordBatch.from_arrays([keys, ids], names=[key, "ids"])

        for b in batches:
            flat, ends, start = [], [0], 0
            for k, t in enumerate(b.column(1)):
                flat += encode(t.as_py())
                ends.append(len(flat))
                if len(flat) >= BATCH_TOKENS:
                    yield batch(b.column(0).slice(start, k + 1 - start), flat, ends)
                    flat, ends, start = [], [0], k + 1
            if start < b.num_rows:
                yield batch(b.column(0).slice(start), flat, ends)

    return spread(slim).mapInArrow(run, schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))
