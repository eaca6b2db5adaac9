"""Alignment of two tokenizers by their bytes.

A token covers a run of bytes, so the tokens of a text are the rows of a 0/1 matrix over its bytes. For tokenizers A and B the product A B' links
the tokens that share bytes and says how many; groups end where tokens of both end, and the product of the token-by-group matrices
links the tokens of one group. A text is cut into words that neither tokenizer reads across, and every distinct word
of a block is encoded and multiplied once; texts are runs of words.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrisk.llm._incidence import Csr
from quillrisk.llm._packed import flat, pack, unpack
from quillrisk.llm._tokens import SLICE_BYTES
from quillrisk.session import durable

#: Bytes of text in a block; words that are encoded and words that are multiplied at a time.
BLOCK_BYTES, WORDS_AT_ONCE, ALIGNED_AT_ONCE = 4 * SLICE_BYTES, 1 << 13, 1 << 15
#: Fixed value: how byte-level BPE cuts texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE_MARK = "▁"
PATHS = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")

#: Bytes that begin (or may begin) white space, and bytes that end it after one of ``BEFORE_END``; ASCII white space is in both.
ASCII_WHITE = [*range(0x09, 0x0E), *range(0x1C, 0x21)]
MAY_BEGIN, MAY_END, BEFORE_END = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
MAY_BEGIN[[*ASCII_WHITE, 0xC2, 0xE1, 0xE2, 0xE3]] = True
MAY_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
BEFORE_END[[0xC2, 0x80, 0x81, 0x9A]] = True
IS_ASCII_WHITE = np.isin(np.arange(256), ASCII_WHITE)


@dataclass
class Side:
    """The bytes of every id of a tokenizer, end to end."""

    first: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Side:
        return cls(np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int64), np.frombuffer(b"".join(tokens), np.uint8))

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.first[ids + 1] - self.first[ids]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[flat(self.first[ids], self.sizes(ids))]


class Pair:
    """The two tokenizers: A a byte-level BPE (a JSON file), B a sentencepiece model that puts a space before a text."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        # Byte-level letters: bytes that print stand for themselves, the others for 256, 257, ... in order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        entry = self.a.id_to_token
        self.sides = (
            Side.of([bytes(letter[c] for c in t) if (t := entry(i)) and all(c in letter for c in t) else (t or "").encode() for i in range(self.a.get_vocab_size())]),
            Side.of([bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(SPACE_MARK, " ").encode() for i in range(self.b.get_piece_size()) for t in [self.b.id_to_piece(i)]]),
        )
        self.ranked = self._ranked(a_path)
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        self.by_words = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)  # else a piece may reach over the end of a word

    def _ranked(self, a_path: str):
        """A as merges by rank, which is faster, where its ids are the ranks: bytes first, then the result of every merge in turn."""
        import tiktoken

        model = json.loads(Path(a_path).read_bytes())["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        side, n = self.sides[0], 256 + len(merges)
        ranks = {bytes(side.data[lo:hi]): i for i, (lo, hi) in enumerate(zip(side.first[:n].tolist(), side.first[1 : n + 1].tolist()))}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(ids, tokens of each word)`` of both sides, for words that begin with a space."""
        parts: tuple[list, list] = ([], [])
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words.slice(at, WORDS_AT_ONCE).to_pylist()
            a = [self.ranked.encode_ordinary(w) for w in some] if self.ranked else [e.ids for e in self.a.encode_batch(some, add_special_tokens=False)]
            for part, side in zip(parts, (a, self.b.encode([w[1:] for w in some], num_threads=1))):
                part.append((np.array(list(chain.from_iterable(side)), np.int64), np.array(list(map(len, side)), np.int64)))
        none = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        return [tuple(np.concatenate(x) for x in zip(*(part or none))) for part in parts]


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def word_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin in texts (with a space before each) that lie end to end: at texts, and at single spaces between other characters.

    Both tokenizers begin a token at such a space, and what they make of the bytes before it does not depend on what follows. Near
    white space beyond ASCII a word may be longer than it has to be, which changes nothing.
    """
    white = IS_ASCII_WHITE[data]
    ends = white.copy()
    ends[1:] |= MAY_END[data[1:]] & BEFORE_END[data[:-1]]
    at = np.zeros(len(data), bool)
    at[1:-1] = (data[1:-1] == 0x20) & ~ends[:-2] & ~MAY_BEGIN[data[2:]]
    at[first[1:-1] - 1] = False  # the last byte of a text has no next one
    at[first[:-1]] = True
    return np.flatnonzero(at)


@dataclass
class Aligned:
    """Distinct words end to end: ``first`` link of each, its figures, and pairs of ids (A * 2**32 + B) of the links."""

    sound: np.ndarray  # whether both tokenizers give the bytes of the word
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_shared: np.ndarray  # links within groups
    first: np.ndarray
    pairs: np.ndarray
    groups: pa.Array

    @classmethod
    def joined(cls, parts: list[Aligned]) -> Aligned:
        """Words of several parts, in turn."""
        whole = lambda name: np.concatenate([getattr(p, name) for p in parts])
        links = np.concatenate([np.diff(p.first) for p in parts])
        return cls(*[whole(n) for n in ("sound", "n_a", "n_b", "n_groups", "n_shared")], np.r_[0, np.cumsum(links)], whole("pairs"), pa.concat_arrays([p.groups for p in parts]))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _same_bytes(side: Side, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the tokens of each word give its bytes."""
    word = np.repeat(np.arange(len(counts)), counts)
    made = np.bincount(word, side.sizes(ids), minlength=len(counts)).astype(np.int64)
    same = made == sizes
    begin = np.cumsum(sizes) - sizes
    differs = side.bytes_of(ids[same[word]]) != data[flat(begin[same], sizes[same])]
    same[same] = np.bincount(np.repeat(np.arange(int(same.sum())), sizes[same]), differs, minlength=int(same.sum())) == 0
    return same


def align(words: pa.LargeStringArray, tools: Pair) -> Aligned:
    """Link the tokens of words, all in one block-diagonal product."""
    ids, n = tools.encode(words), len(words)
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1] if n else np.zeros(1, np.int64)
    data, sizes = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if n else np.zeros(0, np.uint8), np.diff(bounds)
    sound = np.ones(n, bool)
    for side, (tokens, each) in zip(tools.sides, ids):
        sound &= _same_bytes(side, tokens, each, data, sizes)
    (a, n_a), (b, n_b) = ((tokens[np.repeat(sound, each)], np.where(sound, each, 0)) for tokens, each in ids)
    bytes_a, bytes_b = Csr.stretches(tools.sides[0].sizes(a)), Csr.stretches(tools.sides[1].sizes(b))
    links = bytes_a.product(bytes_b.transpose())
    word_a = np.repeat(np.arange(n), n_a)

    closes = np.intersect1d(bytes_a.first[1:], bytes_b.first[1:], assume_unique=True)
    group_a, group_b = (np.searchsorted(closes, x.first[1:]) for x in (bytes_a, bytes_b))
    shared = Csr.members(group_a, len(closes)).product(Csr.members(group_b, len(closes)).transpose())
    per_word = lambda rows: np.bincount(word_a[rows], minlength=n).astype(np.int64)
    last = np.r_[np.flatnonzero(np.diff(group_a)), len(a) - 1] if len(a) else np.zeros(0, np.int64)  # last A token of every group

    n_groups = per_word(last)
    sides = [_joined(pa.array(x).cast(pa.large_string()), np.bincount(g, minlength=len(closes)), ",") for x, g in ((a, group_a), (b, group_b))]
    groups = _joined(pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), n_groups, ";")
    first = np.r_[0, np.cumsum(per_word(links.rows))]
    return Aligned(sound, n_a, n_b, n_groups, per_word(shared.rows), first, (a[links.rows] << 32) | b[links.columns], groups)


def _joined(parts: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
    """Runs of ``parts`` of these sizes, each joined to one string."""
    runs = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int64)), parts)
    return pc.binary_join(runs, pa.scalar(by, pa.large_string()))


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_shared_links")
BLOCK = "block long, ids array<{0}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_shared_links array<long>, groups_sha256 array<string>, sizes binary, words binary, first binary, at binary, pairs array<long>, docs array<long>"


def blocks(docs: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """A row for each block of texts: the figures of every text, its words, the links of every distinct word, and in how many texts of the block each pair of ids is linked."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, number = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.r_[0, np.cumsum(pc.fill_null(pc.add(pc.binary_length(batch.column(1)), 1), 1).to_numpy(zero_copy_only=False).astype(np.int64))]
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(sizes, sizes[row] + block_bytes, side="right")) - 1)
                texts = pc.fill_null(batch.column(1).slice(row, stop - row).cast(pa.large_string()), "")
                ahead = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))])
                first = np.frombuffer(ahead.buffers()[1], np.int64)[: len(ahead) + 1]
                yield _block(number, batch.column(0).slice(row, stop - row), np.frombuffer(ahead.buffers()[2], np.uint8), first, tools)
                number, row = number + 1, stop

    return rows.mapInArrow(run, BLOCK.format(rows.schema["id"].dataType.simpleString()))


def _block(number: int, ids: pa.Array, data: np.ndarray, first: np.ndarray, tools: Pair) -> pa.RecordBatch:
    starts = word_starts(data, first) if tools.by_words else first[:-1]
    bounds = np.r_[starts, first[-1]].astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    code, sizes = found.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(starts, first))
    out = Aligned.joined([align(found.dictionary.slice(i, ALIGNED_AT_ONCE), tools) for i in range(0, len(found.dictionary), ALIGNED_AT_ONCE)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    good = (np.bincount(text, ~out.sound[code], minlength=len(sizes)) == 0) & (np.diff(first) > 1)  # more than the space before it
    code, text, sizes = code[good[text]], text[good[text]], np.where(good, sizes, 0)

    n_links = np.diff(out.first)
    total = lambda per_word: np.bincount(text, per_word[code], minlength=len(sizes)).astype(np.int64)
    figures = dict(zip(FIGURES, map(total, (out.n_a, out.n_b, out.n_groups, n_links, out.n_shared))))
    names = _joined(out.groups.take(pa.array(code)), sizes, ";")
    shas = [hashlib.sha256(x.as_buffer()).hexdigest() if n else "" for x, n in zip(names, sizes.tolist())]

    pairs, at = np.unique(out.pairs, return_inverse=True)
    both = _distinct(text * max(1, len(n_links)) + code)
    holder, word = np.divmod(both, max(1, len(n_links)))
    held = _distinct(np.repeat(holder, n_links[word]) * max(1, len(pairs)) + at[flat(out.first[word], n_links[word])])
    docs = np.bincount(held % max(1, len(pairs)), minlength=len(pairs))
    some = np.flatnonzero(docs)  # pairs of texts without tokens are in no document
    listed = {"ids": ids} | {k: pa.array(v) for k, v in figures.items()} | {"groups_sha256": pa.array(shas, pa.string()), "pairs": pa.array(pairs[some]), "docs": pa.array(docs[some])}
    place = np.zeros(max(1, len(pairs)), np.int64)
    place[some] = np.arange(len(some))
    single = {"block": pa.array([number]), "sizes": pa.array([pack(sizes)]), "words": pa.array([pack(code)]), "first": pa.array([pack(out.first)]), "at": pa.array([pack(place[at])])}
    columns = single | {k: pa.ListArray.from_arrays([0, len(v)], v) for k, v in listed.items()}
    order = [f.split(" ")[0] for f in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([columns[k] for k in order], order)


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] = PATHS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(texts, pairs)``: a row for each row of ``docs`` with its figures, and the pairs of ids that are linked in some document.

    ``texts``: ``id, n_a, n_b, n_groups, n_links, n_shared_links, n_best, count_sum, groups_sha256``; ``pairs``: ``a, b, docs, best`` (``best``:
    no pair of this A id is linked in more documents). Texts that are null, empty, or not given back byte for byte by both tokenizers have no tokens and
    zeros; null ids and repeated rows are rows of their own; other columns are not read; an empty table gives empty results.

    ``paths``: files of A and B, which every executor must have. A block sends each of its pairs once to be counted and gets each back once, so no
    text is shuffled as links; a pair that all documents hold is one row a block.
    """
    a_path, b_path = paths
    parts = durable(blocks(docs, id_col, text_col, a_path, b_path, block_bytes), "token-blocks")
    each = parts.select(F.col("block").alias("of"), F.inline(F.arrays_zip("pairs", "docs"))).withColumnRenamed("pairs", "pair")
    counted = each.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32))
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    counted = durable(counted.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "token-pairs")
    sent = each.select("of", "pair").join(counted, "pair")
    kind = parts.schema["ids"].dataType.elementType.simpleString()
    fields = f"id {kind}, " + ", ".join(f"{f} long" for f in (*FIGURES, "n_best", "count_sum")) + ", groups_sha256 string"
    texts = sent.groupBy("of").cogroup(parts.drop("pairs", "docs").groupBy("block")).applyInArrow(_finish, fields)
    return texts, counted.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "docs", "best")


def _finish(sent: pa.Table, part: pa.Table) -> pa.Table:
    """The figures of a block's texts, with the counts of its pairs."""
    row = {k: part.column(k)[0] for k in part.column_names}
    pair = sent.column("pair").to_numpy()
    order = np.argsort(pair)
    docs, best = sent.column("docs").to_numpy()[order], sent.column("best").to_numpy()[order].astype(np.int64)
    sizes, code, first, at = (unpack(row[k].as_py()).astype(np.int64) for k in ("sizes", "words", "first", "at"))

    def total(values: np.ndarray) -> np.ndarray:
        running = np.r_[0, np.cumsum(values[at])] if len(values) else np.zeros(len(at) + 1, np.int64)  # whole numbers, whatever their size
        upto = np.r_[0, np.cumsum((running[first[1:]] - running[first[:-1]])[code])]
        ends = np.cumsum(sizes)
        return upto[ends] - upto[ends - sizes]

    columns = {"id": row["ids"].values} | {f: row[f].values for f in FIGURES} | {"n_best": pa.array(total(best)), "count_sum": pa.array(total(docs)), "groups_sha256": row["groups_sha256"].values}
    return pa.table(columns)
