"""Packing token sequences: shortest pack first over the length histogram.

Documents are cut at every `size` tokens. Whole pieces are sequences of their
own; the rest are packed by length alone. Lengths are placed longest first, as
many documents of a length as can be at a time: into the kind of pack that is
shortest so far and has room, else into new packs. What comes out is a bounded
list of packing patterns with counts. Every piece has a rank among those of its
length, and joins the pattern, copy and place which that rank falls in.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, Rolling, byte_set, ragged, short_batches, shuffle_partitions, texts, written

SIZE = 1024
#: White space beyond ASCII and odd ASCII separators, in UTF-8; texts with these are tokenized whole.
ODD_SPACE = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80"
ODD_SPACE_BYTES = b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3"  # with which these begin
#: Distinct pieces of text whose ids a task keeps, at most 8 ids for each on average; beyond it the store starts anew.
STORE = 800_000
#: New pieces that are tokenized as one text.
JOINED = 1000
#: ASCII letters, digits and signs: 1, 2 and 3; white space, control and other bytes: 0.
KIND = byte_set([(0x41, 0x5A), (0x61, 0x7A)]) + 2 * byte_set([(0x30, 0x39)]) + 3 * byte_set([(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])
KIND = KIND.astype(np.uint8)
#: As KIND for the byte before a cut: an apostrophe may belong to the letters after it ('s, 'll).
KIND_BEFORE = np.where(np.arange(256) == ord("'"), 0, KIND).astype(np.uint8)


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a pack, packs)]: shortest pack first, lengths longest first.

    Of the packs with room the shortest take the next length; packs split into those that took it and
    those that did not. The number of patterns is bounded by twice the number of lengths, whatever the counts.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # by free room: [pattern, packs]
    done: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs and r >= length), default=None)
            if room is None:
                each = size // length
                full, rest = divmod(left, each)
                # New packs: at once as many of this length as fit one pack, so that hot lengths make few patterns.
                for take, packs in ((each, full), (rest, 1 if rest else 0)):
                    if packs:
                        open_packs[size - take * length].append([(length,) * take, packs])
                left = 0
                continue
            pattern, packs = open_packs[room].pop()
            took = min(packs, left)
            if took < packs:
                open_packs[room].append([pattern, packs - took])
            open_packs[room - length].append([(*pattern, length), took])
            left -= took
        done += [(tuple(p), n) for p, n in open_packs.pop(0, [])]
    done += [(tuple(p), n) for packs in open_packs.values() for p, n in packs]
    return done


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the ranks of each length go."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, packs in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + packs, sequence, offset))
            used[length] += packs
            offset += length
        sequence += packs
    return out


class Pieces:
    """Token ids of texts. Byte-level BPE with GPT-2's pattern never joins across the start of a run of white space, nor across a
    change between ASCII letters, digits and signs (but after an apostrophe), so texts are cut there and ids are looked up by what
    lies between, each distinct piece tokenized once. Texts with an added token of the tokenizer, which is matched anywhere in a
    text, and with other white space than spaces, tabs and line breaks are tokenized whole, and so are all texts of tokenizers
    of another kind."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.roll, self.tokenizer = Rolling(9), Tokenizer.from_file(tokenizer)
        made = json.load(open(tokenizer, "rb"))
        split = made["pre_tokenizer"] or {}
        known = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        known = known and made["model"]["type"] == "BPE" and not any(made.get(k) for k in ("normalizer", "truncation", "padding"))
        known = known and not any(made["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = [t["content"].encode() for t in made["added_tokens"]]
        # Every byte has a token, and no added token can arise where pieces follow one another.
        known = known and sum(len(t) == 1 for t in vocabulary) >= 256 and not any(re.search(rb"\S\s", t) for t in added)
        self.odd = re.compile(b"|".join([ODD_SPACE, *map(re.escape, added)]) if known else b"")
        self.may_be_odd = np.full(256, not known)
        self.may_be_odd[[*ODD_SPACE_BYTES, *(t[0] for t in added)]] = True
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token; its name has a character for each
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, units: list[bytes], alone: np.ndarray) -> None:
        """Keeps the ids of new units, by ascending keys. Those from white space to a word's end, not `alone`, can follow one
        another in one text, which saves a call for each; how many ids are whose shows by the tokens' bytes."""
        order = np.argsort(alone, kind="stable")
        units, joined = [units[i] for i in order.tolist()], len(units) - int(alone.sum())
        cuts = [*range(0, joined, JOINED), *range(joined, len(units) + 1)]
        got = self.tokenizer.encode_batch_fast([b"".join(units[a:b]).decode() for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
        ends, wanted = np.cumsum(self.width[ids]), np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        upto = np.searchsorted(ends, wanted, "right")
        if (ends[upto - 1] != wanted).any():
            raise ValueError("the tokenizer joins text across the cuts between words")
        at, size = np.zeros((2, len(units)), np.int32)
        size[order] = np.diff(upto, prepend=0)
        at[order] = len(self.ids) + np.concatenate([[0], upto[:-1]])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.ids = np.concatenate([self.ids, ids])

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """The ids of rows that have to be tokenized whole."""
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(self.may_be_odd[data]), "right") - 1)
        odd, raw = {}, data.tobytes() if len(rows) else b""
        for i, a, b in zip(rows.tolist(), offsets[rows].tolist(), offsets[rows + 1].tolist()):
            if self.odd.search(raw, a, b):
                odd[i] = np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)
        return odd

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids up to each row's end from 0) for rows of ordinary white space."""
        inside, after = NOT_SPACE[data], KIND[data]
        start = np.zeros(len(data), bool)
        before = KIND_BEFORE[data[:-1]]
        start[1:] = ~inside[1:] & inside[:-1] | (before != after[1:]) & (before > 0) & (after[1:] > 0)
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        first = np.flatnonzero(start)
        last = np.append(first[1:], len(data)) if len(first) else first
        keys = self.roll.of_words(data, first, last)
        distinct, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > STORE or len(self.ids) > 8 * STORE:
            self.clear()
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)] != distinct
        if new.any():
            raw, pick = data.tobytes(), where[new]
            units = [raw[a:b] for a, b in zip(first[pick].tolist(), last[pick].tolist())]
            self.learn(distinct[new], units, inside[first[pick]] | ~inside[last[pick] - 1])
        place = np.searchsorted(self.keys, distinct)[inverse]
        size = self.size[place]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.ids[ragged(self.at[place], size)], upto[np.searchsorted(first, offsets)]

    def of_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        odd, size = self.whole(data, offsets), np.diff(offsets)
        if odd:
            ordinary = np.ones(len(size), bool)
            ordinary[list(odd)] = False
            data, offsets = data[np.repeat(ordinary, size)], np.concatenate([[0], np.cumsum(size * ordinary)])
        found, upto = self.encode(data, offsets)
        return [odd[i] if i in odd else found[upto[i] : upto[i + 1]] for i in range(len(size))]


def pieces_of(tokenizer: str) -> Pieces:
    """One store for all tasks that a Python worker runs one after the other. Functions travel to it by value, so the store
    is kept among the worker's modules."""
    kept = sys.modules.setdefault("flowloom_pieces", types.ModuleType("flowloom_pieces"))
    if getattr(kept, "tokenizer", None) != tokenizer:
        kept.tokenizer, kept.pieces = tokenizer, Pieces(tokenizer)
    return kept.pieces


def tokenized_pieces(documents: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids by the tokenizers file and end_id, cut at
    each `size` ids."""
    short_batches(documents.sparkSession)
    id_type = documents.schema[id_col].dataType.simpleString()

    def scan(batches):
        pieces = pieces_of(tokenizer)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in texts(column, 1 << 20):
                rows = []
                for i, own in enumerate(pieces.of_rows(data, offsets)):
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    raw = own.tobytes()
                    rows += [(i, at, min(size, len(own) - at), zlib.crc32(raw[4 * at : 4 * (at + size)]), len(own)) for at in range(0, len(own), size)]
                table = np.array(rows, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(table[0])), *map(pa.array, table[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces (doc_id, start, length, ...) with sequence_id and offset: gapless within a sequence.

    Ranks are counted in shares of the pieces and then across shares, so a length that most pieces have
    is dealt to as many tasks as there are shares. No pieces: no rows.
    """
    spark = pieces.sparkSession
    shares = 8 * shuffle_partitions(spark)
    pieces = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shares)).cast("int"))
    counted = written(pieces.groupBy("length", "share").agg(F.count("*").alias("n")), "pack-counts")
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    whole = histogram.pop(size, 0)
    places = [(size, 0, whole, 0, 0)] + [(a, b, c, d + whole, e) for a, b, c, d, e in slots(pack_histogram(histogram, size))]
    rank = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(bases, ["length", "share"]).withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.drop("share", "base")
    # Patterns are bounded by the lengths, so there are a few thousand places at any input.
    table = np.array(sorted(places), np.int64).reshape(-1, 5)
    keys = table[:, 0] * (1 << 50) + table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 50) + rank, "right") - 1
            sequence, offset = table[at, 3] + rank - table[at, 1], table[at, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offset), pa.array(sequence)], [*batch.schema.names, "offset", "sequence_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(place, f"{schema}, offset long, sequence_id long").drop("rank")


def packed(documents: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are documents of their own.
    A sequence shorter than `size` is to be padded.
    """
    cut = written(tokenized_pieces(documents, tokenizer, size, end_id, id_col, text_col), "pieces")
    return pack(cut, size).select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
