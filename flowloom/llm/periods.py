"""Runs: maximal stretches of words that repeat with a period, found exactly by recompression.

The words of many texts, with a letter of its own between any two, are one string. Its levels come from turns of block
compression (equal neighbours become one letter for letter and count) and pair compression (letters are dealt to two sides,
and each pair of a left letter and a right one becomes one letter), which give equal stretches equal letters but for a letter at
either end of each level. The levels with their letters' first children are a run-length grammar of the string.

How far two places agree (LCE) is read off the grammar: both climb while their letters' parents agree, each level settling at most
one letter by comparison, then descend past at most two equal letters a level. This works in either direction and for
many pairs of places at once.

A run of period q and length 2q at least holds a multiple i of q with i + q inside it too, so the pairs (jq, jq + q) of every q (the
harmonic grid, n ln n pairs) meet every run; those of equal words are extended both ways.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, ragged

LEAST = 12
#: Words of a batch of texts, and places of the grid that are compared at once; a longer text is a batch of its own.
BATCH_WORDS, GRID = 200_000, 1 << 20


class Grammar:
    """levels[h]: (letters, parents of the letters, first letter of each parent, whether parents are blocks); top: the last letters."""

    def __init__(self, letters: np.ndarray, least: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        self.next, idle, turn = int(letters.max(initial=0)) + 1, 0, 0
        while len(letters) > least and idle < 8:
            parent = self.pairs(letters, turn) if turn % 2 else self.blocks(letters)
            idle = idle + 1 if parent is None else 0
            letters, turn = letters if parent is None else parent, turn + 1
        self.top = letters

    def level(self, letters: np.ndarray, start: np.ndarray, block: bool) -> np.ndarray:
        first = np.flatnonzero(start)
        self.levels.append((letters, (np.cumsum(start) - 1).astype(np.int32), np.append(first, len(letters)).astype(np.int32), block))
        return first

    def named(self, keys: np.ndarray) -> np.ndarray:
        """A new letter for each distinct key."""
        distinct, at = np.unique(keys, return_inverse=True)
        self.next += len(distinct)
        return at + (self.next - len(distinct))

    def blocks(self, letters: np.ndarray) -> np.ndarray | None:
        start = np.ones(len(letters), bool)
        start[1:] = letters[1:] != letters[:-1]
        if start.all():
            return None
        first = self.level(letters, start, True)
        length = np.diff(first, append=len(letters))
        out, many = letters[first], length > 1
        out[many] = self.named(out[many] * (len(letters) + 1) + length[many])
        return out

    def pairs(self, letters: np.ndarray, turn: int) -> np.ndarray | None:
        left = (mix(letters.astype(U64) + U64(turn << 40)) & U64(1)).astype(bool)
        one, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        pair = one if one.sum() >= other.sum() else other
        if not pair.any():
            return None
        start = np.ones(len(letters), bool)
        start[1:] = ~pair
        first = self.level(letters, start, False)
        out, two = letters[first], np.diff(first, append=len(letters)) > 1
        out[two] = self.named(out[two] * self.next + letters[first[two] + 1])
        return out

    def agree(self, p: np.ndarray, q: np.ndarray, d: int) -> np.ndarray:
        """For how many letters the string agrees from p[i] and q[i] on, forwards (d = 1) or backwards (d = -1).
        p[i] and q[i] differ, and the string begins and ends with letters that stand nowhere else."""
        begun, out = p, np.zeros(len(p), np.int64)
        rows = np.arange(len(p))
        left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rest(first, parent, at):
            """Letters from here to the end of the parent, in this direction; whether they are all of it."""
            lo, hi = first[parent], first[parent + 1]
            return (hi - at, at == lo) if d > 0 else (at - lo + 1, at == hi - 1)

        for h, (letters, up, first, _) in enumerate(self.levels):
            above = self.levels[h + 1][0] if h + 1 < len(self.levels) else self.top
            up_p, up_q = up[p], up[q]
            (rest_p, whole_p), (rest_q, whole_q) = rest(first, up_p, p), rest(first, up_q, q)
            whole = whole_p & whole_q
            equal = ~whole & (letters[p] == letters[q])
            climb, step = whole & (above[up_p] == above[up_q]), equal & (rest_p == rest_q)
            go = d * np.where(equal, np.minimum(rest_p, rest_q), 0)
            p, q = p + go, q + go
            stay, on = ~(climb | step), climb | step
            left.append((rows[stay], p[stay], q[stay]))
            rows, p, q = rows[on], up[p[on]], up[q[on]]
        letters = self.top
        while (equal := letters[p] == letters[q]).any():
            p, q = p + d * equal, q + d * equal
        for (letters, up, first, block), (more, p_, q_) in zip(reversed(self.levels), reversed(left)):
            rows = np.concatenate([rows, more])
            p, q = (np.concatenate([first[x] if d > 0 else first[x + 1] - 1, y]) for x, y in ((p, p_), (q, q_)))
            some = np.flatnonzero(letters[p] == letters[q])
            while len(some):
                a, b = p[some], q[some]
                go = d * (np.minimum(rest(first, up[a], a)[0], rest(first, up[b], b)[0]) if block else 1)
                p[some], q[some] = a + go, b + go
                some = some[letters[p[some]] == letters[q[some]]]
        out[rows] = np.abs(p - begun[rows])
        return out


def grid(size: np.ndarray, first: np.ndarray, limit: int = GRID) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the harmonic grids of texts of `size` letters that begin at `first`."""
    most = size // 2
    text, period = np.repeat(np.arange(len(size)), most), 1 + ragged(np.zeros(len(size)), most)
    each = (size[text] - 1) // period
    done = np.concatenate([[0], np.cumsum(each)])
    lo = 0
    while lo < len(each):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + limit, "right")) - 1)
        n, q = each[lo:hi], np.repeat(period[lo:hi], each[lo:hi])
        t = np.repeat(text[lo:hi], n)
        yield t, first[t] + ragged(np.zeros(hi - lo), n) * q, q
        lo = hi


def runs(codes: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Of each text, given as numbers of its words: (start, length, smallest period) of all runs of max(least, 2 * period) words
    or more, by start and period."""
    size = np.array([len(c) for c in codes], np.int64)
    if not len(size) or size.max() < max(least, 2):
        return [np.zeros((0, 3), np.int64)] * len(size)
    base = max((int(c.max(initial=0)) for c in codes)) + 1
    first = np.cumsum(size + 1) - size  # a separator stands before each text and one after the last
    letters = np.empty(int(size.sum()) + len(size) + 1, np.int64)
    letters[np.append(first - 1, len(letters) - 1)] = base + np.arange(len(size) + 1)
    for at, c in zip(first, codes):
        letters[at : at + len(c)] = c
    grammar = Grammar(letters, 4 * len(size) + 4)
    found = []
    for text, place, q in grid(np.where(size >= least, size, 0), first):
        same = np.flatnonzero(letters[place] == letters[place + q])
        text, place, q = text[same], place[same], q[same]
        # A run longer than its first two periods' worth agrees beside the place, too, if more than one word has to.
        near = (letters[place + 1] == letters[place + q + 1]) | (letters[place - 1] == letters[place + q - 1])
        text, place, q = text[near], place[near], q[near]
        ahead, behind = grammar.agree(place, place + q, 1), grammar.agree(place - 1, place + q - 1, -1)
        length = q + ahead + behind
        fits = length >= np.maximum(least, 2 * q)
        found.append(np.stack([text[fits], (place - behind)[fits] - first[text[fits]], length[fits], q[fits]], 1))
    all_ = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
    # Of equal stretches the smallest period: unique() has sorted by text, start, length, period.
    new = np.ones(len(all_), bool)
    new[1:] = (all_[1:, :3] != all_[:-1, :3]).any(1)
    all_ = all_[new]
    all_ = all_[np.lexsort((all_[:, 3], all_[:, 1], all_[:, 0]))]
    cuts = np.searchsorted(all_[:, 0], np.arange(len(size) + 1))
    return [all_[lo:hi, 1:] for lo, hi in zip(cuts, cuts[1:])]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not len(found):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(depth)[:-1] == 0).tolist()))


SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id_col, n_words, runs, collapsed) of every row: its runs by start, then period, and the text without their repeats.

    Words are [^\\x20\\x09-\\x0D]+; positions count words from 0. A run has its smallest period q, at least max(least, 2q)
    words, and no neighbour that would go on with q. Null and empty texts, and shorter ones than `least` words, have no runs. `least`
    is 3 or more. A text is worked on by one task, in memory of some hundred bytes a word.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, lo = b.column("__text").cast(pa.binary()), 0
            while lo < len(b):
                ids: dict[bytes, int] = {}
                number = lambda w, ids=ids: ids.setdefault(w, len(ids))
                words, codes, total = [], [], 0
                while lo + len(words) < len(b) and (not words or total < BATCH_WORDS):
                    own = column[lo + len(words)].as_py().split()  # at the bytes 09-0D and 20
                    words.append(own)
                    codes.append(np.fromiter(map(number, own), np.int64, len(own)))
                    total += len(own)
                each = runs(codes, least)
                cuts = np.cumsum([0, *map(len, each)]).astype(np.int32)
                flat = np.concatenate(each)
                parts = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col).slice(lo, len(words)), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), parts), pa.array(list(map(collapsed, words, each)), pa.binary()).cast(pa.string())],
                    [id_col, "n_words", "runs", "collapsed"])
                lo += len(words)

    return rows.mapInArrow(scan, f"`{id_col}` {kind}, {SCHEMA}")


def with_planted_periods(df: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32 of the decimal doc_id and g = h div 10, texts of h % 10 = 0 become periodic from word g % n on, with
    period 1 + (n - a) div (3 + g % 8). Without an id a text stays as it is."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = df.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.element_at("w", (1 + F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_periods(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS s, -r.period AS p)))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.selectExpr("doc_id", "n_runs", "-b.s AS start", "b.length AS length", "-b.p AS period", "(1000 * b.length) div (-b.p) AS exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")
