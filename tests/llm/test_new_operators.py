"""Runs, clusters and languages against plain twins, on the small tables and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import clusters, language, periods
from flowloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# 11


def plain_runs(w, least=12):
    found = {}
    for q in range(len(w) // 2, 0, -1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found[s, i + q] = q
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def strings():
    rng = np.random.default_rng(5)
    yield from ([], [0], [0] * 11, [0] * 12, [0] * 400, [0, 1] * 6, [0, 1] * 6 + [0], [0, 0, 1] * 50, list(range(6)) * 2, list(range(5)) * 2, list(range(300)) * 2 + [7], [0] * 30 + [1] + [0] * 30)
    thue = [i.bit_count() % 2 for i in range(512)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    yield from (thue, fib[-1], [i.bit_count() for i in range(400)])
    for n in (13, 40, 150, 700):
        for letters in (1, 2, 3, 9):
            yield rng.integers(0, letters, n).tolist()
            base = rng.integers(0, letters + 3, n // 3 + 1).tolist()
            noisy = (base * 5)[:n]
            noisy[n // 2] = 99
            yield noisy
            yield (base * 5)[:n]


def test_runs_of_strings():
    every = list(strings())
    for some in (every, every[::-1], *([x] for x in every)):
        found = periods.runs([np.array(x, np.int64) for x in some])
        assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(x) for x in some]


def test_grammar_agreement_is_exact():
    rng = np.random.default_rng(8)
    for letters in (1, 2, 5):
        inner = rng.integers(0, letters, 500)
        inner[250:400] = inner[50:200]
        s = np.concatenate([[97], inner, [98]])
        g = periods.Grammar(s, 4)
        assert len(g.top) < 60
        p, q = np.triu_indices(len(s), 1)
        pick = rng.integers(0, len(p), 3000)
        p, q = p[pick], q[pick]
        for d in (1, -1):
            for a, b, n in zip(p, q, g.agree(p, q, d)):
                m = 0
                while s[a + d * m] == s[b + d * m]:
                    m += 1
                assert m == n


def test_grid_in_small_steps(monkeypatch):
    size, first = np.array([0, 30, 0, 7, 100]), np.array([1, 2, 33, 34, 42])
    whole = [np.concatenate(x).tolist() for x in zip(*periods.grid(size, first))]
    assert whole == [np.concatenate(x).tolist() for x in zip(*periods.grid(size, first, 5))]
    assert sorted(zip(*whole)) == sorted((t, first[t] + i, q) for t, n in enumerate(size) for q in range(1, n // 2 + 1) for i in range(0, n - q, q))


@pytest.mark.parametrize("which", ["documents", "edges", "nothing"])
def test_runs_query(which, request, pairs, spark, tmp_path):
    df = request.getfixturevalue(which).withColumn("n", F.lit(1)).withColumn("h", F.lit(2))
    df = df.filter("n_chars IS NULL OR n_chars < 12000")  # of what the plain twin can do
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = pairs(QUERIES["op11_runs"](spark, str(tmp_path)), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    wanted, sha = [], lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d, text in pairs(df, "doc_id", "text"):
        w = WORD.findall(text or "")
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        wanted.append((d, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_collapsed(w, runs))))
    assert sorted(found) == sorted(wanted)


def test_runs_of_a_very_long_text(spark):
    text = "a b c " * 30_000 + " ".join(map(str, range(20_000)))
    row = periods.periodic_runs(spark.createDataFrame([(None, text)], "doc_id long, text string")).first()
    assert row.doc_id is None and row.n_words == 110_000 and [tuple(r) for r in row.runs] == [(0, 90_000, 3)]
    assert row.collapsed == "a b c " + " ".join(map(str, range(20_000)))


# 12


def plain_clusters(rows, k, rounds):
    """rows: (vec_id, v) of whole numbers."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for i in range(len(centroids)):
            if mine := [v for (_, v), o in zip(rows, own) if o == i]:
                centroids[i] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(r, *nearest(v)[::-1]) for r, v in rows]
    sums = Counter()
    for _, c, d in out:
        sums[c] += d
    return [(r, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for r, c, d in out]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
by_text = lambda rows: sorted(rows, key=str)


def vectors(spark, rows, dim):
    return clusters.kept_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, cluster int, key int"), dim=dim)


def test_clusters_of_all_vectors(spark, sf_dir, pairs):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in pairs(df, "vec_id", "embedding")]
    assert by_text(pairs(QUERIES["op12_clusters"](spark, sf_dir), *COLUMNS)) == by_text(plain_clusters(rows, 8, 10))


@pytest.mark.parametrize("k", [1, 3, 50])
def test_clusters_of_awkward_vectors(spark, pairs, k):
    rng = np.random.default_rng(k)
    fine = [(int(i), [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in rng.integers(0, 30, 40)] + [(7, [0.5] * 4)] * 9 + [(None, [1.0, -1.0, 0.25, 0.0]), (-4, [-60000.0, 3.0, 0.0, 60000.0])]
    odd = [(90, None), (91, []), (92, [1.0] * 3), (93, [1.0] * 5), (94, [1.0, None, 1.0, 1.0]), (95, [math.nan] * 4), (96, [math.inf, 0.0, 0.0, 0.0]), (97, [1e30] * 4)]
    df = vectors(spark, [(*r, 1, 2, 3) for r in fine + odd], 4)
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in fine]
    assert by_text(pairs(clusters.report(df, k, 6), *COLUMNS)) == by_text(plain_clusters(rows, k, 6))


def test_clusters_of_nothing(spark):
    df = clusters.report(vectors(spark, [(1, [1.0], 1, 2, 3)], 4), 8, 10)
    assert df.count() == 0 and df.columns == COLUMNS


def test_only_expired_vectors_are_compared_again(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 1, (5, 8))
    rows = [(i, [float(x) for x in middle[i % 5] + rng.normal(0, 0.05, 8)], 1, 2, 3) for i in range(1000)]
    df = vectors(spark, rows, 8)
    found, _, scans = clusters.clustered(df, clusters.first_centroids(df, 5), 10)
    assert scans[0] == 1000 and sum(scans[1:]) < 2500 and found.count() == 1000
    plan = clusters.between(df.withColumn("cluster", F.lit(0)).withColumn("key", F.lit(0.5)), np.zeros(5), np.ones(5))
    assert plan.count() == 1000 and clusters.between(df.withColumn("cluster", F.lit(0)).withColumn("key", F.lit(1.0)), np.zeros(5), np.ones(5)).count() == 0


# 13


def plain_lengths(train, texts, order):
    """Of each text, code lengths by language, from plain dictionaries."""
    fold = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    trees = {}
    for lang, text in train:
        tree = trees.setdefault(lang, defaultdict(Counter))
        data = b"\n" * order + fold(text)
        for i in range(order, len(data)):
            for k in range(order + 1):
                tree[data[i - k : i]][data[i]] += 1
    bits = lambda p: round(-math.log2(p) * language.UNIT)
    out = []
    for text in texts:
        data, row = b"\n" * order + fold(text), {}
        for lang, tree in trees.items():
            row[lang] = 0
            for i in range(order, len(data)):
                for k in range(order, -1, -1):
                    seen = tree.get(data[i - k : i])
                    if seen:
                        whole = seen.total() + len(seen)
                        if data[i] in seen:
                            row[lang] += bits(seen[data[i]] / whole)
                            break
                        row[lang] += bits(len(seen) / whole)
                else:
                    row[lang] += 8 * language.UNIT
        out.append(row)
    return out


@pytest.mark.parametrize("order", [0, 2, 3, 5])
def test_code_lengths_are_those_of_plain_trees(spark, order):
    train = [("en", "the cat and the hat"), ("en", ""), ("de", "der Hut und die Katze"), ("fr", "été à la plage"), ("zz", "x")]
    texts = ["the hat", "T", "", "die Katze \x00 und", "été", "東京 x", "the cat and the hat " * 40]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train)], "doc_id long, text string, lang string")
    model = language.learned(docs, order=order)
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    wanted = [[row[x] for x in model.languages] for row in plain_lengths(train, texts, order)]
    for piece in (1 << 20, 7):
        assert model.code_lengths(np.frombuffer(b"".join(data), np.uint8), offsets, piece).tolist() == wanted


def test_languages_of_held_out_documents(spark, sf_dir, documents, pairs):
    found = QUERIES["op13_language"](spark, sf_dir).join(documents.select("doc_id", "lang", "text"), "doc_id")
    rows = pairs(found, "doc_id", "held_out", "lang_pred", "score", "lang", "text")
    assert len(rows) == documents.count()
    for d, held, pred, score, _, text in rows:
        assert held == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= score <= 1
        assert (pred == "und") == (not any(c.isalpha() for c in text or ""))
    right = [pred == lang for _, held, pred, _, lang, _ in rows if held]
    assert np.mean(right) > 0.95


def test_language_of_awkward_rows(spark, documents, edges, nothing, pairs):
    model = language.learned(documents)
    found = pairs(language.predicted(edges, model), "doc_id", "lang_pred", "score", "bits")
    assert len(found) == edges.count()
    assert {d for d, x, *_ in found if x == "und"} == {1, 2, 6} and all(s == 0 and b is None for _, x, s, b in found if x == "und")
    assert language.predicted(nothing, model).count() == 0 and language.learned(nothing) is None
    assert {r.lang_pred for r in language.predicted(edges, None).collect()} == {"und"}
    assert language.learned(edges.withColumn("lang", F.lit(None).cast("string"))) is None


def test_language_never_learns_from_what_is_held_out(spark, documents):
    """Other languages and texts of held-out rows change no prediction."""
    third = language.third() == 1
    spoiled = documents.withColumns({"lang": F.when(third, "xx").otherwise(F.col("lang")), "text": F.when(third, "zzz").otherwise(F.col("text"))})
    a, b = (language.learned(df, ~third) for df in (documents, spoiled))
    assert a.languages == b.languages and (a.seen == b.seen).all() and all((x == y).all() for x, y in zip(a.cost, b.cost))


def test_language_sample_is_bounded(spark, documents):
    rows = documents.select(F.col("doc_id").alias("id"), "lang", "text")
    held = language.sampled(rows, 80_000, 3).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert len(held) == 3 and all(5_000 < r.n <= 80_000 / 3 for r in held)
    assert language.sampled(rows.filter("doc_id = 5"), 1, 256).count() == 1


# Mended: hashes, archives, decontamination


def thue_morse(n, flip=0):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_word_hashes_have_no_certain_collisions():
    from flowloom.llm.common import LONG, Rolling

    rng = np.random.default_rng(0)
    strings = {thue_morse(n, f) for n in (64, 256, 257, 1024, 2048, 4096) for f in (0, 1)}
    strings |= {"", "a", "aa", "b", "a\0", "\0", "\0\0"} | {"x" * n for n in range(1, LONG + 20)} | {"".join(rng.choice(list("ab"), n)) for n in range(1, 40) for _ in range(20)}
    strings = sorted(strings)
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    end = np.cumsum([len(s) for s in strings])
    for seed in (3, 5, 9, 13):
        h = Rolling(seed).of_words(data, end - [len(s) for s in strings], end)
        assert len(set(h.tolist())) == len(strings)
        again = Rolling(seed).of_words(np.concatenate([data[5:], data]), end + len(data) - 5 - [len(s) for s in strings], end + len(data) - 5)
        assert (h == again).all()


def test_colliding_words_are_told_apart(spark, pairs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from flowloom.llm import decontaminate, lm, packing, similar

    long = [thue_morse(n, f) for n in (1024, 2048, 4096) for f in (0, 1)]
    rows = [(i, f"{w} end of {w}") for i, w in enumerate(long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = Tokenizer.from_file(path)
    got = {d: n for d, n in pairs(packing.tokenized_pieces(df, path).select("doc_id", "doc_tokens").distinct(), "doc_id", "doc_tokens")}
    assert got == {d: len(ids.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows}
    items = spark.createDataFrame([(0, long[0])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(df, items).filter("contaminated").collect()} == {0}
    kept = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 10]
    known = {r.doc_id: r.n_known for r in lm.scored(df).collect()}
    assert known == {d: 5 if d in kept else 3 for d, _ in rows}
    assert similar.one_of_each(df).count() == len(rows)


@pytest.mark.parametrize(("target", "cells"), [(1, 1 << 16), (40_000, 64)])
def test_archive_ranges_of_any_ids(spark, target, cells):
    from flowloom.llm import warc

    tables = {
        "hashes": spark.range(20_000).select(F.xxhash64("id").alias("k")),
        "ends": spark.range(1000).select(F.when(F.col("id") == 0, -(2**63)).when(F.col("id") == 1, 2**63 - 1).otherwise(F.col("id") - 500).alias("k")),
        "even": spark.range(20_000).select((F.col("id") * 7).alias("k")),
        "one": spark.range(50).select(F.lit(5).cast("long").alias("k")),
        "null": spark.range(5).select(F.lit(None).cast("long").alias("k")),
    }
    for df in tables.values():
        sizes = df.select("k", F.lit(10).cast("long").alias("n"))
        keys = sorted(r.k for r in df.collect() if r.k is not None)
        sums = sorted(Counter(keys).items())
        cuts = warc.exact_cuts(sizes, "k", "n", target, cells)
        assert cuts == sorted(set(cuts)) and set(cuts) <= set(keys[1:])
        edges = np.searchsorted(cuts, [k for k, _ in sums], "right")
        held, single = Counter(), Counter()
        for (_, n), e in zip(sums, edges):
            held[int(e)] += 10 * n
            single[int(e)] += 1
        assert all(n <= target or single[e] == 1 for e, n in held.items())


def test_archive_of_hashed_ids(spark, tmp_path):
    from flowloom.llm import warc

    pages = spark.range(300).select(F.xxhash64("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(F.lit("x"), (F.col("id") % 50).cast("string")).alias("html"))
    warc.write_archive(pages, f"file://{tmp_path}/w", range_bytes=20_000)
    found = warc.read_archive(spark, f"file://{tmp_path}/w")
    assert found.count() == 300 and found.filter("record_type = 'response'").count() == 50


def test_decontaminate_repeated_words(spark):
    """Long stretches of one word, in documents and items alike, cost as many rows as words."""
    import time

    from flowloom.llm import decontaminate

    docs = spark.createDataFrame([(1, "0 " * 20_000), (2, "0 1 " * 5000), (3, "0 " * 9), (4, "a " * 30 + "0 " * 25 + "b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "0 " * 10_000), (8, "1 0 " * 3000), (9, "0 0 0")], "item_id long, text string")
    began = time.time()
    found = {r.doc_id: r for r in decontaminate.contaminated(docs, items).collect()}
    assert time.time() - began < 30
    assert [(found[d].n_words, found[d].n_hit, found[d].longest, found[d].longest_at, found[d].items) for d in (1, 2, 3, 4)] == [(20_000, 20_000, 10_000, 0, ["7", "9"]), (10_000, 10_000, 6000, 1, ["8"]), (9, 9, 3, 0, ["9"]), (56, 25, 25, 30, ["7", "9"])]


def test_longest_matches_by_brute_force(spark, pairs):
    from flowloom.llm import decontaminate

    rng = np.random.default_rng(4)
    text = lambda n: " ".join(map(str, rng.integers(0, 2, n)))
    items = [(i, text(n)) for i, n in enumerate([200, 60, 3, 11, 10])] + [(9, "0 " * 40)]
    docs = [(i, text(150)) for i in range(20)] + [(99, items[0][1][40:200] + " 7 " + items[1][1]), (100, "0 " * 60)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    words = {i: t.split() for i, t in items}
    got = {r.doc_id: r for r in found.collect()}
    for d, t in docs:
        w, best = t.split(), (0, 0)
        for i in range(len(w)):
            for v in words.values():
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n >= min(10, len(v)) and (n, -i) > best:
                        best = (n, -i)
        r = got[d]
        assert (r.longest, -(r.longest_at or 0)) == best
        if r.longest:
            assert words[int(r.longest_item)][r.longest_item_at : r.longest_item_at + r.longest] == w[r.longest_at : r.longest_at + r.longest]
