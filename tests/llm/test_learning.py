"""Clustering, language identification and importance resampling against plain versions and held-out labels, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from worksight.llm import importance_sampling as imp
from worksight.llm.centroid_clustering import cluster, op11_centroid_clustering
from worksight.llm.importance_sampling import op13_importance_sampling, resample
from worksight.llm.language_id import held_out, identify, learn, op12_language_id

DATA = "/root/testdata/sf0.001"


def plain_clusters(rows, k, rounds, seed, size):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centroids)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def vectors(seed, n, size):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(size)] for _ in range(7)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in r.choice(middles)]) for i in range(n)]
    return rows + [(n + i, [0.5] * size) for i in range(40)] + [(1, rows[1][1]), (None, rows[2][1]), (n + 50, None), (n + 51, []), (n + 52, [1.0]), (n + 53, [None] * size), (n + 54, [float("nan")] * size), (n + 55, [float("inf")] * size)]


@pytest.mark.parametrize("seed,size,k", [(1, 3, 12), (2, 6, 25), (3, 1, 5), (4, 4, 1), (5, 2, 500)])
def test_clusters_as_in_plain_rounds(spark, seed, size, k):
    rows = vectors(seed, 300, size)
    want, centroids = plain_clusters(rows, k, 5, "2:", size)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, centroids = plain_clusters(rows32, k, 5, "2:", size)
    got = cluster(df, k, 5, "2:", size)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.rows.collect()), key=key) == sorted(want, key=key)
    assert got.centroids.tolist() == centroids and sum(got.counts) == len(want) and sum(got.sums) == sum(d for _, _, d in want)
    assert all(r["none"] + r["few"] + r["all"] == len(want) for r in got.rounds)


def test_bounds_spare_most_distances_on_separate_groups(spark):
    r = random.Random(9)
    rows = [(i, [10 * (i % 20) + r.gauss(0, 0.1), r.gauss(0, 0.1)]) for i in range(2000)]
    got = cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 5, "2:", 2)
    last = got.rounds[-1]
    assert last["none"] > 10 * (last["few"] + last["all"]) and last["bounds"] <= got.rounds[0]["bounds"]


def test_clusters_of_nothing_and_of_large_components(spark):
    kind = "vec_id long, embedding array<double>"
    assert cluster(spark.createDataFrame([], kind), 3, 2, "2:", 2).rows.collect() == []
    assert cluster(spark.createDataFrame([(1, [1.0])], kind), 3, 2, "2:", 2).rows.collect() == []
    big = [(i, [1e5 * i + 0.5, -2e5 * i]) for i in range(2)]
    want, _ = plain_clusters(big, 1, 2, "2:", 2)
    assert sorted(map(tuple, cluster(spark.createDataFrame(big, kind), 1, 2, "2:", 2).rows.collect())) == want
    with pytest.raises(Exception, match="beyond"):
        cluster(spark.createDataFrame([(1, [1e9, 0.0])], kind), 1, 1, "2:", 2).rows.collect()


def test_clustering_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, centroids = plain_clusters(rows, 40, 5, "2:", 64)
    inertia, by = sum(d for *_, d in want), Counter()
    for _, c, d in want:
        by[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert sorted(map(tuple, op11_centroid_clustering(spark, DATA).collect())) == sorted((i, c, d, by[c], inertia, digest[c]) for i, c, d in want)


def test_languages_of_held_out_rows(spark):
    rows = op12_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in out) >= 0.97 * len(out)
    sure = [r for r in out if r.lang_accepted != "und"]
    assert len(sure) > 0.9 * len(out) and sum(r.lang_accepted == truth[r.doc_id].lang for r in sure) >= 0.98 * len(sure)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    en, de = "the house and the tree of the river with water ", "das Haus und der Baum an dem Fluss mit dem Wasser "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de", "x") for i in range(40)]
    rows += [(None, en, "en", "x"), (41, None, "en", "x"), (42, de, None, "x"), (42, de, None, "x"), (43, "", "de", "x")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    languages = learn(train)
    assert languages.names == ("de", "en") and languages == learn(train.repartition(7))
    asked = [(1, "the river and the tree", "a"), (2, "an dem Fluss mit dem Baum", "b"), (3, None, "c"), (4, "", "d"), (5, "123 ... 45", "e"), (6, de * 100_000, "f"), (6, de * 100_000, "f"), (None, "DAS HAUS UND DER BAUM", "g"), (8, "x", "h")]
    docs = spark.createDataFrame(asked, "doc_id long, text string, score string")
    got = identify(docs, languages).select("doc_id", "lang_pred", "score", "lang_accepted").collect()
    assert [r.lang_pred for r in got[:8]] == ["en", "de", "und", "und", "und", "de", "de", "de"] and got[8].lang_pred in ("de", "en") and got[8].lang_accepted == "und"
    assert [r.score for r in got[2:5]] == [0, 0, 0] and identify(docs, languages).columns == ["doc_id", "text", "score", "lang_pred", "lang_accepted"]
    none = identify(docs, learn(train.limit(0)))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)} and identify(docs.limit(0), languages).collect() == []
    assert docs.select(held_out()).collect()[7][0] is True


def plain_words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, percent, seed, least):
    buckets = lambda text: [zlib.crc32(f.encode()) % 10_000 for f in plain_features(text)]
    s, t = Counter(b for _, x in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    n_s, n_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets(x)))
        out.append([i, len(plain_words(x)), len(plain_features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=lambda r: (r[0] is None, r[0] or 0, str(r[1:])))


@pytest.mark.parametrize("piece,block,group", [(2 << 20, 3 << 20, 12 << 20), (7, 900, 400), (64, 1, 3000)])
def test_resampling_as_in_the_plain_version(spark, monkeypatch, piece, block, group):
    monkeypatch.setattr(imp, "PIECE", piece)
    monkeypatch.setattr(imp, "BLOCK", block)
    monkeypatch.setattr(imp, "GROUP", group)
    r = random.Random(3)
    voc = ["".join(r.choice("abcÉé9") for _ in range(r.randint(1, 5))) for _ in range(60)] + ["x" * 70, "é" * 200]
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(voc) if r.random() < 0.9 else r.choice(voc).upper() for _ in range(n))
    rows = [(i, text(r.choice([1, 2, 3, 19, 20, 21, 60]))) for i in range(120)] + [(200, "the " * 700), (201, "y" * 5000)]
    rows += [(300, None), (301, ""), (302, "... --- !!"), (303, text(30)), (303, text(30)), (None, text(30)), (304, rows[3][1]), (304, rows[3][1])]
    target = [text(25) for _ in range(9)] + [None, "", "the the the"]
    docs = spark.createDataFrame([(i, x, "w") for i, x in rows], "doc_id long, text string, weight string").repartition(3)
    got = resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), 30, "42:", 20)
    got = sorted(map(tuple, got.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r[1:])))
    assert got == plain_resample(rows, target, 30, "42:", 20)


def test_resampling_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c"), (2, "a " * 40)], "doc_id long, text string")
    assert resample(none, some, 50, "42:").collect() == []
    got = sorted(map(tuple, resample(some, none, 50, "42:").collect()))
    assert got == plain_resample([(1, "a b c"), (2, "a " * 40)], [], 50, "42:", 20)


def test_resampling_query(spark):
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    rows = [(r.doc_id, r.text) for r in read("documents").collect()]
    want = plain_resample(rows, [r.text for r in read("benchmark").collect()], 5, "42:", 20)
    got = sorted(map(tuple, op13_importance_sampling(spark, DATA).collect()))
    assert got == sorted((r[0], *r[2:]) for r in want)


def test_checksums_of_joined_texts():
    buf = np.frombuffer(b"one two " + b"z" * 100 + " żółw".encode(), np.uint8)
    words = [(0, 3), (4, 7), (8, 108), (109, len(buf))]
    start, end = np.array([a for a, _ in words]), np.array([b for _, b in words])
    crc = imp.checksums(buf, start, end)
    assert crc.tolist() == [zlib.crc32(bytes(buf[a:b])) for a, b in words]
    assert imp.joined(crc[:-1], crc[1:], (end - start)[1:]).tolist() == [zlib.crc32(bytes(buf[a:b]) + b" " + bytes(buf[c:d])) for (a, b), (c, d) in zip(words, words[1:])]
