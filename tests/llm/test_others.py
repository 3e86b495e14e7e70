"""Codec, training order, shards, ledger, quality rules and decontamination; the pipeline's stages in turn."""

import random

import duckdb
import numpy as np
import pytest

from worksight.llm import queries
from worksight.llm.decontamination import decontaminate
from worksight.llm.quality_rules import quality_rules
from worksight.llm.secret_scan import BlobLedger, scan_secrets
from worksight.llm.sentencepiece_codec import MODEL, Codec, read_pieces
from worksight.llm.sharding import ShardStore
from worksight.llm.training_order import feistel, read_slots, training_order

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    text = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))
    assert text(got) == text(want)


def test_viterbi_finds_the_best_score():
    with open(MODEL, "rb") as f:
        model = f.read()
    c = Codec(model)
    plain = {p.decode(): i for i, (p, _, t) in enumerate(read_pieces(model)) if t in (1, 4)}

    def best_score(text):
        data = (" " + text).replace(" ", "▁") if text else ""
        best = [0.0] + [-np.inf] * len(data)
        for i in range(len(data)):
            for j in range(i + 1, min(len(data), i + 20) + 1):
                if (k := plain.get(data[i:j])) is not None:
                    best[j] = max(best[j], best[i] + c.score[k])
            if data[i] not in plain:
                best[i + 1] = max(best[i + 1], best[i] + c.unknown_score)
        return best[-1], sum(len(x.encode()) for x in data if x not in plain)

    r = random.Random(1)
    texts = ["".join(r.choice("abcdefghé ñ執\n\t😀 €  the ") for _ in range(r.randint(0, 60))) for _ in range(200)] + ["   ", None, "\n", "a" * 3000]
    ids, sizes = c.encode(texts)
    assert c.decode(ids, sizes) == [t or "" for t in texts]
    at = 0
    for t, n in zip(texts, sizes):
        own, at = ids[at : at + n], at + n
        fallback = [i for i in own if i in set(c.byte_id.tolist())]
        score, n_bytes = best_score(t)
        assert len(fallback) == n_bytes
        unknown = sum(1 for x in (t or "") if x.replace(" ", "▁") not in plain)
        assert abs(sum(c.score[i] for i in own if i not in set(fallback)) + unknown * c.unknown_score - score) < 1e-6


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 1000, 4097):
        assert sorted(feistel(np.arange(n), n, 7)) == list(range(n))


def test_training_order_round_trip(spark):
    rows = [(0, None), (1, ""), (2, "abc" * 50), (2, "abc" * 50), (3, "é" * 7), (4, "x" * 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = training_order(df, length=16, per_shard=4)
    got = {}
    n = 0
    for s in shards.collect():
        tokens = np.frombuffer(bytes(s.payload), "<u2").reshape(-1, 16)
        n += s.n_sequences
        for d, k, t in zip(s.doc_ids, s.pieces, tokens):
            got.setdefault(d, []).append((k, bytes(t[t < 256].astype(np.uint8))))
    want = {i: sorted((k, (t or "").encode()[16 * k : 16 * k + 16]) for j, t in rows if j == i for k in range(len((t or "").encode()) // 16 + 1)) for i, _ in rows}
    assert {i: sorted(x) for i, x in got.items()} == want
    assert [r.slot for r in read_slots(shards, 3, n, 4).orderBy("slot").collect()] == list(range(3, n))
    assert training_order(df.limit(0)).count() == 0


def test_shards(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, smallest_bytes=1 << 20, fan_out=3)
    for k in range(3):
        store.append(spark.createDataFrame([(k, None), (k, "x")], "doc_id long, text string"))
    assert store.compact() == 4 and len(store.manifest()["runs"]) == 1 and len(store.manifest(3)["runs"]) == 3
    assert sorted(r.doc_id for r in store.read().collect()) == [0, 0, 1, 1, 2, 2]
    assert store.read(2).count() == 4 and store.vacuum() == 0 and store.vacuum(older_than_seconds=0) == 3
    with pytest.raises(RuntimeError):
        store._commit(store.manifest(2), [])


def test_ledger_scans_once(spark, tmp_path):
    ledger = BlobLedger(spark, str(tmp_path / "l"))
    rows = [(1, 'x password = "hunter2hunter" y'), (2, None), (3, "token: ab"), (4, 'x password = "hunter2hunter" y')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.findings] for r in scan_secrets(df, ledger).collect()}
    assert got == {1: [("assign", 2, 27)], 2: [], 3: [], 4: [("assign", 2, 27)]}
    assert ledger.scanned().count() == 3
    scan_secrets(df, ledger).collect()
    assert ledger.scanned().count() == 3


def test_quality_rules(spark):
    prose = "\n".join(f"Line {i} has words{i} such as{i} these{i}, and ends{i}." for i in range(6))
    rows = [(1, prose), (2, None), (3, ""), (4, "a | b | c | d | e\n" * 5), (5, "word " * 40), (6, "Home | News | Sport | Mail\n" + prose)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")).collect()}
    assert [i for i in sorted(got) if got[i].kept] == [1, 6]
    assert got[6].clean_text == prose and got[2].clean_text is None and got[5].n_repeat_words == 40
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination(spark):
    item = " ".join(f"Word{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "only three words"), (3, None)], "item_id long, text string")
    rows = [(1, "a b, " + item.upper() + " c"), (2, "x Only, three; words y"), (3, None), (4, "nothing here"), (4, "nothing here")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_hit int")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate(docs, bench).collect())
    assert got == [(1, 23, 20, ["1"], True), (2, 5, 3, ["2"], True), (3, 0, 0, [], False), (4, 2, 0, [], False), (4, 2, 0, [], False)]
    spans = {r.doc_id: r.text for r in decontaminate(docs, bench, remove="spans").collect()}
    assert spans[2] == "x , ;  y" and spans[4] == "nothing here"
    assert decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_pipeline_keeps_clean_documents_and_one_of_each_group(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 0 < len(ids) == len(set(ids)) < 200
