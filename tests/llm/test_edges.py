"""Shards of differing columns and competing writers, the ledger's later runs, the shuffled lookup, and odd rows of every operator."""

import random
import threading

import pytest

from worksight.llm import decontamination as dc
from worksight.llm.quality_rules import quality_rules
from worksight.llm.secret_scan import BlobLedger, scan_secrets
from worksight.llm.sentencepiece_codec import decode, encode
from worksight.llm.sharding import Conflict, ShardStore


def test_columns_that_a_run_lacks_are_null(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), smallest_bytes=1 << 20, fan_out=3)
    store.append(spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"))
    store.append(spark.createDataFrame([(2, "b")], "doc_id long, text string"))
    store.append(spark.createDataFrame([], "doc_id long, text string, more int"))
    want = [(1, "a", "en", None), (2, "b", None, None)]
    rows = lambda: sorted((r.doc_id, r.text, r.lang, r.more) for r in store.read().collect())
    assert rows() == want
    store.compact()
    store.vacuum(older_than_seconds=0)
    assert len(store.manifest()["runs"]) == 1 and rows() == want
    with pytest.raises(ValueError, match="other types"):
        store.append(spark.createDataFrame([("x",)], "doc_id string"))


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "s"), []

    def write(k):
        try:
            ShardStore(spark, path).append(spark.createDataFrame([(k,)], "doc_id long"))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = ShardStore(spark, path)
    assert not failed and store.version() == 6 and sorted(r.doc_id for r in store.read().collect()) == list(range(6))


def test_unfinished_version_is_passed_over_after_its_lease(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame([(1,)], "doc_id long"))
    assert store._create(2) and not store._create(2) and store.version() == 1
    with pytest.raises(Conflict):
        store.append(spark.createDataFrame([(2,)], "doc_id long"), tries=2)
    store.lease_seconds = 0
    assert store.append(spark.createDataFrame([(2,)], "doc_id long")) == 3 and store.read().count() == 2


def test_empty_store(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"))
    assert store.read().count() == 0 and store.compact() == 0 and store.vacuum() == 0


def test_ledger_grows_and_is_compacted(spark, tmp_path):
    ledger = BlobLedger(spark, str(tmp_path / "l"))
    texts = ["", None, "token = abcdef", "x" * 300_000 + " AKIA" + "Q" * 16, "token = abcdef AKIA" + "Z" * 16]
    rows = [(i // 2, t, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, findings int")
    scan = lambda d: sorted((r.doc_id, [(s.kind, s.start, s.end) for s in r.findings]) for r in scan_secrets(d, ledger).collect())
    assert scan(docs.limit(0)) == []
    want = [(0, []), (0, []), (1, [("access", 300_001, 300_021)]), (1, [("assign", 0, 14)]), (2, [("assign", 0, 14), ("access", 15, 35)])]
    assert scan(docs.filter("doc_id < 2")) == want[:4] and scan(docs) == want and len(ledger._runs()) == 3
    ledger.compact()
    assert len(ledger._runs()) == 1 and scan(docs) == want and ledger.scanned().count() == 4


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_lookup_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(dc, "MAX_BROADCAST", most)
    r = random.Random(2)
    w = lambda n: [r.choice("abc") for _ in range(n)]
    items = [(k, " ".join(w(n))) for k, n in enumerate([2, 5, 13, 14, 30, 6])] + [(9, None), (10, "")]
    rows = [(i, " ".join(w(r.randrange(40))), "s") for i in range(30)] + [(50, items[4][1].upper() + ", x", "t"), (51, None, "u"), (50, items[4][1].upper() + ", x", "t"), (None, items[3][1], "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t, s in rows:
        own, hit, found = [x for x in (t or "").lower().replace(",", " ").split()], set(), set()
        for k, x in items:
            x = (x or "").split()
            n = min(13, len(x))
            windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
            at = [j for j in range(len(own) - n + 1) if n and tuple(own[j : j + n]) in windows]
            hit |= {j + q for j in at for q in range(n)}
            found |= {str(k)} if at else set()
        want.append((i, len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own), s))
    got = [(x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated, x.spans) for x in dc.decontaminate(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert dc.decontaminate(docs.limit(0), bench).count() == 0


def test_quality_of_repeated_and_long_rows(spark):
    long = "\n".join(f"Sentence {i} of a long text, with words{i}." for i in range(20_000))
    rows = [(1, long), (1, long), (2, " ".join(["same words again and again here, always."] * 20_000)), (3, "Todos los derechos reservados\n" + "\n".join(f"Frase{i} número {i * i}, con palabras." for i in range(9)))]
    got = [(r.doc_id, r.n_words, r.kept) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(1, 160_000, True), (1, 160_000, True), (2, 140_000, False), (3, 49, True)]


def test_codec_on_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, "a▁b", 1), (3, "é😀\n\t " * 3, 1), (4, "long " * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    out = encode(docs, decoded=True)
    assert out.columns == ["doc_id", "text", "n_pieces", "piece_ids", "decoded"]
    got = decode(out.drop("decoded")).collect()
    assert sorted((r.doc_id, r.decoded) for r in got if r.doc_id) == sorted((i, t.replace("▁", " ")) for i, t, _ in rows if i)
    assert [r.n_pieces for r in got if r.doc_id is None] == [0] and encode(docs.limit(0)).count() == 0
