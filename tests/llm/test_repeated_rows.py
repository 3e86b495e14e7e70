"""Rows that repeat with their ids, and null ids."""

from worksight.llm.secret_scan import BlobLedger, scan_secrets


def test_ledger_scans_repeated_rows_once(spark, tmp_path):
    text = 'x password = "hunter2hunter" y'
    for k, ids in enumerate(([1, 1], [None, None, None], [1, 1, None, 2])):
        ledger = BlobLedger(spark, str(tmp_path / str(k)))
        df = spark.createDataFrame([(i, text) for i in ids] + [(7, None)], "doc_id long, text string")
        got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.findings]) for r in scan_secrets(df, ledger).collect()]
        key = lambda x: str(x)
        assert sorted(got, key=key) == sorted([(i, [("assign", 2, 27)]) for i in ids] + [(7, [])], key=key)
        assert ledger.scanned().count() == 2 and ledger.findings("secrets-1").count() == 1
