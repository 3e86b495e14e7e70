"""Near copies under repeated, shared and null ids; stored ids decoded again."""

import corpus_pipeline
from worksight.llm.sentencepiece_codec import decode, encode


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c + " end"), (None, "n " + b), (None, b + " z"), (None, None), (9, "alone here")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(got, key=str)[-3:] and len(got) == 5
    assert {i for i, _ in got} == {1, 2, 3, 9, None} and (1, a) in got and (2, b) in got and (None, None) in got
    assert {t for i, t in got if i == 3} <= {c, c + " end"}


def test_stored_ids_decode(spark):
    rows = [(0, None), (1, ""), (2, "The road, é 執\n"), (3, "  two")]
    out = encode(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "piece_ids")
    assert {r.doc_id: r.decoded or None for r in decode(out).collect()} == {i: t or None for i, t in rows}
    assert decode(out.selectExpr("doc_id", "cast(null as array<int>) AS piece_ids")).filter("decoded IS NOT NULL").count() == 0
