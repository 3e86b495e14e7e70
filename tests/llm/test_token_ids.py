"""Training order over token ids: ids that bytes have not, the end marker, and ids that don't fit."""

import numpy as np
import pytest

from worksight.llm.queries import QUERIES
from worksight.llm.sentencepiece_codec import encode
from worksight.llm.training_order import training_order

SF = "/root/testdata/sf0.001"


def read_back(shards, length):
    """doc_id -> its ids, and what stands after them."""
    parts = {}
    for s in shards.collect():
        rows = np.frombuffer(bytes(s.payload), f"<u{s.width}").reshape(-1, length)
        assert s.stride == s.width * length
        for d, k, t in zip(s.doc_ids, s.pieces, rows):
            assert (t[np.argmax(t == s.end_id) :] == s.end_id).all() or not (t == s.end_id).any()
            parts.setdefault(d, []).append((k, t[t != s.end_id].tolist()))
    return {d: [x for _, part in sorted(p) for x in part] for d, p in parts.items()}


@pytest.mark.parametrize("vocabulary", [65535, 65536, 200000])
def test_token_ids_round_trip(spark, vocabulary):
    rows = [(0, None), (1, []), (2, [256, 256, 0, 255]), (3, list(range(250, 266))), (4, [vocabulary - 1] * 9 + [256])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    assert read_back(training_order(df, length=8, per_shard=2, token_ids="ids", vocabulary=vocabulary), 8) == {i: x or [] for i, x in rows}


@pytest.mark.parametrize("bad", [[300], [-1], [None]])
def test_ids_that_do_not_fit_are_errors(spark, bad):
    df = spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="don't fit|null"):
        training_order(df, token_ids="ids", vocabulary=300).collect()
    with pytest.raises(ValueError):
        training_order(df, token_ids="ids")


def test_query_lays_out_pieces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert read_back(QUERIES["op8_training_order"](spark, SF), 512) == {r.doc_id: r.piece_ids for r in encode(docs).collect()}
