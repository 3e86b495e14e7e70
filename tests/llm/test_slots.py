"""The slot of every sequence against a plain version, written runs, and what must be refused."""

import numpy as np
import pytest

from worksight.llm.training_order import ROUNDS, VOCABULARY, read_shards, training_order, write_shards

M = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_slot(number, n, key):
    half = 1
    while 1 << 2 * half < n:
        half += 1
    keys = [plain_mix(i + key & M) for i in range(ROUNDS)]
    while True:
        left, right = number >> half, number & (1 << half) - 1
        for k in keys:
            left, right = right, left ^ plain_mix(right ^ k) & (1 << half) - 1
        number = left << half | right
        if number < n:
            return number


@pytest.mark.parametrize(("vocabulary", "width"), [(300, 2), (100_000, 4)])
def test_slots_equal_a_plain_version(spark, vocabulary, width):
    top = vocabulary - 1
    rows = [(5, [256, top, 0]), (3, list(range(40))), (9, []), (7, None), (1, [top] * 16), (-2, [256] * 17)]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(3)
    shards = training_order(docs, length=16, per_shard=4, key=99, token_ids="ids", vocabulary=vocabulary)
    want, number = {}, 0
    pieces = [(i, k, (ids or [])[16 * k : 16 * k + 16]) for i, ids in sorted(rows) for k in range(len(ids or []) // 16 + 1)]
    for i, k, ids in pieces:
        want[plain_slot(number, len(pieces), 99)] = (i, k, ids + [vocabulary] * (16 - len(ids)))
        number += 1
    got = {}
    for s in shards.collect():
        assert (s.width, s.stride, s.first_slot, s.end_id) == (width, 16 * width, 4 * s.shard, vocabulary)
        for j, (i, k, t) in enumerate(zip(s.doc_ids, s.pieces, np.frombuffer(bytes(s.payload), f"<u{width}").reshape(-1, 16))):
            got[s.first_slot + j] = (i, k, t.tolist())
    assert got == want and sorted(got) == list(range(len(pieces)))


def test_written_shards_are_read_from_any_slot(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i % 50)) for i in range(200)] + [(None, "x")], "doc_id long, text string")
    shards = training_order(docs, length=8, per_shard=16, vocabulary_path=VOCABULARY)
    manifest = write_shards(shards, str(tmp_path / "run"), per_shard=16)
    n = manifest["n_sequences"]
    assert manifest["end_id"] == 50_256 and manifest["n_shards"] == -(-n // 16)
    every = [bytes(r.tokens) for r in read_shards(spark, str(tmp_path / "run")).orderBy("slot").collect()]
    rest = [(r.slot, bytes(r.tokens)) for r in read_shards(spark, str(tmp_path / "run"), 37).orderBy("slot").collect()]
    assert len(every) == n and rest == list(enumerate(every))[37:]
    resumed = training_order(docs, length=8, per_shard=16, vocabulary_path=VOCABULARY, start_shard=3)
    assert sorted(r.shard for r in resumed.collect()) == list(range(3, manifest["n_shards"]))


@pytest.mark.parametrize("ids", [[1, None], [-1], [300]])
def test_ids_outside_the_vocabulary_are_refused(spark, ids):
    docs = spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="null|don't fit"):
        training_order(docs, token_ids="ids", vocabulary=300).collect()
