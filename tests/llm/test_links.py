"""n_links against brute force: every link between different sets, in groups whose members are all alike."""

import random

import pytest

from tests.llm.test_dedup import words
from worksight.llm import jaccard_join as jj
from worksight.llm.jaccard_join import jaccard_components


@pytest.mark.parametrize("part", [1024, 3])
def test_links_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(jj, "PART_NODES", part)
    r = random.Random(5)
    base = [[f"w{k}_{i}" for i in range(80)] for k in range(3)]
    rows = [(0, None), (1, "")]
    for i in range(2, 50):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(80)] = f"x{r.randrange(30)}"
        rows.append((i, " ".join(w)))
    sets = {i: frozenset(tuple(w[j : j + 4]) for j in range(len(w) - 3)) for i, t in rows for w in [words(t)]}
    distinct = set(sets.values()) - {frozenset()}
    alike = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    want = {i: sum(1 for o in distinct if s and o != s and alike(s, o)) for i, s in sets.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.n_links for x in jaccard_components(df, 4, 85).collect()} == want and max(want.values()) > 3


def test_repeated_rows_are_one_link(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (1, text), (2, text + " x"), (2, text + " x")], "doc_id long, text string")
    assert {(x.doc_id, x.component_id, x.n_links) for x in jaccard_components(df, 4, 85).collect()} == {(1, 1, 1), (2, 1, 1)}
