"""Texts that collide under polynomial hashes modulo a power of two stay apart, and ids need not be integers."""

import pytest

from worksight.llm.jaccard_join import jaccard_components
from worksight.llm.line_dedup import line_dedup
from worksight.llm.substring_dedup import substring_dedup
from worksight.llm.suffix_dedup import suffix_dedup


def alike(n: int) -> tuple[str, str]:
    """Two words of n letters by the parity of ones in each place's number, complementary to each other."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="module")
def pair(spark):
    a, b = alike(2048)
    return spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")


def test_jaccard_tells_long_words_apart(pair):
    assert [(r.doc_id, r.component_id) for r in jaccard_components(pair, k=4, percent=85).orderBy("doc_id").collect()] == [(1, 1), (2, 2)]


def test_word_windows_tell_long_words_apart(spark):
    a, b = alike(2048)
    rows = [(1, " ".join([a, *map(str, range(25))])), (2, " ".join([b, *map(str, range(19)), "x"]))]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=20)
    assert [r.n_removed for r in got.orderBy("doc_id").collect()] == [0, 0]


def test_line_windows_tell_long_words_apart(spark):
    a, b = alike(2048)
    got = line_dedup(spark.createDataFrame([(1, f"{a}\nx\ny"), (2, f"{b}\nx\ny")], "doc_id long, text string"))
    assert [r.n_lines_removed for r in got.orderBy("doc_id").collect()] == [0, 0]


@pytest.mark.parametrize("length", [100, 300, 2048])
def test_bytes_tell_long_words_apart(spark, length):
    a, b = alike(2048)
    rows = [(1, a), (2, b), (3, "q" + a[: length + 5])]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=length)
    seen, want = set(), []
    for _, t in rows:
        gone = set()
        for s in range(len(t) - length + 1):
            gone |= set(range(s, s + length)) if t[s : s + length] in seen else set()
            seen.add(t[s : s + length])
        want.append(len(gone))
    assert [r.n_removed for r in got.orderBy("doc_id").collect()] == want


def test_string_ids(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    lines = "\n".join(f"line {i}" for i in range(4))
    rows = [("b", passage), ("a", passage), (None, None), ("c", lines), ("d", "z\n" + lines)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {"a": 0, "b": 30, None: 0, "c": 0, "d": 0}
    assert {r.doc_id: r.n_removed for r in suffix_dedup(docs).collect()} == {"a": 0, "b": len(passage), None: 0, "c": 0, "d": 0}
    assert {r.doc_id: r.n_lines_removed for r in line_dedup(docs).collect()} == {"a": 0, "b": 0, None: 0, "c": 0, "d": 4}
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_components(docs, k=1, percent=80).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 0), None: (None, 0), "c": ("c", 1), "d": ("c", 1)}
    assert line_dedup(docs).columns == ["doc_id", "text", "n_lines", "n_lines_removed"]


def test_a_long_text_and_many_ranges(spark):
    """One text of three million characters and no repeats, beside a short copy of its end."""
    long = " ".join(f"{i:x}" for i in range(500_000))
    docs = spark.createDataFrame([(1, long), (2, long[-3000:])], "doc_id long, text string")
    got = substring_dedup(docs, n_bytes=1 << 40)  # as many ranges as for a terabyte
    assert [r.n_removed for r in got.orderBy("doc_id").collect()] == [0, len(long[-3000:].split())]
