"""Deduplication operators against brute force, with nulls, empty and periodic texts, repeated rows, empty tables and clashing columns."""

import random
import re

import pytest

from worksight.llm import blocks, suffix_dedup as sd
from worksight.llm.jaccard_join import jaccard_components
from worksight.llm.line_dedup import line_dedup
from worksight.llm.substring_dedup import substring_dedup
from worksight.llm.suffix_dedup import suffix_dedup

BLANKS = " \t\n\x0b\x0c\r"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def brute_substrings(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w, gone = words(t), set()
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            gone |= set(range(s, s + n)) if k in seen else set()
            seen.add(k)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def brute_bytes(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b, gone = (t or "").encode(), set()
        for s in range(len(b) - n + 1):
            gone |= set(range(s, s + n)) if b[s : s + n] in seen else set()
            seen.add(b[s : s + n])
        spans = sum(1 for j in gone if j - 1 not in gone)
        out[i] = (len(b), len(gone), spans, bytes(x for j, x in enumerate(b) if j not in gone))
    return out


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = [] if t is None else t.split("\n")
        full, gone = [j for j, x in enumerate(lines) if x.strip(BLANKS)], set()
        for s in range(len(full) - 2):
            k = tuple(lines[j].strip(BLANKS) for j in full[s : s + 3])
            gone |= set(full[s : s + 3]) if k in seen else set()
            seen.add(k)
        out[i] = (len(full), len(gone), None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in gone))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    voc = ["".join(r.choice("abéd") for _ in range(r.randint(1, 4))) for _ in range(30)]
    said = [" ".join(r.choice(voc) for _ in range(r.randint(3, 40))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "a" * 400), (3, "a" * 150), (4, "x\n\n  \nx\nx\nx\nx\nx")]
    for i in range(5, n):
        if r.random() < 0.15:
            rows.append((i, rows[r.randrange(len(rows))][1]))
        else:
            rows.append((i, "".join((r.choice(said) if r.random() < 0.6 else " ".join(r.choice(voc) for _ in range(30))) + r.choice(["\n", " ", "\n\n", "  \n"]) for _ in range(r.randint(1, 12)))))
    return rows


@pytest.fixture(params=[False, True], ids=["one block", "many blocks"])
def small_blocks(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(blocks, "PART_ENTRIES", 100)
        monkeypatch.setattr(sd, "HOT", 1)
        monkeypatch.setattr(sd, "SHARD_BYTES", 2000)
    return request.param


def test_equal_to_brute_force(spark, small_blocks):
    rows = corpus(int(small_blocks))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, 8).collect()} == brute_substrings(rows, 8)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(df, 30).collect()} == brute_bytes(rows, 30)
    assert {r.doc_id: (r.n_lines, r.n_lines_removed, r.text) for r in line_dedup(df).collect()} == brute_lines(rows)


def test_empty_table_clashing_columns_and_repeated_rows(spark):
    for f in (substring_dedup, suffix_dedup, line_dedup):
        assert f(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "\n".join(" ".join(f"w{i}" for i in range(k, k + 12)) for k in range(6))
    df = spark.createDataFrame([(1, text, 5, "x"), (1, text, 5, "x"), (2, text, 5, "x")], "doc_id long, text string, n_removed int, kept string")
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup(df).collect())
    assert got[0] == got[1] and got[2] == (2, 72)
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup(df).collect())
    assert got[0] == got[1] and got[2] == (2, len(text))
    assert sorted((r.doc_id, r.n_lines_removed) for r in line_dedup(df).collect()) == [(1, 0), (1, 0), (2, 6)]


def brute_links(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_components(spark, small_blocks):
    r = random.Random(int(small_blocks))
    voc = [f"w{i}" for i in range(60)]
    families = [[r.choice(voc) for _ in range(r.randint(15, 80))] for _ in range(8)]
    rows = [(0, None), (1, " "), (2, "one two"), (3, "ONE two"), (4, "one two three")]
    for i in range(5, 100):
        w = list(r.choice(families))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
            j = r.randrange(len(w))
            w[j : j + r.randint(0, 1)] = [r.choice(voc).upper()]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(df, 4, 85).collect()} == brute_links(rows, 4, 85)
