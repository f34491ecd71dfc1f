"""Near duplicates and connected components against brute force."""
import random
import re

import numpy as np
import pytest

from hourcast.llm import set_sketch
from hourcast.llm.components import components
from hourcast.llm.set_sketch import joint_estimate, near_duplicates, one_of_each, registers

WORD = re.compile(r"[^ \t-\r]+")


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """component of each row of (id, text)"""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[i][0] == rows[j][0] or same and 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                parent[find(i)] = find(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[find(i)] = min(k, ids.get(find(i), k))
    return [(k, len(sets[i]), ids.get(find(i))) for i, (k, _) in enumerate(rows)]


def edited(words, n, r):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        kind = r.random()
        if kind < 0.6:
            words[at] = f"new{r.randrange(10**6)}"
        elif kind < 0.8:
            words.insert(at, f"in{r.randrange(10**6)}")
        else:
            del words[at]
    return words


def corpus(seed, groups=6, copies=60):
    """Groups of copies with few to many edits, a passage in many texts, short and exact copies."""
    r = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for g in range(groups):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.choice([12, 40, 150]))]
        for _ in range(copies):
            rows.append(" ".join(edited(base, r.choice([0, 1, 1, 2, 3, 5, 8]), r)))
    for i in range(80):
        rows.append(" ".join([f"u{i}x{r.randrange(500)}" for _ in range(r.randrange(40))] + passage))
    rows += ["a b c", "A B C", "a b", "", None, " \n", "x", "one two three four five", "One two three four FIVE"]
    r.shuffle(rows)
    return [(r.randrange(10**9), t) for t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, node int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == sorted(brute(rows))
    kept = {r.doc_id for r in near_duplicates(df).where("kept").collect()}
    assert kept == {c for _, _, c in brute(rows)}
    stay = one_of_each(df)
    assert stay.columns == df.columns and {r.doc_id for r in stay.collect()} == kept and stay.count() == len(kept)


def test_nulls_repeats_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "the same five words here"), (7, "the same five words here"), (None, "all alone in the world now"), (7, "other text of number seven"),
            (9, "other text of number seven"), (3, None), (3, None), (4, long), (5, long + " end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(df).collect())
    n = 30_000 - 4
    assert got == sorted([(0, 1, 7, False), (7, 1, 7, True), (0, 2, 0, True), (7, 1, 7, True), (9, 1, 7, False), (3, 0, 3, True),
                          (3, 0, 3, True), (4, n, 4, True), (5, n + 1, 4, False)])
    assert sorted(r.doc_id or 0 for r in one_of_each(df).collect()) == [0, 3, 4, 7]
    assert near_duplicates(df.limit(0)).count() == 0 and one_of_each(df.limit(0)).count() == 0


def test_registers_merge_by_maximum():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 2**63, 500, dtype="uint64"), r.integers(0, 2**63, 700, dtype="uint64")
    one = registers(np.concatenate([a, b]), np.array([0, 500, 1200]))
    both = registers(np.concatenate([a, b]), np.array([0, 1200]))
    assert (np.maximum(one[0], one[1]) == both[0]).all() and (one > 0).all() and (one < set_sketch.LIMIT).all()


@pytest.mark.parametrize("similarity", [0.3, 0.75, 0.95])
def test_joint_estimate(similarity):
    r = np.random.default_rng(5)
    shared = int(2000 * similarity / (1 + similarity) * 2) // 2
    got = []
    for _ in range(60):
        x = r.integers(0, 2**63, 2000 * 2 - shared, dtype="uint64")
        s = registers(np.concatenate([x[:2000], x[-2000:]]), np.array([0, 2000, 4000]))
        got.append(joint_estimate(s[:1], s[1:], np.array([2000.0]), np.array([2000.0]))[0])
    true = shared / (4000 - shared)
    assert abs(np.mean(got) - true) < 0.03 and np.std(got) < 0.06


def test_connected_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(90)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {row.node: row.component for row in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
