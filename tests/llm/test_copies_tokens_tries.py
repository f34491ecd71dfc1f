"""Exact duplicates, token alignment and the prefix trie against brute force."""
import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hourcast.llm import cross_tokens, fingerprints, prefix_trie

BYTES, PIECES, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))


# --- exact duplicates

def brute_duplicates(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[ \t-\r]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha, len(text.encode())) for i in ids]
    return sorted(out, key=str)


LONG = "".join(random.Random(3).choice("ab \né") for _ in range(5000))
ROWS = [(5, "a b"), (3, "a\t\n b"), (9, " a b"), (4, "a b "), (None, "a b"), (3, "a b"), (7, None), (8, ""), (2, " "), (1, "\n\t"),
        (20, LONG), (21, LONG + "x"), (22, LONG.replace(" ", "\t ")), (23, LONG[:-1] + "!"), (24, " "), (25, "  \x1c"),
        (None, "no id"), (None, "no id"), (30, "ab"), (31, "ba"), (32, "a\x00b")] + [(100 + i, "copy") for i in range(300)]


@pytest.mark.parametrize("size, polynomials", [
    (fingerprints.CHUNK, fingerprints.POLYNOMIALS), (7, fingerprints.POLYNOMIALS),
    (16, ((3, 2), (2, 1)))])  # with tiny primes nearly all texts of a length are suspects
def test_exact_duplicates(spark, size, polynomials):
    rows = ROWS if size != 16 else [r for r in ROWS if len(r[1] or "") < 10]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id bigint, text string, size int, leader string").repartition(5)
    got = fingerprints.exact_duplicates(df, size=size, polynomials=polynomials).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.n_bytes) for r in got], key=str) == brute_duplicates(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_chunk_terms_compose():
    import numpy as np
    data = np.frombuffer(random.Random(1).randbytes(1000), "uint8")
    for p, x in fingerprints.POLYNOMIALS:
        whole = sum(int(b) * pow(x, 999 - i, p) for i, b in enumerate(data)) % p
        for size in (64, 1000, 1001):
            terms = [fingerprints.chunk_term(data[i:i + size], max(1000 - i - size, 0), p, x, size) for i in range(0, 1000, size)]
            assert sum(terms) % p == whole


def test_exact_duplicates_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert fingerprints.exact_duplicates(df).count() == 0


# --- alignment

def brute_alignment(texts):
    a, bytes_a = cross_tokens.byte_tokenizer(BYTES)
    b, bytes_b = cross_tokens.piece_tokenizer(PIECES)
    rows, counts = [], collections.Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        if not t or b"".join(bytes_a[i] for i in x) != raw or b"".join(bytes_b[i] for i in y) != raw:
            rows.append(([], [], [], []))
            continue

        def spans(ids, table):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i])))
                at += len(table[i])
            return out
        sx, sy = spans(x, bytes_a), spans(y, bytes_b)
        links = [(x[i], y[j]) for i, (p, q) in enumerate(sx) for j, (r, s) in enumerate(sy) if p < s and r < q]
        both = sorted({e for _, e in sx} & {e for _, e in sy})
        groups = [([x[i] for i, (p, q) in enumerate(sx) if lo < q <= hi], [y[j] for j, (r, s) in enumerate(sy) if lo < s <= hi])
                  for lo, hi in zip([0, *both], both)]
        rows.append((x, y, groups, links))
        counts.update(links)
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for x, y, groups, links in rows:
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (len(x), len(y), len(groups), len(links), sum(counts[l] == best[l[1]] for l in links),
               sum(counts[l] for l in links), hashlib.sha256(line.encode()).hexdigest() if x else "")


def odd_texts(n):
    rng = random.Random(5)
    bits = ["a", "B", "é", "ß", " ", "  ", "\t", "\n", "▁", "</s>", "<|endoftext|>", "<0x41>", "日本", "\U0001f642", "'s",
            "don't", "12", " 3", ".", " ", "　", "ｱ", "ﬁ", "\r\n", " the", "ing ", " running", "́", "\x00"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_alignment(spark, ranks):
    texts = [None, "", " ", "a", "word " * 60 + "end", "x" * 300, "The internationalisation of tokenizers", "a", *odd_texts(150)]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id bigint, text string, links string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in cross_tokens.alignment(df, BYTES, PIECES, ranks=ranks).collect()}
    for i, want in enumerate(brute_alignment(texts)):
        assert got[i] == want, texts[i]


def test_part_ids_are_those_of_whole_texts():
    encoder = cross_tokens.PartEncoder(BYTES, PIECES, RANKS)
    for t in odd_texts(1500):
        raw = (" " + t).encode()
        a, b = encoder.a.encode(" " + t, add_special_tokens=False).ids, encoder.b.encode(t)
        right = b"".join(encoder.bytes_a[i] for i in a) == raw and b"".join(encoder.bytes_b[i] for i in b) == raw
        got = encoder.encode(encoder.teach([t])[0])
        assert (got is not None) == right
        assert not right or (got[0].tolist(), got[1].tolist()) == (a, b), t


def test_diagonal_runs():
    rng = random.Random(2)
    for _ in range(300):
        end = rng.randint(1, 60)
        a, b = ([*sorted(rng.sample(range(1, end), rng.randint(0, end - 1))), end] for _ in range(2))
        if rng.random() < 0.5:
            b = sorted({*a} ^ {rng.randint(1, end)} | {end})
        la, lb, ua, ub = cross_tokens.align(a, b)
        spans = [list(zip([0, *e], e)) for e in (a, b)]
        assert sorted(zip(la.tolist(), lb.tolist())) == [
            (i, j) for i, (p, q) in enumerate(spans[0]) for j, (r, s) in enumerate(spans[1]) if p < s and r < q]
        assert [a[i - 1] for i in ua] == [b[j - 1] for j in ub] == sorted({*a} & {*b})


def test_alignment_empty(spark):
    assert cross_tokens.alignment(spark.createDataFrame([], "doc_id bigint, text string"), BYTES, PIECES).count() == 0


# --- prefix trie

def brute_trie(strings):
    members = collections.defaultdict(list)
    for c, turns in strings.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for node, ids in members.items():
        subtree = [n for n in members if n[:len(node)] == node]
        children = [n for n in subtree if len(n) == len(node) + 1]
        leaves = [n for n in subtree if not any(len(m) == len(n) + 1 and m[:-1] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in subtree if n)
        ends = ",".join(map(str, sorted(c for c in ids if len(strings[c]) == len(node))))
        rows.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children), len(leaves),
                     saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def brute_strings(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return own, out


def conversations(longest):
    rng = random.Random(longest)
    rows = [(c, k, rng.choice("us"), "x" * rng.randint(0, 2)) for c in range(230) for k in range(rng.randint(1, longest))]
    return rows + [(None, 0, "u", "lost"), (7, None, None, None), (300, None, "é", "café\U0001f600"), (400, 5, None, "a"),
                   (401, 0, "u", ""), (402, 0, "", "u"), (10_000_019, 0, "u", "x")]


@pytest.mark.parametrize("longest", [1, 2, 7, 21])
def test_prefix_trie(spark, longest):
    rows = conversations(longest)
    df = spark.createDataFrame([(*r, "n") for r in rows], "conv_id bigint, turn int, role string, text string, node string").repartition(6)
    own, rebuilt = brute_strings(rows)
    convs = prefix_trie.strings(df)
    assert sorted(map(tuple, prefix_trie.prefix_trie(convs).collect()), key=str) == brute_trie(own)
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    again = prefix_trie.rebuilt(convs, F.col("conv") - F.col("conv") % 100, head)
    assert sorted(map(tuple, prefix_trie.prefix_trie(again).collect()), key=str) == brute_trie(rebuilt)


def test_many_ends_of_one_node(spark):
    """Ids of several blocks are hashed as one line."""
    df = spark.range(0, 9000, 1, 7).selectExpr("id as conv_id", "0 as turn", "'u' as role", "'hi' as text")
    row = prefix_trie.prefix_trie(prefix_trie.strings(df)).where("depth = 1").first()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(9000))).encode()).hexdigest()
    assert (row.n_convs, row.saved_tokens, row.n_leaves, row.n_children) == (9000, 8999 * 2, 1, 0)


def test_trie_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.strings(df)).count() == 0
