"""URL rules, token counts, token files, mixing and language on small fixtures against brute force."""
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from hourcast.llm import language, mixing, token_counts, token_files, url_rules

WORD = re.compile(r"[^ \t-\r]+")
PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t ", "one", "Thing. thing, THING", "caf\u00e9 nai\u0308ve \u00dcber stra\u00dfe don't 12.5% a.b...) (x)",
         "\u4e2d\u6587 \U0001f600\U0001f600 \x1cq\x85w", "<|endoftext|> it's <|startoftext|>.", "ab" * 3000, "word " * 4000,
         "Thing. thing, THING"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y"), (3, "one", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, size string")


# --- URL rules

RULES = [url_rules.Rule("allow", "org", "/"), url_rules.Rule("block", "example.org", "/es/"),
         url_rules.Rule("block", "example.org", "/en/1"), url_rules.Rule("allow", "com", "/fr/")]


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme porn", "", "", None, "block"),
    ("http://A.Example.ORG/en/12?x#y", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://org", "org", "", None, "allow"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://x.com/fr/porn", "x.com", "/fr/porn", "com/fr/", "allow"), ("http://x.net/porn", "x.net", "/porn", None, "block"),
    ("http://x.net/pornography", "x.net", "/pornography", None, "allow"), ("http://x.net/free", "x.net", "/free", None, "allow"),
    ("http://x.net/free/free", "x.net", "/free/free", None, "allow"), ("http://x.net/free-bets", "x.net", "/free-bets", None, "block"),
    ("http://a/b://c/d", "a", "/b://c/d", None, "allow"), ("http://x\n.net/a\nb", "x\n.net", "/a\nb", None, "allow"),
    ("http://x.net/" + "a-" * 50_000 + "xxx", "x.net", "/" + "a-" * 50_000 + "xxx", None, "block")])
def test_url_verdicts(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "old"), (1, url, "old")], "page_id int, url string, rule string")
    for row in url_rules.judge_urls(df, RULES).collect():
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_url_empty_table(spark):
    df = spark.createDataFrame([], "page_id int, url string")
    assert url_rules.judge_urls(df).columns[-1] == "verdict" and url_rules.judge_urls(df).count() == 0


# --- token counts

def brute_count(text, weights, byte):
    total = 0
    for word in WORD.findall(text or ""):
        t = token_counts.MARK + word
        best = [(0.0, 0)] + [(math.inf, 0)] * len(t)
        for end in range(1, len(t) + 1):
            size = len(t[end - 1].encode())
            best[end] = (best[end - 1][0] + byte * size, best[end - 1][1] + size)
            for start in range(max(0, end - 20), end):
                w = weights.get(t[start:end])
                if w is not None:
                    best[end] = min(best[end], (best[start][0] + w, best[start][1] + 1))
        total += best[-1][1]
    return total


def test_token_counts(spark, docs):
    weights, byte = token_counts.piece_weights(PIECES)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in token_counts.count_tokens(docs, PIECES).collect())
    want = sorted((r.doc_id if r.doc_id is not None else -1, brute_count(r.text, weights, byte)) for r in docs.collect())
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_trie_shares_prefixes():
    counter = token_counts.TrieCounter(*token_counts.piece_weights(PIECES))
    counter.lookup(["abc", "abd", "ab"])
    assert counter.nodes == len("▁abc") + 1  # ab is on the way, abd adds one


# --- token files

def test_token_files_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(BPE)
    path = str(tmp_path / "t")
    token_files.write_token_files(docs, path, BPE, 1, shards=3)
    back = token_files.read_token_files(spark, path)
    want = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = sorted(((r.doc_id, list(r.token_ids)) for r in back.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert got == want
    rows = {(r.doc_id, r.start): r for r in token_files.with_starts(token_files.ids_crc32(back)).collect()}
    start = 0
    for doc, ids in want:
        r = rows[doc, start]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert back.where("doc_id = 4").select("token_ids").first()[0] == want[[d for d, _ in want].index(4)][1]


def test_token_files_empty(spark, docs, tmp_path):
    token_files.write_token_files(docs.limit(0), str(tmp_path / "e"), BPE, 1)
    schema = spark.read.schema("doc_id bigint, shard int, token_ids array<int>").orc(str(tmp_path / "e"))
    assert token_files.with_starts(token_files.ids_crc32(schema)).count() == 0


# --- mixing

def one_by_one(votes, seats, limit):
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if votes[i] > 0 and got[i] < limit[i]]
        if not open_:
            break
        got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


@pytest.mark.parametrize("seed", range(30))
def test_sainte_lague_deals_like_single_seats(seed):
    r = random.Random(seed)
    votes = [r.choice([0, 5, 10, 10, r.randint(1, 1000)]) for _ in range(r.randint(1, 8))]
    limit = [r.choice([1, 3, 10**6]) for _ in votes]
    seats = r.randint(0, 60)
    assert mixing.sainte_lague(np.array(votes), seats, np.array(limit)).tolist() == one_by_one(votes, seats, limit)


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s], left = cap * sizes[s], left - cap * sizes[s]
        free -= full


@pytest.fixture
def sources(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 40, 300]))), s, 1)
            for i, s in enumerate(["a"] * 400 + ["b"] * 5 + ["c"] * 60 + [None] * 30 + ["\U0001f600"] * 20 + ["zero"])]
    rows[-1] = (rows[-1][0], None, "zero", 1)
    return spark.createDataFrame(rows + [rows[0]] * 3 + [(None, "no id here", "c", 1)], "doc_id bigint, text string, source string, _part int")


def test_mix_targets_and_takings(sources):
    rows = [r for r in mixing.plan_mix(sources, docs_per_shard=50).collect()]
    assert len(rows) == sources.count()
    sizes = {}
    for r in sources.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = brute_targets(sizes)
    for s, size in sizes.items():
        mine = [r for r in rows if r.source == s]
        assert {r.source_size for r in mine} == {size}
        assert all(math.isclose(r.target, want[s], abs_tol=1e-6) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 17, s
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    again = [tuple(r) for r in mixing.plan_mix(sources.repartition(5), docs_per_shard=50).collect()]
    assert sorted(map(str, again)) == sorted(str(tuple(r)) for r in rows)


def test_mixed_documents_hold_the_words_taken(sources):
    taken = sum(r.taken for r in mixing.plan_mix(sources).collect())
    out = mixing.mixed_documents(sources)
    assert out.columns == sources.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == taken
    assert mixing.mixed_documents(sources.limit(0)).count() == 0 and mixing.plan_mix(sources.limit(0)).count() == 0


# --- language

SAMPLES = {"en": "the house of the king and the water with their children ", "de": "der Hund und die Katze nicht auf dem Dach ",
           "fr": "le chat est dans la maison avec les enfants et une rivière "}


@pytest.fixture
def labelled(spark):
    rows = [(f"{t} {i} {t[: i % 20]}", lang, "z") for lang, t in SAMPLES.items() for i in range(30)]
    return spark.createDataFrame(rows + [(None, "en", "z"), ("the", None, "z"), ("", "de", "z")], "text string, lang string, score string")


def test_language_forward_sums_all_segmentations(labelled):
    model = language.fit(labelled, PIECES)
    assert model.languages == ["de", "en", "fr"]

    def brute(word):
        total, uniform = np.zeros(4), 1 / len(model.log_p)
        t = language.MARK + word

        def cut(at, p):
            nonlocal total
            if at == len(t):
                total = total + p
                return
            cut(at + 1, p * np.exp(language.FALLBACK))
            for end in range(at + 1, len(t) + 1):
                piece = model.pieces.get(t[at:end], -1)
                if piece >= 0:
                    cut(end, p * np.append(np.exp(model.log_p[piece]), uniform))

        cut(0, np.ones(4))
        return np.log(total)

    for w in ["house", "hous", "Dach", "é", "日本", "wxyz"]:
        assert np.allclose(model.words([w])[0], brute(w), atol=1e-4), w


def test_language_predictions(spark, labelled):
    model = language.fit(labelled, PIECES)
    rows = [(i, t, "kept") for i, t in enumerate([*SAMPLES.values(), None, "", "12 34 !", "x" * 50_000, "the water " * 5000])]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(rows, "doc_id int, text string, extra string"), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "de", "fr", "und", "und", "und"]
    assert got[3].score == got[4].score == got[5].score == 0 and got[6].lang_pred in SAMPLES and got[7].lang_pred == "en"
    assert all(0 <= r.score <= 1 and r.extra == "kept" for r in got.values())


def test_language_gain_tells_noise_and_unlearned_languages(spark, labelled):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # 30 short rows know too little to doubt anything
    model, rng = language.fit(docs.unionByName(labelled.select("text", "lang"), allowMissingColumns=True), PIECES), np.random.default_rng(5)
    noise = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 600))
    polish = "Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach. Są obdarzeni rozumem i sumieniem. "
    texts = [*SAMPLES.values(), None, "", "12 34 !", noise, polish, "Все люди рождаются свободными и равными в своем достоинстве"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in language.predict(df, model, names=("lang", "score", "gain")).collect()}
    assert all(got[i].gain > 0.5 for i in range(3)) and got[3].gain == got[4].gain == got[5].gain == 0
    assert all(got[i].gain < -0.2 for i in (6, 7, 8)), [got[i].gain for i in (6, 7, 8)]


def test_language_forgets_long_words(labelled):
    from hourcast.llm.common import worker_memory
    model = language.fit(labelled, PIECES)
    words = ["house", "k" * (language.MAX_KEPT + 1), "k" * language.MAX_KEPT, "house" * 3000]
    alone = np.array([language.LanguageModel(model.languages, model.log_p, model.pieces).words([w])[0] for w in words])
    assert np.allclose(model.words(words), alone) and np.allclose(model.words(words[::-1]), alone[::-1])
    assert set(worker_memory(("language", model.name), dict)["at"]) == {"house", words[2]}


def test_language_sample_counts_copies_once(spark):
    rows = [("fr", f"texte {i % 20}") for i in range(8000)] + [("en", f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {r["lang"]: r["count"] for r in language.sample_rows(df, "lang", "text", 100).groupBy("lang").count().collect()}
    assert got["fr"] == 20 and 50 <= got["en"] <= 150


def test_language_without_labels(spark, labelled):
    model = language.fit(labelled.limit(0), PIECES)
    assert {r.lang_pred for r in language.predict(labelled, model).collect()} == {"und"}
    assert language.predict(labelled.limit(0), model).count() == 0
