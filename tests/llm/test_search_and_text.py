"""Decontamination, main text, nearest neighbours and the pipeline against brute force and planted cases."""
import math
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hourcast.llm import decontaminate, nn_descent, site_tree

# --- decontamination

TABLES = "/root/testdata/sf0.001"
ITEM = "Anna has 12 apples and gives 5 kg of them to Bob who already owns 12 pears in his small garden"
OTHER = "the quick brown fox jumps over the lazy dog near the river bank"


@pytest.fixture
def bench(spark):
    rows = [(1, ITEM, 0), (2, OTHER, 0), (3, "too short", 0), (4, None, 0), (5, "", 0), (6, "seven words make one short window here", 0), (1, ITEM, 0)]
    return spark.createDataFrame(rows, "item_id bigint, text string, h bigint")


CASES = {
    10: (f"before {ITEM} after", [1]),
    11: (f"before {ITEM.upper()} after", [1]),
    12: ("x. Maria has 15 apples and gives 7 kg of them to Carl who already owns 15 pears in his small garden", [1]),
    13: ("x. Maria has 15 apples and gives 7 kg of them to Carl who already owns 99 pears in his small garden", []),
    14: (f"{OTHER}. {ITEM}", [1, 2]),
    15: ("the quick brown fox sat down and the lazy dog near the hill slept", []),
    16: (None, []), 17: ("", []), 18: ("word " * 5000 + OTHER + " word" * 5000, [2]),
    19: ("Seven words make one short window here, too", [6]), 20: ((OTHER + " ") * 50, [2]),
    21: ("12 5 12 5 12 5 12 5 12 5 12 5", []),
    22: ("x. Maria has 7 apples and gives 7 kg of them to Carl who already owns 7 pears in his small garden", [1])}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_contaminated(spark, bench, limit):
    rows = [(k, t, 1) for k, (t, _) in CASES.items()] + [(10, CASES[10][0], 1), (None, OTHER, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, broadcast_windows=limit).collect()}
    assert got == {(k, i) for k, (_, items) in CASES.items() for i in items} | {(None, 2)}
    clean = decontaminate.clean_documents(docs, bench, broadcast_windows=limit)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {k for k, (_, items) in CASES.items() if not items}


LONG = ("the baker in the old town sells every morning fresh rolls to all people who come early and wait in front of the "
        "small shop until its green door opens and the smell of warm bread fills the whole street")
SHORT = "which of these four animals can sleep while standing on its legs in the field"
CHANGED = {
    1: (LONG.replace("people who", "people there who"), 1), 2: (LONG.replace("early and", "and"), 1),
    3: (LONG.replace("fresh rolls", "fresh and soft rolls").replace("its green door", "its door"), 1),
    4: (SHORT.replace("while", "when"), 2), 5: (SHORT.replace("while", "for hours while"), 2),
    6: ("Then Mary Ann has 1 200 apples and gives 5 of them to Bob who already owns 1 200 pears in his small garden", 3),
    7: ("Then Mary Ann has 1 200 apples and gives 5 of them to Bob who already owns 1 300 pears in his small garden", None),
    8: ("Dear John Anna has 15 apples and gives 7 kg of them to Old Uncle Carl who already owns 15 pears in his small garden", 3),
    9: (" ".join(LONG.split()[::-1]), None), 10: (" x ".join(LONG.split()), None)}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_contaminated_with_words_put_in_left_out_or_changed(spark, limit):
    bench = spark.createDataFrame([(1, LONG), (2, SHORT), (3, ITEM)], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, f"so it began {t} and went on") for k, (t, _) in CHANGED.items()], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench, broadcast_windows=limit).collect()}
    assert set(got) == {(k, i) for k, (_, i) in CHANGED.items() if i}
    assert got[1, 1].start == 3 and all(r.n_windows / 2 <= r.n_hits <= r.n_windows for r in got.values())


FEW = {1: "What is 12 + 7?", 2: "Paris Rome Oslo Bern Kiev Riga Baku Lima Cairo", 3: "1.5 2.5 3.5 4.5 5.5 6.5 7.5 8.5",
       4: "床前明月光疑是地上霜举头望明月", 5: "Yes"}
FOUND = {1: ("he asks what is 12 + 7 and waits", [1]), 2: ("what is 13 + 7", []), 3: ("In Paris, Rome, Oslo, Bern, Kiev, Riga, Baku, Lima, Cairo.", [2]),
         4: ("1.5 2.5 3.5 4.5 5.5 6.5 7.5 9.5", []), 5: ("table 1.5 2.5 3.5 4.5 5.5 6.5 7.5 8.5 9.5", [3]),
         6: ("诗云床前明月光，疑是地上霜。举头望明月，低头思故乡", [4]), 7: ("yes, we can", []), 8: ("YES!", [5]),
         9: ("1.5 2.5 3.5 4.5 5.5 6.5 and 2.5 3.5 4.5 5.5 6.5 7.5 8.5", [])}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_items_of_few_literals_are_found_verbatim(spark, limit):
    bench = spark.createDataFrame(list(FEW.items()), "item_id bigint, text string")
    docs = spark.createDataFrame([(k, t) for k, (t, _) in FOUND.items()], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, broadcast_windows=limit).collect()}
    assert got == {(k, i) for k, (_, items) in FOUND.items() for i in items}


def test_contaminated_against_brute_force(spark):
    shared = "which of the following is true about the text above and why is it so"
    items = [(i, t) for i, t in duckdb.sql(f"select item_id, text from '{TABLES}/benchmark.parquet'").fetchall()]
    items += [(10_000 + k, f"{shared} {w} one {w} two {w} three") for k, w in enumerate(("red", "green", "blue"))] + [(10_003, shared), (10_003, LONG)]
    docs = [(i, t) for i, t in duckdb.sql(f"select doc_id, text from '{TABLES}/documents.parquet'").fetchall()]
    docs += [(-k, f"{shared} {t}") for k, (_, t) in enumerate(items[:40], 1)] + [(-99, shared), (-98, items[-3][1]), (-97, LONG)]
    by_hash = {}
    for b in decontaminate.benchmark_windows(items, 8, 5, 4).itertuples():
        by_hash.setdefault((b.template, b.width, b.h), []).append(b)
    sizes = sorted({k[:2] for k in by_hash})
    want = set()
    for doc, text in docs:
        t = decontaminate.templates(decontaminate.Words(pa.array([text], pa.string())))
        hits = {}
        for name, size in sizes:
            got, at = decontaminate.windows(t.of[name].hashes, t.of[name].offsets, size, decontaminate._SEED[name])
            for h, place in zip(got.view("int64").tolist(), at.tolist()):
                if name == "exact" and size < 3 and len(t.of[name].hashes) != size:
                    continue
                for b in by_hash.get((name, size, h), ()):
                    slots = t.slots(place, size, name)
                    if len(slots) == len(b.item_slots):
                        one = {"at": b.at, "place": place, "pos": 0, "item_pos": 0, "slots": slots, "item_slots": b.item_slots}
                        band = (place - b.at) // max(4, math.ceil(0.25 * b.n_windows))
                        for x in (band, band - 1):
                            hits.setdefault((b.item_id, name, b.n_windows, x), []).append(one)
        want |= {(doc, item) for (item, name, n, _), found in hits.items()
                 if decontaminate._best(found, n if name == "exact" else n / 2, name == "exact")}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 40
    assert (-98, 10_002) in want and (-99, 10_003) in want and (-97, 10_003) in want


def test_two_people_do_not_become_one(spark):
    bench = spark.createDataFrame([(1, "last week Anna lent her old bike to Bob and walked home")], "item_id bigint, text string")
    texts = [f"so last week {a} lent her old bike to {b} and walked home again" for a, b in (("Mia", "Tom"), ("Mia", "Mia"), ("Bob", "Anna"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == {0, 2}


def test_repeated_item_in_an_unspaced_text(spark):
    item = "床前明月光疑是地上霜举头望明月低头思故乡一二三共九人走了五里路看见七只鸟"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, (item + "9") * 3000), (2, "霜" * 100_000)], "doc_id bigint, text string")
    begun = time.monotonic()
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1)]
    assert time.monotonic() - begun < 60


def test_contaminated_empty(spark, bench):
    docs = spark.createDataFrame([(1, OTHER)], "doc_id bigint, text string")
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


# --- main text

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("no markup  at\n all", "no markup at all"),
    ("<p>a &amp; b&nbsp;c &lt;d&gt; &eacute; &#233; &unknown; &am", "a & b c <d> é é &unknown; &am"),
    ("<nav>menu</nav><article><h1>T</h1><p>one<br>two<p>three <b>bold <i>x</b></article><footer>f</footer>", "T\none two\nthree bold x"),
    ("<body><div>left</div><main><p>m</p><aside>no</aside></main></body>", "m"),
    ("<script>var t='</p>';</script><style>p{}</style><p>x<!-- c <p>no</p> --> y", "x y"),
    ("<article><header><h1>Head</h1></header><p>p</p><section class='comments'><p>c</p></section><div class=ad>a</div></article>", "Head\np"),
    ("<header>site</header><div class='cookie-notice'>n</div><form>f<input></form><p>p", "p"),
    ("<body class='has-sidebar'><p>p</p></body>", "p"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<div hidden>h</div><p>p</p><p title='a>b'>q</p><div", "p\nq"), ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"), ("<article><article class=comment><p>c</p></article><p>p</p></article>", "p"),
    ("<p>" + "<div>" * 50_000 + "deep", "deep"), ("<article>" + "<p>w</p>" * 3000 + "</article>", "\n".join(["w"] * 3000))])
def test_main_text_of_one_page(page, text):
    assert site_tree.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ('<p title="a hidden gem">text</p>', "text"), ('<p data-id="ad">a</p><div data-widget-id="menu">b</div>', "a\nb"),
    ("<p title='class=\"ad\"'>a</p><p data-x=id id=ad>b</p><p id=x id=ad>c</p><p alt=\"x\"class=ad>d</p>", "a\nc"),
    ("<main><h1>Title</h1><article>body</article><p>tail</p></main><p>no</p>", "Title\nbody\ntail"),
    ("<p>main text</p><article>teaser</article>", "main text\nteaser"),
    ('<article><div class="search-engines">a</div><p class="notice-period">b</p><div class="share-buttons">c</div></article>', "a\nb"),
    ('<p>one <a class="share">no</a> two <button>no</button>three</p>', "one two three"),
    ('<p>one <span class="ad">no<div>no</div></p><p>two</p>', "one\ntwo"), ("<p>one <a class=share>no</p><p>two", "one\ntwo"),
    ('<div style="color:red; display : none">no</div><p style="display:block">p</p><article hidden>no</article>', "p"),
    ("<p>" + "<a class=share>" * 20_000 + "no", ""), (f"<p class='{'x ' * 200_000}ad'>no</p><p>p", "p")])
def test_names_are_read_from_attributes_alone(page, text):
    assert site_tree.main_text(page) == text


def test_site_tree_decides_on_doubtful_names_and_rare_blocks(spark):
    r = random.Random(5)

    def words(n):
        return " ".join(str(r.random()) for _ in range(n))

    def page(i):
        doubtful = "".join(f"<div class='{c}'>{t}</div>" for c, t in
                           (("notice-strip", f"Open {i % 3}"), ("notice-period", words(6))))
        rare = "<div class=corner>Ask our experts</div>" if i < 12 else ""
        return f"<div class=story><p>{words(20)}</p></div>{doubtful}{rare}"

    n = 1500  # the corner is on fewer than a hundredth of the pages
    rows = [(i, "http://h.org/", page(i)) for i in range(n)] + [(n, "http://few.org/", page(0))]
    got = {x.page_id: x for x in site_tree.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == n + 1
    for i in range(n):
        assert got[i].text.count("\n") == 1 and "Open" not in got[i].text and "experts" not in got[i].text
    assert "Open" in got[n].text and "experts" in got[n].text  # a host of one page


def test_importance_of_style_nodes_against_brute_force(spark):
    r = random.Random(3)
    pages = []
    for i in range(60):
        item = "".join(f"<li>{r.choice('abc')}</li>" for _ in range(r.randrange(4)))
        pages.append(f"<div class=top>{r.choice(['x', 'x', 'y'])}</div><div class=body><p>{r.random()} {r.random()}</p><ul>{item}</ul></div>")
    parsed = [site_tree.parse(p) for p in pages]
    classes = site_tree.page_classes(["\n".join(b[3] for b in blocks) for blocks, *_ in parsed])
    texts, styles, on, below = {}, {}, {}, {}
    for (blocks, shown, _), c in zip(parsed, classes):
        live = {n for b in blocks for n in b[0]}
        for path, _, _, text in blocks:
            texts.setdefault(path[-1], {}).setdefault(text, set()).add(c)
            for n in path:
                below.setdefault(n, set()).add(path[-1])
        for n in live:
            on.setdefault(n, set()).add(c)
        for n, s in shown:
            if n in live:
                styles.setdefault(n, {}).setdefault(s, set()).add(c)
    want = {}
    for n in on:
        base = math.log(max(len(on[n]), 2))
        content = [1 - math.log(len(cs)) / math.log(max(len(on[t]), 2)) for t in below[n] for cs in texts[t].values()]
        content = sum(content) / len(content)
        sizes = [len(cs) for cs in styles[n].values()]
        shown = sum(sizes)
        varied = -sum(k / shown * math.log(k / shown) for k in sizes) / math.log(max(shown, 2))
        w = 0.9 ** len(sizes)
        want[n] = (len(on[n]), content if len(sizes) == 1 else (1 - w) * varied + w * content)
    df = spark.createDataFrame([(1, p) for p in pages], "host bigint, html string")
    got = {x.node: (x.pages, x.importance) for x in site_tree.node_importance(df).collect()}
    assert got.keys() == want.keys()
    for n, (k, importance) in want.items():
        assert got[n][0] == k and got[n][1] == pytest.approx(importance, abs=1e-9)


def test_site_tree_cuts_what_a_host_repeats(spark):
    r = random.Random(2)

    def page(i):
        body = "".join(f"<p>{' '.join(str(r.random()) for _ in range(5))}</p>" for _ in range(1 + i % 4))
        return f"<div class=x1>Welcome to the site</div><div class=story>{body}<p>common passage</p></div><div class=x2>{i % 2} seen</div>"

    rows = [(i, "http://h.org/a", page(i), i) for i in range(40)] + [(100 + i, "http://one.org/", page(i), 0) for i in range(2)]
    rows += [(200 + i, "http://same.org", "<div class=s>always this</div>", 0) for i in range(20)]
    rows += [(300, None, "<p>n</p>", 0), (301, "nohost", None, 0), (300, None, "<p>n</p>", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    out = site_tree.extract_main_text(df)
    assert out.columns == ["page_id", "url", "html", "host", "text", "n_chars"] and out.count() == len(rows)
    got = {r.page_id: r for r in out.collect()}
    for i in range(40):
        assert got[i].text.endswith("common passage") and "Welcome" not in got[i].text and "seen" not in got[i].text and got[i].host == i
        assert got[i].n_chars == len(got[i].text) and got[i].text.count("\n") == 1 + i % 4
    assert "Welcome" in got[100].text  # too few pages to tell
    assert got[205].text == "always this" and got[300].text == "n" and got[301].text == ""
    assert site_tree.extract_main_text(df.limit(0)).count() == 0


def test_site_tree_keeps_what_only_copies_of_an_article_have(spark):
    r = random.Random(3)

    def words(n):
        return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))

    def page(title, body):
        return f"<div class=top>Welcome to the site</div><h1>{title}</h1>{body}"

    copied = f"<p>{words(150)}</p><ul><li>{words(30)}</li><li>{words(30)}</li></ul><blockquote>{words(40)}</blockquote>"
    rows = [(i, "http://h.org/a", page(words(4), f"<p>{words(60)}</p>")) for i in range(60)]
    rows += [(100 + i, "http://h.org/c", page("Title", copied)) for i in range(10)]  # copies among other articles
    rows += [(200 + i, "http://near.org/", page(words(3), copied)) for i in range(300)]  # nothing but near copies
    got = {x.page_id: x.text for x in site_tree.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    own = site_tree.main_text(copied)
    assert all(own in got[i] for i in [*range(100, 110), *range(200, 500)])
    assert not any("Welcome" in got[i] for i in [*range(60), *range(100, 110)])


# --- nearest neighbours

def exact(ids, x, k):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 100 == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if j != i][:k]
            out[ids[i]] = [(ids[j], d[j]) for j in order]
    return out


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((12, 24))
    x = (centres[r.integers(0, 12, 3000)] + 0.5 * r.standard_normal((3000, 24))).astype("float32")
    x[500:900] = x[500]  # a common vector
    ids = r.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, node int")
    rows = nn_descent.nearest(df, lambda c: c % 100 == 0).collect()
    want, hits, got = exact(ids, x.astype("float64"), 10), 0, {}
    for row in rows:
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
        assert all(abs(f[2] - np.linalg.norm(x[ids == q][0].astype("float64") - x[ids == f[1]][0])) < 1e-9 for f in found)
    assert hits / (10 * len(got)) >= 0.9
    common = [q for q in got if (x[ids == q][0] == x[500]).all()]
    for q in common:  # all at distance 0: the smallest ids
        assert [f[1] for f in sorted(got[q])] == [w[0] for w in want[q]]


def test_few_and_broken_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [1.0]), (100, [1.0, 0.0]), (None, [1.0, 2.0]), (1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nn_descent.nearest(df, lambda c: c % 100 == 0).collect()]
    assert sorted(got) == [(0, 1, 100, 0.0), (0, 2, 2, 1.0), (0, 3, 1, 1.414214), (100, 1, 0, 0.0), (100, 2, 2, 1.0), (100, 3, 1, 1.414214)]
    assert nn_descent.nearest(df.limit(0), lambda c: c % 100 == 0).count() == 0
    assert nn_descent.nearest(df.where("vec_id = 0"), lambda c: c % 100 == 0).count() == 0


# --- the pipeline

NOISE = "".join(np.random.default_rng(8).choice(list("abcdefghijklmnopqrstuvwxyz     "), 600))
POLISH = ("Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach. Są obdarzeni rozumem i sumieniem "
          "i powinni postępować wobec innych w duchu braterstwa.")

def test_pipeline_stages(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = base.orderBy("doc_id").first()
    extra = [(10**6, first.text, first.lang, first.source, first.n_chars), (10**6 + 1, None, "en", "src0", 0), (10**6 + 2, "1 2 3", None, None, 5),
             (10**6 + 3, "", "de", "src1", 0), (10**6 + 4, NOISE, None, "src0", len(NOISE)), (10**6 + 5, POLISH, None, "src0", len(POLISH)),
             (10**6 + 6, "xylophone", None, "src0", 9)]
    docs = base.union(spark.createDataFrame(extra, base.schema))
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    left, df = [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, sf).write.parquet(f"{sf}/{name}")
        df = spark.read.parquet(f"{sf}/{name}")
        left.append(df)
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in left]
    assert all(x.columns == docs.columns for x in left[:4])
    assert ids[0] == {r.doc_id for r in base.collect()} | {10**6, 10**6 + 6}  # nothing clean goes, nor a word too short to judge
    assert 10**6 not in ids[1] and first.doc_id in ids[1]
    leaks = {r.doc_id for r in decontaminate.contaminated(left[1], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids[2] == ids[1] - leaks and left[3].count() == left[4].count()
    total = left[4].agg(F.sum("n_tokens")).first()[0]
    assert total == left[4].agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
