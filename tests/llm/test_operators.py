"""Each operator against brute force on a small table, and on awkward rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlspan.llm import common, embedding_dedup, exact_dedup, html_extract, language_id, line_dedup, mixing, ngram_jaccard, packing, queries, sharding, stupid_backoff
from marlspan.llm.word_hash import hashed_words, token_sets
from oracle import check, connection

Q = queries.LLM_QUERIES


@pytest.fixture(scope="module")
def documents(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")


def words(text):
    return (text or "").encode().lower().split()


def test_op1_held_out_accuracy(spark, sf, documents):
    got = Q["op1_word_backoff_language"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(documents)
    held = pd.Series({i: zlib.crc32(str(i).encode()) % 5 == 0 for i in documents.index})
    assert (got["held_out"] == held.reindex(got.index)).all()
    assert (got["lang_pred"] == documents["lang"].reindex(got.index))[got["held_out"]].mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_op1_model_backs_off(spark):
    docs = spark.createDataFrame([("the thing that thinks", "en"), ("der dass das denn", "de")] * 5, "text string, lang string")
    model = language_id.train(docs)
    s = language_id.Scorer(model)
    assert s.predict("thinking")[0] == "en" and "thinking" not in model.words
    assert s.predict(None) == ("und", 0.0) and s.predict("12 34 !") == ("und", 0.0)


def test_op1_odd(odd, empty):
    model = language_id.train(odd.select("text", "lang"))
    got = language_id.predict(odd, model).collect()
    assert len(got) == 10 and {r["lang_pred"] for r in got if not (r["text"] or "").strip()} == {"und"}
    nothing = language_id.train(empty.select("text", "lang"))
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


PAGES = {
    None: "", "": "", "<p>hi": "hi", "a &lt; b": "a < b",
    "<html><head><title>T</title><script>x('</p>')</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy this now please.</div>"
    "<article><h1>Head</h1><p><b>One one one one.<br><p>Two\n two &amp; two.</p></article><div class=comments><p>nice post, really long comment here</p></div><footer>&copy; me</footer>":
        "Head\nOne one one one.\nTwo two & two.",
    "<body><div id=sidebar>links links links</div><div><h2>Title</h2><div><p>" + "</p><p>".join(f"Para {i}, with some more words in it, as usual." for i in range(4)) + "</p></div></div></body>":
        "Title\n" + "\n".join(f"Para {i}, with some more words in it, as usual." for i in range(4)),
}


@pytest.mark.parametrize("page", list(PAGES), ids=range(len(PAGES)))
def test_op2_pages(page):
    assert html_extract.extract_text(page) == PAGES[page]


def test_op1_scores_match_brute_force(spark, sf, documents):
    """Counts, smoothing and back-off written out again over plain dictionaries."""
    texts = {i: documents["text"][i] for i in list(documents.index)[:60]}
    langs = sorted(set(documents["lang"].dropna()))
    counts = collections.defaultdict(collections.Counter)
    for i, t in texts.items():
        if t and documents["lang"][i]:
            counts[documents["lang"][i]].update(re.findall(r"[^\W\d_]+", t.lower()))
    grams = collections.defaultdict(collections.Counter)
    for x, c in counts.items():
        for w, k in c.items():
            for n in range(1, 5):
                for at in range(len(w) + 3 - n):
                    grams[x][f"_{w}_"[at:at + n]] += k

    def logs(table, floor):
        items = [w for w in set().union(*table.values()) if sum(table[x][w] for x in langs) >= floor and len(w) <= 40]
        total = {x: sum(table[x][w] for w in items) for x in langs}
        return {w: [math.log(table[x][w] + 0.1) - math.log(total[x] + 0.1 * len(items)) for x in langs] for w in items}

    known, parts = logs(counts, 2), logs(grams, 3)
    rows = [(i, t) for i, t in documents["text"].items() if i not in texts][:60]
    model = language_id.train(spark.createDataFrame([(t, documents["lang"][i]) for i, t in texts.items()], "text string, lang string"))
    for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        total, found = [0.0] * len(langs), re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        for w in found:
            got = [known[w]] if w in known else []
            for at in range(0 if w in known else len(w) + 2):
                got += next(([parts[g]] for n in range(4, 0, -1) if at + n <= len(w) + 2 and (g := f"_{w}_"[at:at + n]) in parts), [])
            total = [a + sum(g[k] for g in got) / max(1, len(got)) for k, a in enumerate(total)]
        if found:
            odds = [math.exp((a - max(total)) / len(found)) for a in total]
            assert r["lang_pred"] == langs[odds.index(max(odds))] and r["score"] == pytest.approx(max(odds) / sum(odds), rel=1e-9)
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_op1_clashing_columns_and_texts_without_letters(spark, odd):
    model = language_id.train(odd.select("text", "lang"))
    df = spark.createDataFrame([("² ½", "was", 5, "k"), ("the dog", None, None, None)], "text string, lang_pred string, Score int, lang string")
    got = language_id.predict(df, model)
    assert got.columns == ["text", "lang", "lang_pred", "score"]
    assert {r["text"]: r["lang_pred"] == "und" for r in got.collect()} == {"² ½": True, "the dog": False}


def test_op2_broken_markup_ends():
    for bad in ("<p title=\"unclosed>q</p> more", "<" * 2000, "<div>" * 300 + "deep", "</p></div>stray", "<!-- open", "<script>never ends"):
        html_extract.extract_text(bad)


def test_op2_long_and_deep_pages():
    """Time grows with the length of a page, however deep it is; nothing is cut."""
    import time

    def took(page):
        began = time.perf_counter()
        html_extract.extract_text(page)
        return time.perf_counter() - began

    for make in (lambda n: "<div>" * n + "deep text" + "</em>" * n, lambda n: "<div>" * n + "<header>x" * n, lambda n: "<p>" + "<b>" * n + "<div>a</div>" * n,
                 lambda n: "<ul><li>" + "<div>" * n + "<li>item" * n, lambda n: "<article>" + "<p>some words here</p>" * n):
        took(make(200))
        small, large = min(took(make(1000)) for _ in range(3)), min(took(make(8000)) for _ in range(2))
        assert large < 40 * small + 0.2
    body = "<article>" + "".join(f"<p>Paragraph {i} has a few words of its own.</p>" for i in range(20_000)) + "</article>"
    assert len(html_extract.extract_text(body).split("\n")) == 20_000


def plain_densities(root, flow):
    """Counts of every element from the spans of the page, and the densities by their formula."""
    def live(n):
        return n is None or not n.dead and live(n.parent)

    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        nodes.append(n)
        todo += [k for k in n.kids if not k.dead]
    under = {id(n): [] for n in nodes}
    for n in nodes:
        up = n.parent
        while up is not None:
            under[id(up)].append(n)
            up = up.parent
    text = collections.Counter()
    for n, t in flow:
        if t and not n.dead:
            text[id(n)] += len(t.strip())
    chars = {id(n): sum(text[id(k)] for k in [n, *under[id(n)]]) for n in nodes}
    outer_links = {id(n): [k for k in [n, *under[id(n)]] if k.tag == "a"] for n in nodes}
    share = sum(chars[id(k)] for k in outer_links[id(root)]) / (chars[id(root)] or 1)
    out = {}
    for n in nodes:
        c, t = chars[id(n)], len(under[id(n)]) or 1
        linked = sum(chars[id(k)] for k in outer_links[id(n)])
        if c:
            base = math.log(c / ((c - linked) or 1) * linked + share * c + math.e)
            out[id(n)] = c / t * math.log(max(c / (linked or 1) * t / (len(outer_links[id(n)]) or 1), 1.0)) / max(math.log(base), 0.25)
    return nodes, {id(n): out.get(id(n), 0.0) for n in nodes}


def test_op2_densities_match_brute_force(sf):
    pages = pd.read_parquet(sf.replace("sf0.001", "sf0.01") + "/pages.parquet")["html"].tolist()
    for page in pages:
        root, flow = html_extract._parse(page)
        order = html_extract._densities(root, flow)
        nodes, density = plain_densities(root, flow)
        assert {id(n) for n in order} == {id(n) for n in nodes}
        gathered = {id(n): sum(density[id(k)] for k in n.kids if not k.dead and k.tag not in html_extract.INLINE) for n in nodes}
        for n in order:
            assert n.density == pytest.approx(density[id(n)], rel=1e-9) and n.gathered == pytest.approx(gathered[id(n)], rel=1e-9)
        chosen, threshold = html_extract._content(root, order)
        assert gathered[id(chosen[0])] == pytest.approx(max(gathered.values()), rel=1e-9)
        # the article of the driver's pages, found without its name
        assert chosen[0].tag == "article" and threshold <= density[id(chosen[0])]


def test_op2_density_decides_without_names():
    prose = "".join(f"<p>Sentence {i} of the story, with enough words to be prose and not a label.</p>" for i in range(6))
    links = "".join(f"<li><a href=/{i}>Go to page {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Story</h2><div>{prose}</div></div><div><a href=x>More</a> <a href=y>Less</a></div></body>"
    got = html_extract.extract_text(page).split("\n")
    assert got[0] == "Story" and len(got) == 7 and all(x.startswith("Sentence") for x in got[1:])
    # a name that only hints keeps prose and loses links
    page = f"<body><article>{prose}<div class='reviews'>{prose}</div><div class='related'><ul>{links}</ul></div><div class='comments'>{prose}</div><fieldset><p>Kept words stand here, as prose does.</p></fieldset></article></body>"
    got = html_extract.extract_text(page).split("\n")
    assert len(got) == 13 and got[-1].startswith("Kept")


def test_op2_whole_table(spark, sf):
    got = Q["op2_text_density_html"](spark, sf).toPandas()
    raw = pd.read_parquet(f"{sf}/pages.parquet").set_index("page_id")["html"]
    assert len(got) == len(raw) and (got["n_chars"] == got["text"].map(len)).all()
    for i, text in zip(got["page_id"], got["text"]):
        assert text.split("\n")[0] and "track(" not in text and "<p>" not in text and "<article>" in raw[i]


def test_op2_odd(spark):
    df = spark.createDataFrame([(1, "u", None, "old"), (1, "u", None, "old"), (None, None, "<p>x", None)], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html_extract.extract(df).collect()) == ["", "", "x"]
    assert html_extract.extract(df.limit(0)).count() == 0


def brute_components(texts, n=5, percent=80):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op3_matches_brute_force(spark, sf, documents):
    got = Q["op3_token_group_jaccard"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(documents["text"].to_dict())


def test_op3_matches_sql(spark, sf):
    check(Q["op3_token_group_jaccard"](spark, sf), connection(sf), queries.OP3_SQL)


def test_slices_number_their_rows_from_zero():
    got = list(common.slices(iter([pd.DataFrame({"x": range(5)}), pd.DataFrame({"x": []})]), 2))
    assert [g["x"].tolist() for g in got] == [[0, 1], [2, 3], [4]]
    assert all(g.index.tolist() == list(range(len(g))) for g in got)


def test_op3_batches_longer_than_a_slice(spark):
    n, conf = 2 * ngram_jaccard.SLICE_ROWS + 1, "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(n).coalesce(1).selectExpr("id AS doc_id", "concat('a b c d ', cast(id div 2 AS string)) AS text")
    before = spark.conf.get(conf)
    spark.conf.set(conf, "10000")
    try:
        got = ngram_jaccard.near_components(docs).toPandas()
    finally:
        spark.conf.set(conf, before)
    assert len(got) == n and (got["component"] == got["id"] // 2 * 2).all()


def test_op3_dense_group(spark):
    """Near copies of one text, linked pairwise only in part."""
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(80):
        w = list(base)
        for k in r.choice(150, int(r.integers(0, 9)), replace=False):
            w[k] = f"m{i}_{k}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = ngram_jaccard.near_components(df).collect()
    assert {x["id"]: (x["size"], x["component"]) for x in got} == brute_components(texts)


def test_op3_odd(odd, empty):
    got = ngram_jaccard.near_components(odd).collect()
    assert len(got) == 10
    by = {r["id"]: r["component"] for r in got}
    assert by[1] == by[5] == by[8] == 1 and by[2] == 2 and by[3] == 3 and by[6] == 6
    assert ngram_jaccard.near_components(empty).count() == 0
    left = ngram_jaccard.drop_near_copies(odd).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"]) == [1, 2, 3, 4, 6, 7]


def test_near_copies_go_by_row_not_by_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (None, b), (None, c), (None, a), (7, a + " d"), (9, b + " e"), (9, "z " * 9), (9, c + " f g h"), (9, c.upper()), (None, ""), (None, None), (9, "y x")]
    left = ngram_jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = collections.Counter((r["doc_id"], r["text"]) for r in left)
    assert got[(7, a + " d")] == got[(9, b + " e")] == got[(9, "z " * 9)] == got[(9, "y x")] == got[(None, "")] == got[(None, None)] == 1
    assert got[(9, c + " f g h")] + got[(9, c.upper())] == 1 and sum(got.values()) == 7
    unlike = spark.createDataFrame([(i, x) for i in (None, 5) for x in (a, b + " e", c + " " + a)] + [(None, "x " + b), (5, "")], "doc_id long, text string")
    left = collections.Counter((r["doc_id"], r["text"]) for r in ngram_jaccard.drop_near_copies(unlike).collect())
    assert left == collections.Counter([(5, a), (5, b + " e"), (5, c + " " + a), (5, "")])
    alone = spark.createDataFrame([(None, a), (None, b), (None, c), (None, ""), (3, "p q r s t u v"), (3, "k l m n o p q")], "doc_id long, text string")
    assert ngram_jaccard.drop_near_copies(alone).count() == 6


def test_word_hashes_follow_the_words():
    texts = ["A b\tc", None, "", " x ", "a B c d e f", "é É"]
    got = list(hashed_words(texts))
    assert np.concatenate([c for _, c in got]).tolist() == [3, 0, 0, 1, 6, 2]
    h = np.concatenate([w for w, _ in got])
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 9
    sets = list(token_sets(texts, 5))
    assert [len(s) for s in sets] == [1, 0, 0, 1, 2, 1]


@pytest.mark.parametrize("k", range(1, 7))
def test_token_sets_of_a_single_short_text(k):
    text = " ".join("abcdef"[:k])
    (own,), (beside, _) = token_sets([text], 5), token_sets([text, "one two three four five six"], 5)
    assert len(own) == max(1, k - 4) and own.tolist() == beside.tolist()


def test_op4_law(spark, sf, documents):
    got = Q["op4_entropy_mixing"](spark, sf).toPandas().set_index("doc_id")
    size = documents["text"].map(lambda t: len(words(t)))
    assert (got["size"] == size.reindex(got.index)).all() and (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    per = size.groupby(documents["source"]).sum()
    order = sorted(per.index)
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * per.sum()
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 2 * per[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * per[s]
            rest -= target[s]
        open_ -= over
    source = documents["source"].reindex(got.index)
    assert np.allclose(got["target"], source.map(target))
    taken = got["taken"].groupby(source).sum()
    for s in order:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], size[documents["source"] == s].min())
    again = Q["op4_entropy_mixing"](spark, sf).toPandas().set_index("doc_id")
    assert (again["taken"].reindex(got.index) == got["taken"]).all()


def test_op4_two_margins(spark):
    cells = spark.createDataFrame([("a", "x", 100.0), ("a", "y", 50.0), ("b", "x", 80.0), ("b", "y", 120.0)], "s string, l string, tokens double")
    want = {"s": spark.createDataFrame([("a", 100.0), ("b", 200.0)], "s string, target double"), "l": spark.createDataFrame([("x", 150.0), ("y", 150.0)], "l string, target double")}
    got = mixing.balance(cells, ["s", "l"], want, steps=30, tolerance=1e-6).toPandas()
    taken = got["tokens"] * got["rate"]
    assert taken.groupby(got["s"]).sum().tolist() == pytest.approx([100, 200], rel=1e-3)
    assert taken.groupby(got["l"]).sum().tolist() == pytest.approx([150, 150], rel=1e-3)


def test_op4_odd(odd, empty):
    got = mixing.entropy_mix(odd, [3.0, 1.0, 2.0]).collect()
    assert len(got) == 10 and all(r["copies"] == 0 for r in got if r["size"] == 0)
    same = odd.sparkSession.range(6000).selectExpr("cast(null AS long) AS doc_id", "'a b c' AS text", "'s' AS source")
    mixed = mixing.entropy_mix(same, [1.0], share=1.5).toPandas()
    assert mixed["block"].value_counts().max() < 2.5 * 6000 / 3 if "block" in mixed else abs(mixed["copies"].sum() - 9000) <= 3
    assert mixing.entropy_mix(empty, [3.0, 1.0]).count() == 0


def test_op5_matches_brute_force(spark, sf, documents):
    got = stupid_backoff.backoff_scores(common.table(spark, sf, "documents"), batch_chars=60_000, partition_chars=50_000, order=2).toPandas().set_index("id")
    w = {i: words(t) for i, t in documents["text"].items()}
    one, two = collections.Counter(), collections.Counter()
    for x in w.values():
        one.update(x)
        two.update(zip([None, *x], x))
    total, starts = sum(map(len, w.values())), sum(1 for x in w.values() if x)
    for i, x in w.items():
        o1, o2, s, b = collections.Counter(x), collections.Counter(zip([None, *x], x)), 0.0, 0
        for v, y in zip([None, *x], x):
            n = two[v, y] - o2[v, y]
            b += n <= 0
            s += math.log(n / max(1, starts - 1 if v is None else one[v] - o1[v])) if n > 0 else math.log(0.4 * max(1, one[y] - o1[y]) / max(1, total - len(x)))
        assert got.loc[i, "n_words"] == len(x) and got.loc[i, "n_backed_off"] == b
        assert got.loc[i, "log_score"] == pytest.approx(s, rel=1e-9)


def test_op5_trigrams_match_brute_force(spark, sf, documents):
    got = Q["op5_stupid_backoff"](spark, sf).toPandas().set_index("doc_id")
    small = stupid_backoff.backoff_scores(common.table(spark, sf, "documents"), batch_chars=60_000, partition_chars=50_000, order=3).toPandas().set_index("id")
    w = {i: words(t) for i, t in documents["text"].items()}

    def count(x):
        p = [None, None, *x]
        return [collections.Counter(tuple(p[k - j:k + 1]) for k in range(2, len(p))) for j in range(3)]

    every = [sum(c, collections.Counter()) for c in zip(*map(count, w.values()))]
    total, docs = sum(map(len, w.values())), sum(1 for x in w.values() if x)
    for i, x in w.items():
        own, p, s, b = count(x), [None, None, *x], 0.0, 0
        for k in range(2, len(p)):
            for j in (2, 1, 0):
                gram = tuple(p[k - j:k + 1])
                n = every[j][gram] - own[j][gram]
                if j == 0:
                    s += math.log(0.4 ** 2 * max(1, n) / max(1, total - len(x)))
                elif n > 0:
                    before = docs - 1 if gram[-2] is None else every[j - 1][gram[:-1]] - own[j - 1][gram[:-1]]
                    s += math.log(0.4 ** (2 - j) * n / before)
                    break
                b += j == 2
        for found in (got, small):
            assert (found.loc[i, "n_words"], found.loc[i, "n_backed_off"]) == (len(x), b)
            assert found.loc[i, "log_score"] == pytest.approx(s, rel=1e-9, abs=6e-7)  # the query rounds


def test_op5_matches_sql(spark, sf):
    check(Q["op5_stupid_backoff"](spark, sf), connection(sf), queries.OP5_SQL)


def test_op5_equal_rows_are_spread(spark):
    docs = spark.range(2000).selectExpr("cast(null AS long) AS doc_id", "'a b c d e' AS text").unionByName(spark.createDataFrame([(1, "a b x")], "doc_id long, text string"))
    got = stupid_backoff.backoff_scores(docs, batch_chars=500, partition_chars=500).toPandas()
    assert len(got) == 2001 and got[got["id"].isna()]["log_score"].nunique() == 1 and got[got["id"] == 1]["n_backed_off"].tolist() == [1]


def test_op5_odd(odd, empty):
    got = stupid_backoff.backoff_scores(odd).collect()
    assert len(got) == 10 and all((r["score"] is None) == (r["n_words"] == 0) for r in got)
    assert stupid_backoff.backoff_scores(empty).count() == 0


def test_op6_matches_sql(spark, sf):
    check(Q["op6_exact_dedup"](spark, sf), connection(sf), queries.OP6_SQL)


def test_op6_odd(odd, empty):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == 10 and sum(r["kept"] for r in got) == len({r["digest"] for r in got})
    kept = {r["id"] for r in got if r["kept"]}
    assert 6 in kept and 2 not in kept and 3 not in kept  # of empty ones, two blanks are the longest
    assert {r["digest"] for r in got if r["id"] == 3} == {hashlib.sha256(b"").hexdigest()}
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_copies(odd).count() == sum(r["kept"] for r in got)


def test_op6_rounds_agree(spark, sf):
    docs = common.table(spark, sf, "documents")
    one = exact_dedup.exact_groups(docs, leaves=1).select("id", "keep", "group_size", "kept")
    many = exact_dedup.exact_groups(docs, leaves=13, fan_in=2).select("id", "keep", "group_size", "kept")
    assert one.exceptAll(many).count() == 0


def brute_passages(texts, units, min_words=line_dedup.MIN_WORDS):
    """Removals of ``units`` (lists of spans by text): those between the ends of
    a chain of neighbouring repeated units that holds ``min_words`` words of one
    earlier stretch."""
    first, want = {}, set()
    for i in sorted(texts):
        norm = [" ".join(w.decode() for w in words(texts[i][a:b])) for a, b in units[i]]
        where = []
        for k, x in enumerate(norm):
            first.setdefault(x, (i, k))
            where.append(first[x] if first[x] != (i, k) else None)
        k = 0
        while k < len(norm):
            if where[k] is None:
                k += 1
                continue
            end = k
            while end < len(norm) and where[end] is not None:
                end += 1
            for a in range(k, end):
                same = [c for c in range(k, end) if where[c][0] == where[a][0] and where[c][1] - c == where[a][1] - a]
                if sum(len(norm[c].split()) for c in same) >= min_words:
                    want |= {(i, c, *units[i][c], *where[c]) for c in range(same[0], same[-1] + 1)}
            k = end
    return want


def lines_of(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[^ \t-\r](?:[^\n]*[^ \t-\r])?", text)]


def found_spans(rows, key="id"):
    return {(r[key], r["unit"], r["start"], r["end"], r["keep_id" if key == "id" else "keep_doc_id"], r["keep_unit"]) for r in rows}


def test_op7_lines_match_brute_force(spark, sf, documents):
    texts = {i: t or "" for i, t in documents["text"].items()}
    got = line_dedup.repeated_units(common.table(spark, sf, "documents"), "line").collect()
    want = brute_passages(texts, {i: lines_of(t) for i, t in texts.items()})
    assert found_spans(got) == want and want


def test_op7_phrases_match_brute_force(spark, sf, documents):
    texts = {i: t or "" for i, t in documents["text"].items()}
    units = {}
    for i, t in texts.items():
        u = line_dedup.units_of([t], "phrase")
        units[i] = list(zip(u["start"], u["end"]))
        assert [w for a, b in units[i] for w in words(t[a:b])] == words(t) and u["n_words"].tolist() == [len(words(t[a:b])) for a, b in units[i]]
    got = Q["op7_line_hash_dedup"](spark, sf).collect()
    want = brute_passages(texts, units)
    assert found_spans(got, "doc_id") == want and want


def test_op7_passages_inside_lines(spark):
    """Passages of 51 words or more, at any place of a line, in other cases and wraps; nothing else."""
    r = np.random.default_rng(7)
    vocabulary = [f"{a}{b}" for a in "bcdfghklm" for b in ("a", "e", "ion", "ing", "able", "or", "en")]
    say = lambda n: " ".join(r.choice(vocabulary, n))
    passages = [say(int(r.integers(51, 90))) for _ in range(20)]
    rows = [(i, f"{say(70)} {passages[i % 20] if i < 20 else passages[i % 20].upper()} {say(50)}\n{say(30)}") for i in range(60)]
    rows += [(i, say(200)) for i in range(60, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = line_dedup.repeated_units(df, "phrase").toPandas()
    assert set(got["id"]) <= set(range(20, 60)) and len(set(got["id"])) >= 38
    texts = dict(rows)
    for _, x in got.iterrows():
        assert texts[x["id"]][x["start"]:x["end"]].lower() in passages[x["id"] % 20]
        assert x["n_words"] < 4 or x["keep_id"] == x["id"] % 20  # shorter units inside a passage may have occurred before by chance


def test_op7_passage_in_short_lines(spark):
    lines = [" ".join(f"p{i}w{k}" for k in range(9)) for i in range(6)]
    rows = [(1, "\n".join(["head of one", *lines])), (2, "\n".join(["of two", *lines[:3], "", *lines[3:], "tail"])), (3, f"{lines[0]}\nalone\n{lines[4]}"), (4, f"x\n{lines[1]}\n{lines[2]}\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"], r["unit"], r["keep_id"], r["keep_unit"]) for r in line_dedup.repeated_units(df).collect())
    assert got == [(2, u, 1, u) for u in range(1, 7)]
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeats(df).collect()}
    assert left == {**dict(rows), 2: "of two\n\ntail"}
    parts = spark.createDataFrame([(1, "\n \n".join(lines)), (2, "x\n\n" + "\n\n".join(lines))], "doc_id long, text string")
    assert line_dedup.repeated_units(parts, "paragraph").count() == 6


def test_op7_cut_and_odd(spark, odd, empty):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"head\n{line}\ntail", "a"), (2, f"{line.upper()}\nother", "b"), (3, None, "c"), (3, "", "d"), (None, f"{line}\nx", "e"), (None, f"y\n{line}", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumns({"cuts": F.lit(1), "_cuts": F.lit(2)})
    left = line_dedup.drop_repeats(df)
    assert left.columns == df.columns
    assert {r["row"]: r["text"] for r in left.collect()} == {"a": f"head\n{line}\ntail", "b": "other", "c": None, "d": "", "e": "x", "f": "y\n"}
    for unit in line_dedup.UNITS:
        assert line_dedup.drop_repeats(odd, unit, min_words=5).count() == 10
        assert line_dedup.repeated_units(empty, unit).count() == 0


def test_op7_hot_unit(spark, monkeypatch):
    """A line that most texts have goes by broadcast, the others by shuffle; the result is the same."""
    line = " ".join(f"h{i}" for i in range(30))
    df = spark.range(400).selectExpr("id AS doc_id", f"concat('{line}', chr(10), 'own ', id div 2, ' ', '{line[:-1]}') AS text")
    found = []
    for groups in (1 << 16, 1):
        monkeypatch.setattr(common, "HOT_GROUPS", groups)
        found.append(found_spans(line_dedup.repeated_units(df).collect()))
    assert found[0] == found[1] and len(found[0]) == 399 + 200


def test_op8_round_trip(spark, sf, documents):
    got = Q["op8_genetic_packing"](spark, sf).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    t.encode_special_tokens = True
    total = 0
    for i, g in got.groupby("doc_id"):
        ids = np.array([*t.encode(documents["text"][i] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        g = g.sort_values("piece")
        assert g["start"].tolist() == [2048 * k for k in range(-(-len(ids) // 2048))] and g["length"].sum() == len(ids)
        assert [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(g["start"], g["length"])] == g["ids_crc32"].tolist()
    assert set(got["doc_id"]) == set(documents.index)
    q = got.sort_values(["sequence_id", "offset"])
    assert ((q.groupby("sequence_id")["length"].cumsum() - q["length"]) == q["offset"]).all()
    fills = q.groupby("sequence_id")["length"].sum()
    assert fills.max() <= 2048 and len(fills) <= math.ceil(total / 2048 * 1.01) + 1


def test_op8_words_alone_give_the_ids_of_the_text():
    e = packing.WordEncoder(packing.vocabulary("word_bpe_49k.json"))
    odd = ["it's. 'S. a'll, É. İ. x.. . , .a a.b, ", "ñ̃. é. Σας. ΟΔΟΣ.  a. \x85b. ć, 3. ²., <|endoftext|> <|startoftext|>. a\tb.\r\nc.", "", "ﬁ. Ǆ, ٣. é ́"]
    for x, y in zip(odd, e.encode(odd)):
        assert np.frombuffer(y, "<u4").tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids


def test_op8_children_hold_every_item_once():
    import random

    sizes = [random.Random(1).randint(1, 60) for _ in range(200)]
    for bins, fill in packing.evolve(sizes, 100, [], "s", 4, 3):
        assert sorted(i for b in bins for i in b) == list(range(200)) and [sum(sizes[i] for i in b) for b in bins] == fill and max(fill) <= 100


def test_op8_children_beat_best_fit_decreasing():
    """Items of a fifth to a half of a sequence, where best-fit decreasing wastes room."""
    import random

    for seed in range(3):
        sizes = [random.Random(seed * 1000 + k).randint(410, 1024) for k in range(240)]
        plain: tuple = ([], [])
        packing.best_fit(sorted(range(240), key=lambda i: -sizes[i]), sizes, 2048, *plain)
        pool = packing.evolve(sizes, 2048, [], "s", packing.POPULATION, packing.GENERATIONS)
        assert len(pool[0][0]) < len(plain[0])
        for bins, fill in pool:
            assert sorted(i for b in bins for i in b) == list(range(240)) and [sum(sizes[i] for i in b) for b in bins] == fill and max(fill) <= 2048


def test_op8_full_pieces_of_late_rows(spark):
    pieces = spark.createDataFrame([(2**43 + k, 1, p, 64 * p, 64 if p < 3 else 5, 0) for k in range(4) for p in range(4)],
                                   "row long, id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(common.durable(pieces), 64).toPandas()
    fills = got.groupby("sequence_id")["length"].sum()
    assert len(got) == 16 and fills.max() <= 64 and len(fills) == 13


def test_op8_other_vocabularies_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    t = Tokenizer(models.BPE({"a": 0, "b": 1, " ": 2, "ab": 3, "a b": 4, "a ": 5}, [("a", "b"), ("a", " "), ("a ", "b")]))
    t.save(str(tmp_path / "t.json"))
    e = packing.WordEncoder(str(tmp_path / "t.json"))
    assert not e.by_word and np.frombuffer(e.encode(["a b", "ab"])[0], "<u4").tolist() == t.encode("a b").ids
    assert packing.encoder(packing.vocabulary("word_bpe_49k.json")).by_word


def test_op8_odd(odd, empty):
    got = packing.pack_documents(odd, capacity=64).collect()
    assert len({r["row"] for r in got}) == 10 and all(r["length"] <= 64 for r in got)
    assert packing.pack_documents(empty).count() == 0


def brute_links(vectors, threshold=0.95):
    ok = {i: np.asarray(v, float) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(np.asarray(v, float))}
    ids = sorted(ok)
    m = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    link = m @ m.T >= threshold
    np.fill_diagonal(link, False)
    return ids, link


def brute_classes(ids, link):
    """Components and direct links of the vectors ``ids``."""
    component = np.array(ids)
    while True:
        lower = np.minimum(component, np.where(link, component[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == component).all():
            return component
        component = lower


def test_op9_matches_brute_force(spark):
    r = np.random.default_rng(9)
    base = r.normal(size=(300, 32))
    rows = [(int(i), (base[i % 300] + 0.12 * r.normal(size=32) * (i >= 300)).tolist()) for i in range(900)]
    rows += [(900 + i, rows[5][1]) for i in range(20)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().set_index("id")
    ids, link = brute_links([(i, np.float32(v)) for i, v in rows])
    want = link.sum(axis=1)
    found = got["n_links"].reindex(ids).to_numpy()
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    right = got["component"].reindex(ids).to_numpy() == brute_classes(ids, link)
    assert right.mean() > 0.99 and (got["kept"] == (got.index == got["component"])).all()


@pytest.mark.parametrize("name", ["check_s", "check_h"])
def test_op9_recall_on_the_check_tables(spark, name):
    import os

    at = f"/root/testdata/{name}"
    if not os.path.isdir(at):
        pytest.skip("no such table here")
    got = Q["op9_pivot_permutation_dedup"](spark, at).toPandas().set_index("vec_id")
    raw = pd.read_parquet(f"{at}/embeddings.parquet")
    good = raw[raw["embedding"].map(lambda v: v is not None and np.isfinite(v).all() and np.any(v))]
    m = np.stack(good["embedding"]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = np.concatenate([(m[i:i + 1000] @ m.T >= 0.95).sum(axis=1) - 1 for i in range(0, len(m), 1000)])
    found = got["n_links"].reindex(good["vec_id"]).to_numpy()
    assert len(got) == len(raw) and (found <= want).all() and want.sum() > 0
    assert found.sum() >= 0.99 * want.sum()


def test_op9_tiles_agree(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=16)
    rows = [(int(i), int(1), (x + 0.1 * r.normal(size=16)).tolist()) for i in range(150)]
    reps = spark.createDataFrame(rows, "cls long, n long, vec array<double>")
    a, b = (embedding_dedup.near_links(reps, 0.95, tile=t).where("a = b").groupBy("a").agg(F.sum("links")) for t in (1024, 20))
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0
    assert embedding_dedup.near_links(reps, 0.95).where("a <> b").count() < 150


def test_op9_odd(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (1, v, 1), (2, None, 1), (3, [], None), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 2.0], 1), (6, [1.0, float("nan"), 2.0], 1),
            (7, [2.0, 4.0, 6.0], 1), (None, v, 1), (8, [1.0, 2.0], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    by = {}
    for x in got:
        by.setdefault(x["id"], []).append((x["n_links"], x["component"], x["kept"]))
    assert len(got) == 10 and by[1] == [(3, 1, True)] * 2 and by[7] == [(3, 1, False)] and by[2] == [(0, 2, True)] and by[None] == [(3, 1, False)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op9_magnitudes_and_null_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1e200, 1e180, 0.0]), (3, [1e-200, 0.0, 0.0]), (4, [0.0, 5e-324, 0.0]), (5, [0.0, 1.7e308, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 2.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got if r["id"]) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False)]
    assert [tuple(r) for r in got if r["id"] is None] == [(None, 1, None, False)] * 2


@pytest.mark.parametrize("given", ['style="overflow:hidden"', 'title="the hidden truth"', 'data-role="navigation"', 'data-hidden="false"', "data-id='menu'", 'data-class="ad"'])
def test_op2_words_inside_attributes_decide_nothing(given):
    prose = "It was a long day, and nobody in the village had seen a train since the early morning of the day before."
    assert html_extract.extract_text(f"<html><body><div {given}><p>{prose}</p><p>{prose}</p></div></body></html>").endswith(f"{prose}\n{prose}")
    assert html_extract.extract_text(f"<html><body><div {given} hidden><p>{prose}</p></div></body></html>") == ""


def test_op10_laws(spark, sf, documents):
    got = Q["op10_two_pass_sharding"](spark, sf).toPandas()
    assert sorted(got["doc_id"]) == sorted(documents.index)
    n = got.groupby("shard").size()
    assert set(n.index) <= set(range(24)) and n.max() - n.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    text = documents["text"].reindex(got["doc_id"]).fillna("").map(str.encode)
    assert got["size"].tolist() == [len(t) + 8 for t in text] and got["text_crc32"].tolist() == [zlib.crc32(t) for t in text]


def test_op10_same_under_any_partition_count(spark, sf):
    docs, conf, found = common.table(spark, sf, "documents"), "spark.sql.shuffle.partitions", []
    before = spark.conf.get(conf)
    for n in ("3", "7"):
        spark.conf.set(conf, n)
        found.append(sharding.shard_plan(docs, 5, bucket_records=16).toPandas().sort_values("id"))
    spark.conf.set(conf, before)
    assert (found[0].to_numpy() == found[1].to_numpy()).all()
    assert sorted(found[0]["shard"] + 5 * found[0]["slot"]) == list(range(len(found[0])))
    # a permutation, not the order of the rows
    assert abs(np.corrcoef(found[0]["id"], found[0]["shard"] + 5 * found[0]["slot"])[0, 1]) < 0.3


def test_op10_repeated_records_are_spread(spark):
    docs = spark.range(3000).selectExpr("cast(null AS long) AS doc_id", "'same' AS text")
    keyed = sharding._scattered(docs, [F.lit(1).alias("x")], [F.col("doc_id").alias("id"), F.xxhash64("text").alias("key")], 3000, 10, 1)
    sizes = keyed.groupBy("bucket").count().toPandas()["count"]
    assert len(sizes) == 10 and sizes.max() < 400
    assert sharding.shard_plan(docs, 4, bucket_records=300).groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] == 0


def test_op10_odd_and_files(spark, odd, empty, tmp_path):
    assert sharding.shard_plan(odd, 3, bucket_records=3).count() == 10 and sharding.shard_plan(empty, 3).count() == 0
    sharding.write_shards(odd, str(tmp_path / "s"), 3, bucket_bytes=1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 10 and back.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    assert {re.sub("shard|slot", "", c) for c in back.columns} - {""} == set(odd.columns)


def test_components_of_hubs(spark, monkeypatch):
    edges = [(0, k) for k in range(1, 200)] + [(k, 1000 + k) for k in range(1, 200)] + [(5000, k) for k in range(1000, 1004)]
    for hub in (common.HUB_EDGES, 10):
        monkeypatch.setattr(common, "HUB_EDGES", hub)
        got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r["component"] for r in got if r["node"] not in (1000, 5000)} == {0} and len(got) == 401
    rows = spark.range(300).selectExpr("if(id < 250, 0, id) AS k", "id AS v")
    facts = common.durable(rows.groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("n")))
    assert common.join_facts(rows, facts, ["k"], 300).exceptAll(rows.join(facts.drop("n"), "k").select("k", "v", "s")).count() == 0
    assert common.hot_groups(rows, ["k"], 300).count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, **dict.fromkeys(range(200, 230), 200)}
