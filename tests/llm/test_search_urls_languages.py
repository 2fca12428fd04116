import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import covertree, langcrf, urltree
from lakeloom.llm.common import Scratch
from lakeloom.llm.queries import RULES


def best(ids, vectors, is_query, k):
    v = {i: np.floor(1024 * np.asarray(x, np.float64)).astype(object) for i, x in zip(ids, vectors, strict=True)}
    out = set()
    for q in filter(is_query, v):
        scores = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))
        out |= {(q, r, c, -s) for r, (s, c) in enumerate(scores[:k], 1)}
    return out


def test_cover_tree_covers():
    x = np.random.default_rng(1).normal(size=(700, 5))
    x[100:160] = x[100]
    tree = covertree.CoverTree(x, leaf=8)
    seen = []

    def rows(n):
        if tree.rows[n] is not None:
            return tree.rows[n]
        return np.concatenate([rows(c) for c in tree.children[n]])

    for n in range(len(tree.centre)):
        assert (np.linalg.norm(x[rows(n)] - x[tree.centre[n]], axis=1) <= tree.radius[n] + 1e-9).all()
    seen = np.sort(rows(0))
    assert (seen == np.arange(700)).all()


def test_nets_cover_and_keep_apart():
    x = np.random.default_rng(3).normal(size=(500, 3))
    tree = covertree.CoverTree(x)
    for n, children in enumerate(tree.children):
        c = x[[tree.centre[m] for m in children]]
        if len(children) > 1:
            apart = np.linalg.norm(c[:, None] - c[None], axis=2)[np.triu_indices(len(c), 1)]
            assert apart.min() >= tree.reach[n] - 1e-9
        assert all(tree.radius[m] <= tree.reach[n] + 1e-9 and m > n for m in children)


def test_most_pairs_are_pruned_and_the_rest_is_exact():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    data = np.floor(1024 * (centres[rng.integers(0, 40, 6000)] + 0.02 * rng.normal(size=(6000, 16))))
    queries, ids = data[::50], np.arange(6000)
    found = covertree.dual_tree_search(queries, ids[::50], data, ids, 10)
    assert found.compared + found.bounded < 0.25 * len(queries) * len(data)
    for q in range(len(queries)):
        scores = (data @ queries[q]).astype(np.int64)
        scores[50 * q] = -(1 << 60)
        order = np.lexsort((ids, -scores))[:10]
        assert found.ids[q].tolist() == order.tolist() and found.score[q].tolist() == scores[order].tolist()


def test_scores_beyond_the_exact_range_of_doubles():
    rng = np.random.default_rng(12)
    data = np.floor(rng.normal(size=(300, 4)) * 2.0**29)
    data[100:200] = data[:100] + rng.integers(-1, 2, (100, 4))
    ids = np.arange(300)
    found = covertree.dual_tree_search(data[:40], ids[:40], data, ids, 5)
    exact = [[int(x) for x in row] for row in data]
    for q in range(40):
        scores = sorted((-sum(x * y for x, y in zip(exact[q], exact[c], strict=True)), c) for c in range(300) if c != q)[:5]
        assert list(zip(found.score[q].tolist(), found.ids[q].tolist(), strict=True)) == [(-s, c) for s, c in scores]


@pytest.mark.parametrize("blocks", [(4096, 8192), (7, 64)])
def test_top_k_is_exact(spark, blocks):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(400, 12)) * 2).astype(np.float32)
    vectors[50:80] = vectors[50]
    vectors[90] = 0
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(vectors)] + [(401, vectors[3].tolist(), "x"), (402, [1.5] * 3, "x"), (403, [0.25] * 3, "x")]
    want = best([r[0] for r in rows], [r[1] for r in rows], lambda i: i % 10 == 0 or i == 402, 10)
    odd = [(500, None, ""), (510, [float("nan")] * 12, ""), (520, [float("inf")] + [0.0] * 11, ""), (530, [None] * 12, ""), (None, [0.0] * 12, ""), (20, vectors[20].tolist(), "twice")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    got = covertree.exact_top_k(spark, df, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") == 402), query_block=blocks[0], data_block=blocks[1])
    assert {tuple(r) for r in got.collect()} == want


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert covertree.exact_top_k(spark, spark.createDataFrame([], schema), F.col("vec_id") % 2 == 0).count() == 0
    assert covertree.exact_top_k(spark, spark.createDataFrame([(2, [1.0])], schema), F.col("vec_id") % 2 == 0).count() == 0
    big = spark.createDataFrame([(0, [3e6, -3e6]), (1, [3e6, 2e6])], schema)
    x = [int(np.floor(1024 * float(np.float32(v)))) for v in (3e6, -3e6, 3e6, 2e6)]
    assert covertree.exact_top_k(spark, big, F.col("vec_id") == 0).first()["score"] == x[0] * x[2] + x[1] * x[3]


def judge(url):
    """Host, path and rule by string operations."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_urls_rules_and_templates(spark):
    urls = [None, "", "nothing", "http://", "HTTP://Example.ORG/es/1", "https://a.b.example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "x://org/", "x://org", "http://a.com/fr/", "http://a.com/DE/", "http://a.com/de/x?y#z", "http://ÀB.com/de/é", "http://u:p@h:80?/de/", "http://h#/x", "a://b://c/d"]
    urls += [f"http://shop.com/de/item-{i}" for i in range(30)] + [f"http://shop.com/item/{i}.html" for i in range(40)] + [f"http://shop.net/u{i}/p" for i in range(60)] + ["http://dup.com/fr/1"] * 3
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://a.com/de/1", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urltree.filter_urls(spark, df, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is None:
            continue
        host, path, rule = judge(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None)
        assert r["verdict"] in ("allow", "block")
        if rule:
            assert r["verdict"] == ("block" if rule.block else "allow")
    shapes = {r["template"] for r in got if r["host"] == "shop.com" and r["path"].startswith("/item/")}
    assert len(shapes) == 1 and "{n}.html" in shapes.pop()
    assert {r["template"] for r in got if r["host"] == "shop.net"} <= {"/u{n}/p", "/*/p"}
    assert urltree.filter_urls(spark, df.limit(0), RULES).count() == 0


def test_purity_decides_what_rules_leave(spark):
    rules = [urltree.Rule("bad.com", "/x/1", True), urltree.Rule("good.com", "/x/1", False)]
    urls = [f"http://{h}.com/x/{i}" for h in ("bad", "good") for i in range(10, 60)]
    got = urltree.filter_urls(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    for r in got:
        assert r["verdict"] == ("block" if r["host"] == "bad.com" else "allow")


def test_held_out_urls_are_judged_better_than_by_a_constant(spark):
    host, path = urltree.split_url()
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", urltree.fitting_rule(RULES))
    pages = pages.filter("rule is not null").withColumn("truth", F.col("rule").isin([r.name for r in RULES if r.block])).withColumn("hidden", F.col("page_id") % 3 == 0)
    tree = urltree.TemplateTree()
    learned = tree.fit(spark, pages.select("host", "path", F.when(~F.col("hidden"), F.col("truth")).alias("label")), Scratch(spark))
    judged = pages.filter("hidden").withColumn("shape", urltree.shape_path("path", tree.depth)).join(learned, ["host", "shape"]).select("truth", (F.col("purity") >= tree.reject).alias("blocked")).collect()
    right = sum(r["truth"] == r["blocked"] for r in judged) / len(judged)
    blocked = sum(r["truth"] for r in judged) / len(judged)
    assert right > max(blocked, 1 - blocked) and {r["blocked"] for r in judged} == {True, False}


def test_a_host_without_labels_is_judged_by_its_templates_elsewhere(spark):
    rules = [urltree.Rule("a.com", "/ads/", True), urltree.Rule("a.com", "/news/", False)]
    urls = [f"http://{h}.com/{kind}/{i}" for h in "ab" for kind in ("ads", "news") for i in range(30)]
    got = urltree.filter_urls(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert all(r["verdict"] == ("block" if r["path"].startswith("/ads/") else "allow") for r in got)


def test_long_urls_a_hot_host_and_merged_branches(spark):
    urls = ["http://hot.com/" + "/".join(["seg"] * 3000)] + ["http://hot.com/" + "x" * 200_000] + [f"http://hot.com/user{i % 7}/posts/{i}" for i in range(600)] + [f"http://cold{i}.com/p" for i in range(20)]
    got = urltree.filter_urls(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()
    assert len(got) == len(urls) and {r["verdict"] for r in got} == {"allow"}
    of = {r["page_id"]: r["template"] for r in got}
    assert of[0] == "/seg/seg/seg/seg/**" and {of[i] for i in range(2, 602)} <= {"/user{n}/posts/{n}", "/*/posts/{n}"}
    letters = [f"http://m.com/{c * 3}/a/b" for c in "abcdefghijkl" for _ in range(9)]
    got = urltree.filter_urls(spark, spark.createDataFrame(list(enumerate(letters)), "page_id long, url string"), RULES).collect()
    assert {r["template"] for r in got} == {"/*/a/b"}  # siblings with the same branches below


def test_rare_segments_become_wildcards(spark):
    urls = [f"http://h.com/{w}/page" for w in ("".join(chr(97 + (i * k) % 26) for k in range(1, 7)) + "z" * (i % 40) for i in range(400))]
    got = urltree.filter_urls(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES)
    assert {r["template"] for r in got.select("template").distinct().collect()} == {"/*/page"}


def brute_marginals(scores, transitions, start):
    n, labels = scores.shape
    total, weight = np.zeros((n, labels)), 0.0
    import itertools

    for path in itertools.product(range(labels), repeat=n):
        w = np.exp(start[path[0]] + sum(scores[i, p] for i, p in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
        weight += w
        for i, p in enumerate(path):
            total[i, p] += w
    return total / weight


def test_chain_marginals_are_exact_across_blocks_and_texts():
    rng = np.random.default_rng(4)
    lengths = [1, 5, 2, 6, 1, 4]
    scores, transitions, start = rng.normal(size=(sum(lengths), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    begins = np.zeros(sum(lengths), bool)
    begins[np.cumsum([0, *lengths[:-1]])] = True
    at = np.concatenate([[0], np.cumsum(lengths)])
    want = np.concatenate([brute_marginals(scores[a:b], transitions, start) for a, b in zip(at, at[1:], strict=False)])
    for block in (1, 2, 4, 128):
        assert np.allclose(langcrf.chain_marginals(scores, begins, transitions, start, block), want, atol=1e-9)


WORDS = {"en": ["the", "of", "and", "thing", "other", "with", "where", "ation"], "de": ["der", "und", "schön", "für", "zu", "einzeln", "über", "nicht"], "fr": ["le", "été", "aux", "leçon", "que", "dans", "être", "où"]}


def sentences(lang, n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[lang], 30)) for _ in range(n)]


def test_learns_languages_and_code_switching(spark):
    train = [(t, lang) for lang in WORDS for t in sentences(lang, 40, 1)]
    model = langcrf.train(train)
    rows = [(i * 3 + j, t, "x") for j, lang in enumerate(WORDS) for i, t in enumerate(sentences(lang, 30, 2))]
    odd = [(900, None, "x"), (901, "", "x"), (902, "123 ... --- ***", "x"), (903, "日 …", "x"), (904, "— … “", "x"), (None, "the of and with", "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in langcrf.identify_languages(spark, df, model).collect()}
    assert all(got[i * 3 + j]["lang_pred"] == lang and got[i * 3 + j]["score"] > 0.8 for j, lang in enumerate(WORDS) for i in range(30))
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 904)] == ["und"] * 4 and got[902]["score"] == 0.0
    assert got[903]["lang_pred"] != "und" and got[None]["lang_pred"] == "en"
    mixed = langcrf.label_words(model, "the of and thing with other of the where and über nicht der und schön zu für einzeln 42")
    assert [x[1] for x in mixed[1:9]] == ["en"] * 8 and [x[1] for x in mixed[11:18]] == ["de"] * 7 and mixed[18][1] == "und"


def test_held_out_accuracy_and_samples(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in WORDS for t in sentences(lang, 60, 3))] + [(1000, "the of", None), (1001, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langcrf.train_on(df, docs_per_language=20, sample_chars=100)
    assert model.languages == ["de", "en", "fr"]
    out = langcrf.identify_languages(spark, df, model, carry=("doc_id", "lang")).filter(langcrf.held_out() & F.col("lang").isNotNull()).collect()
    right = [r["lang"] == r["lang_pred"] for r in out if r["lang_pred"] != "und"]
    assert len(right) > 20 and np.mean(right) > 0.95
    none = df.filter("lang is null")
    nothing = langcrf.train_on(none)
    assert {r["lang_pred"] for r in langcrf.identify_languages(spark, none, nothing).collect()} == {"und"}


def test_flat_data_costs_few_bounds_and_stays_exact():
    rng = np.random.default_rng(21)
    data = np.floor(1024 * rng.normal(size=(3000, 48)))
    data[1500:1600] = data[0]
    ids = np.arange(3000)
    found = covertree.dual_tree_search(data[:600], ids[:600], data, ids, 10)
    assert found.bounded <= 600 * 3000 / covertree.PAYS + 1
    for q in range(0, 600, 7):
        scores = (data @ data[q]).astype(np.int64)
        scores[q] = -(1 << 60)
        order = np.lexsort((ids, -scores))[:10]
        assert found.ids[q].tolist() == order.tolist() and found.score[q].tolist() == scores[order].tolist()


def test_only_texts_go_through_python_for_languages(spark):
    """Carried columns stay in the JVM, and a filter on the result does not score texts again."""
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in WORDS for t in sentences(lang, 5, 3))] + [(100, None, "en"), (101, "12", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langcrf.train_on(df)
    out = langcrf.identify_languages(spark, df, model, carry=("doc_id", "text", "lang"), result=("__l", "__s")).filter("__s >= 0.3 and __l <> 'und'")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1 and "[scan(text#" in plan
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == list(range(len(rows) - 2))
