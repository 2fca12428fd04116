import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lakeloom.llm import linedup, minhash, rlz
from lakeloom.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repetitions inside a text, junk and nothing."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = make(60)
    out = []
    for i in range(n):
        words = make(rng.randint(1, 150))
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage[: rng.randint(30, 60)]
        lines = [" ".join(words[j : j + 25]) for j in range(0, len(words), 25)]
        out.append("\n".join(lines))
    out += [out[3], out[3].upper(), out[4] + " tail", out[7].replace("w1", "W1")]
    base = make(120)
    for i in range(12):
        x = list(base)
        for _ in range(i % 4):
            x[rng.randrange(len(x))] = "edit%d" % rng.randrange(1000)
        out.append(" \t".join(x))
    out += ["quell " * 300, "quell " * 34, " ".join(passage[:35]), "", None, " \n\r ", "short", "Short", "a b c", "nbsp\u00a0stays one", "x\x1fy z", "ÀÉ é"]
    return out


def frame(spark, texts):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, "null id " * 40, "c", 0), (5, "again five", "c", 0), (9, texts[9], "c", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, first string, n long")


def test_substring_removal_equals_brute_force(spark):
    rows, df = frame(spark, corpus())
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for (i, *_), w in zip(rows, words, strict=True):
        gone = {k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    got = rlz.remove_repeats(spark, df).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["text"]) for r in got) == want
    assert any(r["n_removed"] not in (0, r["n_words"]) for r in got)
    assert rlz.remove_repeats(spark, df.limit(0)).count() == 0


def test_parsing_is_greedy_and_factors_are_maximal():
    rng = np.random.default_rng(4)
    for _ in range(50):
        runs = [np.sort(rng.choice(9, rng.integers(1, 9), replace=False)) for _ in range(6)]
        run, i = np.repeat(np.arange(6), [len(r) for r in runs]), np.concatenate(runs)
        places = rng.integers(0, 3, (len(i), 2)) * 100 + i[:, None] + rng.integers(0, 2, (len(i), 2))
        places[rng.random(len(i)) < 0.3, 1] = -1
        first, many, place = rlz.parse(run, i, places)
        where = {(r, k): set(p[p >= 0].tolist()) for r, k, p in zip(run.tolist(), i.tolist(), places, strict=True)}
        got = [(int(run[f]), int(i[f]), int(m), int(p)) for f, m, p in zip(first, many, place, strict=True)]
        reach = lambda r, k, p: next(j for j in range(20) if p + j not in where.get((r, k + j), ()))  # noqa: B023, E731
        for r in range(6):
            at = 0
            mine = [g for g in got if g[0] == r]
            while at < 9:
                if (r, at) not in where:
                    at += 1  # a literal
                    continue
                _, k, m, p = mine.pop(0)
                assert k == at and p in where[r, at]
                assert m == reach(r, at, p) == max(reach(r, at, q) for q in where[r, at])
                at += m
            assert not mine


def test_factors_name_equal_text(spark):
    """Each factor's windows are the windows of the reference at the place that it names."""
    rows, df = frame(spark, corpus(5, 30))
    scratch = Scratch(spark)
    _, references = rlz.reference_blocks(spark, df, scratch, 12, 4)
    known = {(r["anchor"], r["run"]): r["windows"] for r in references.collect()}
    upper = {(a, (run & (-1 << 4)) & (2**63 - 1)): w for (a, run), w in known.items()}
    factors = rlz.factors_of(references, 12, 4).collect()
    assert len(factors) > 20 and any(f["j"] > f["i"] for f in factors)
    for f in factors:
        size = f["j"] - f["i"] + 1
        there = upper[f["anchor"], f["reference"]][f["offset"] : f["offset"] + size]
        assert known[f["anchor"], f["run"]][f["i"] : f["j"] + 1] == there


def test_substring_removal_with_small_windows(spark):
    rows, df = frame(spark, corpus(2, 20))
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + 6]) for w in words for i in range(len(w) - 5))
    want = sum(len({k for j in range(len(w) - 5) if seen[tuple(w[j : j + 6])] > 1 for k in range(j, j + 6)}) for w in words)
    assert rlz.remove_repeats(spark, df, window=6, gram=2, with_text=False).agg(F.sum("n_removed")).first()[0] == want


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(ids, sets, percent=80):
    parent = dict.fromkeys(ids)
    for i in ids:
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus(3)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    for k in (4, 5):
        sets = {i: shingles(t, k) for i, t in enumerate(texts)}
        want = components(list(sets), sets)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(spark, df, shingle=k).collect()}
        assert len(got) == len(texts)
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_chains_are_linked_whatever_the_centres(spark):
    """Neighbours in the chain are similar, its ends are not: every link must be found, in the last round at the latest."""
    words = [f"c{i}" for i in range(260)]
    texts = [" ".join(words[4 * i : 4 * i + 100]) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: shingles(t, 5) for i, t in enumerate(texts)}
    want = components(list(sets), sets)
    for rounds in (1, 3):
        got = minhash.near_duplicates(spark, df, rounds=rounds).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert set(want.values()) == {0}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, None)]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and {r["component_id"] for r in got if r["n_shingles"]} == {1}
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in got if not r["n_shingles"])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(spark, empty).count() == 0
    kept = minhash.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 3, 4]


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcdef")
    rows = [(None, a), (None, b), (None, a.upper()), (7, c), (7, d), (1, e), (5, e + " more"), (5, f), (9, f), (None, f), (2, b + " more"), (2, b + " also")]
    rows += [(3, ""), (3, None), (None, None), (None, " ")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int")
    got = minhash.keep_one_of_each_group(spark, df)
    assert got.columns == df.columns
    want = [(None, a.upper()), (7, c), (7, d), (1, e), (5, f), (2, b + " also"), *rows[-4:]]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_star_components(spark):
    edges = [(b"%03d" % a, b"%03d" % b) for a, b in [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21), (4, 1), (5, 5)]]
    df = spark.createDataFrame(edges, "u binary, v binary")
    got = {bytes(r["node"]): bytes(r["root"]) for r in minhash.star_components(spark, df, Scratch(spark), "t").collect()}
    assert got == {b"%03d" % k: b"%03d" % v for k, v in {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}.items()}


def line_want(rows, percent=80):
    lines = []
    for i, (d, t, *_) in enumerate(rows):
        for n, s in enumerate(t.split("\n") if t is not None else []):
            w = WORD.findall(s.lower())
            if w:
                lines.append(((d is not None, d or 0, n), i, frozenset(w)))
    gone = set()
    for at, i, x in lines:
        if any(b < at and 100 * len(x & y) >= percent * len(x | y) for b, _, y in lines):
            gone.add((i, at[2]))
    return gone


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    texts = corpus(4, 25)
    base = [f"l{i}" for i in range(40)]
    for i in range(25):  # near copies of a line: of the first, and of each other only
        x = list(base)
        for _ in range(i % 5):
            x[rng.randrange(40)] = f"e{rng.randrange(99)}"
        texts.append("own %d line here\n%s\nthe end" % (i, " ".join(x)))
    texts += ["the end\nTHE END\n\n\nnew", "\n", "one\rtwo\x0bthree"]
    rows = [(i, t, i, "z") for i, t in enumerate(texts)] + [(None, "the end\nfirst of all", 0, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line long, class string")
    gone = line_want(rows)
    got = {r["doc_id"]: r for r in linedup.dedup_lines(spark, df).collect()}
    assert len(got) == len(rows)
    for i, (d, t, n, z) in enumerate(rows):
        lines = t.split("\n") if t is not None else []
        kept = [s for j, s in enumerate(lines) if (i, j) not in gone]
        r = got[d]
        assert r["text"] == (None if t is None else "\n".join(kept))
        assert (r["n_lines"], r["n_removed"], r["line"], r["class"]) == (len(lines), len(lines) - len(kept), n, z)
    assert linedup.dedup_lines(spark, df.limit(0)).count() == 0


def test_line_dedup_of_repeated_rows_and_other_sizes(spark):
    rows = [(1, "a b c d e f\nx"), (1, "a b c d e f\nx"), (2, "a b c d e f\ny\nx")]
    got = sorted((r["doc_id"], r["text"]) for r in linedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "a b c d e f\nx"), (1, "a b c d e f\nx"), (2, "y")]
    texts = corpus(6, 20)
    rows = list(enumerate(texts))
    for percent in (50, 60, 95):
        gone = line_want(rows, percent)
        got = linedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)
        assert got.agg(F.sum("n_removed")).first()[0] == len(gone)


def test_line_dedup_with_a_word_in_most_lines_and_a_large_family(spark, monkeypatch):
    """Long lists: a word that is rare in no line, and near copies that match each other but mostly not the first."""
    monkeypatch.setattr(linedup, "SHORT", 3)
    monkeypatch.setattr(linedup, "LONG", 20)
    monkeypatch.setattr(linedup, "GROUP", 4)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(30)]
    family = []
    for _ in range(120):
        x = list(base)
        for _ in range(rng.randrange(5)):
            x[rng.randrange(30)] = f"b{rng.randrange(40)}"
        family.append(" ".join(x))
    hot = [f"hot {a} {b} {c}" for a in "pqr" for b in "stu" for c in "vwx"] + ["hot p s v z", "hot p s", "hot", "HOT", "hot hot"]
    texts = ["\n".join(rng.sample(family, 6) + rng.sample(hot, 4)) for _ in range(40)]
    rows = list(enumerate(texts))
    gone = line_want(rows)
    got = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "\n".join(s for j, s in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in rows}


def test_line_dedup_of_a_very_long_line(spark):
    words = [f"v{i}" for i in range(1_100_000)]
    near = words[:900_000] + [f"u{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, "short\n" + " ".join(words[::-1])), (3, " ".join(near)), (4, " ".join(words[:880_000]) + "\tv5")]
    got = {r["doc_id"]: r for r in linedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["n_removed"] for i, r in got.items()} == {1: 0, 2: 1, 3: 0, 4: 1}
    assert got[2]["text"] == "short" and got[4]["text"] == ""


def test_line_dedup_runs_no_python_on_the_executors(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("Python on the executors")

    df = spark.createDataFrame([(1, "a b c d e f\nx"), (2, "a  b c d e f g\n\ny")], "doc_id long, text string")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(df), name, refuse)
    assert sorted((r["doc_id"], r["text"]) for r in linedup.dedup_lines(spark, df).collect()) == [(1, "a b c d e f\nx"), (2, "\ny")]


def test_long_lists_make_no_pairs_whose_later_class_is_late(spark):
    rows = [(c, (True, c, 0), 10, 0, 0, 1 << 60, 300) for c in range(40)]
    lists = spark.createDataFrame(rows, "class long, at struct<k:boolean,doc_id:long,line:int>, n int, map long, pos int, token long, list long")
    join = linedup.LineJoin(spark, spark.createDataFrame([], "doc_id long, text string"))
    late = lambda n: spark.createDataFrame([(c,) for c in range(1, n)], "class long")
    assert join._long_lists(lists, late(40)).count() == 0
    assert sorted((r["a"], r["b"]) for r in join._long_lists(lists, late(39)).collect()) == [(a, 39) for a in range(39)]


def test_line_dedup_keeps_tables_out_of_plans_and_texts_in_their_buckets(spark):
    """The driver holds each plan's text, and a line's words cross the network once before pairs are known."""
    rows = [(i, "a b c d e %d\nsame line in all\nown %d" % (i % 7, i)) for i in range(60)]
    join = linedup.LineJoin(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    lines = join._lines()
    classes = join._classes(lines)
    assert classes.count() == 7 + 1 + 60 and classes.agg(F.sum("copies")).first()[0] == 180
    lists = spark.createDataFrame([], "class long, at struct<k:boolean,doc_id:long,line:int>, n int, map long, pos int, token long, list long")
    assert len(join._long_lists(lists, classes.select("class"))._jdf.queryExecution().toString()) < 50_000
    wanted = classes.select("class", "at", "s").join(classes.select("class").distinct().repartition(3).hint("shuffle_hash"), "class")
    assert "Bucketed: true" in wanted._jdf.queryExecution().executedPlan().toString()
    join.scratch.drop("classes", "lines")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lakeloom_")]
