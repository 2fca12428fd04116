"""The positional index against plain Python."""

import math
import random
import re

from lakeloom.functions.postings import PostingIndex, stem, stem_word
from lakeloom.sources.formats import work_dir
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F


def words(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def index(spark, docs, **options):
    df = spark.createDataFrame(docs, "id long, title string, text string").withColumn("term", F.lit("x")).withColumn("bucket", F.lit(1))
    root = work_dir(spark) + "/index"
    PostingIndex(spark, root).build(df, "id", {"title": "A", "text": "C"}, **options)
    return PostingIndex(spark, root)  # opened from the folder alone


def brute(docs, all_of=(), phrases=(), none_of=()):
    n = len(docs)
    length = {i: len(words(a)) + len(words(b)) for i, a, b in docs}
    mean, out = sum(length.values()) / n, {}
    wanted = sorted({*all_of, *(w for p in phrases for w in p)})
    df = {w: sum(w in words(a) + words(b) for _, a, b in docs) for w in wanted}
    for i, a, b in docs:
        parts = [(1.0, words(a)), (0.2, words(b))]
        both = parts[0][1] + parts[1][1]
        hits = sum(tuple(p[j : j + len(c)]) == tuple(c) for _, p in parts for c in phrases for j in range(len(p)))
        each = [sum(tuple(p[j : j + len(c)]) == tuple(c) for _, p in parts for j in range(len(p))) for c in phrases]
        if all(w in both for w in wanted) and all(each) and not any(w in both for w in none_of):
            rank = 0.0
            for weight, p in parts:
                for w in wanted:
                    tf = p.count(w)
                    rank += weight * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[i] / mean))
            out[i] = (round(rank, 6), hits)
    return out


def result(df):
    return {r["key"]: (round(r["rank"], 6), r["phrase_hits"]) for r in df.collect()}


def test_search_equals_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("a b c d e f".split()) for _ in range(n))
    docs = [(i, text(rng.randrange(4)), text(rng.randrange(30))) for i in range(80)] + [(80, None, None), (81, "", "  , "), (82, "a", None), (83, "A b", "b-a c " * 5000)]
    ix = index(spark, docs)
    for query in ({"all_of": ["a", "f"]}, {"phrases": [["a", "b"]]}, {"phrases": [["a", "b", "a"], ["c", "d"]], "none_of": ["f"]}, {"all_of": ["zzz"]}):
        spoken = {k: [" ".join(c) for c in v] if k == "phrases" else " ".join(v) for k, v in query.items()}
        assert result(ix.search(**spoken)) == brute(docs, **query)
    assert result(ix.search()) == {} and result(ix.search(none_of="a")) == {}
    assert {k for k in result(ix.search(all_of="a", any_of="e f"))} == {i for i, a, b in docs if "a" in words(a) + words(b) and {"e", "f"} & set(words(a) + words(b))}
    assert ix.frequencies(["a", "zzz"]) == {"a": sum("a" in words(a) + words(b) for _, a, b in docs)}


def test_only_the_folders_of_the_terms_are_read(spark):
    ix = index(spark, [(i, f"w{i}", "the of and") for i in range(50)])
    scans = ix.postings(["the", "of"])
    plan = scans._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in plan.split("PushedFilters: [")[1]
    assert len({f.split("/")[-2] for f in scans.inputFiles()}) <= 64 and scans.select("bucket").distinct().count() <= 2


def test_stems_and_stop_words(spark):
    samples = "ponies ties aies eies shoes cases bees gas bus glass houses s es ies".split()
    rows = spark.createDataFrame([(w,) for w in samples], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == {w: stem_word(w) for w in samples}
    assert stem_word("ponies") == "pony" and stem_word("houses") == "house" and stem_word("glass") == "glass"
    ix = index(spark, [(1, "red houses", None), (2, "house of red", None)], stems=True, stop_words=["of"])
    assert set(result(ix.search(all_of="House reds"))) == {1, 2}
    assert set(result(ix.search(phrases=["house red"]))) == set()


def test_empty_table(spark):
    ix = index(spark, [])
    assert result(ix.search(all_of="a", phrases=["a b"])) == {}


def test_rows_of_one_key_add_up(spark):
    docs = [(1, "a b", "c a"), (1, None, "a c c"), (2, "a", None), (None, "a c", "a"), (None, "c", "c"), (3, "b", "b b")]
    ix = index(spark, docs)
    assert ix.frequencies(["a", "b", "c"]) == {"a": 2, "b": 2, "c": 1}  # null is no document
    n, mean = 6, sum(len(words(a)) + len(words(b)) for _, a, b in docs) / 6
    weigh = lambda weight, d, tf, length: weight * math.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    got = result(ix.search(all_of="a"))
    assert got[2] == (round(weigh(1.0, 2, 1, 1), 6), 0) and got[1] == (round(weigh(1.0, 2, 1, 4) + weigh(0.2, 2, 2, 4), 6), 0) and set(got) == {1, 2, None}


def test_words_are_not_shuffled_to_become_postings(spark, monkeypatch):
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()) if path.endswith("/postings") else None, write(self, path, *a, **k))[1])
    index(spark, [(i, f"w{i}", "the of the and") for i in range(9)])
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 and "Generate" not in plans[0] and "Aggregate" not in plans[0]
