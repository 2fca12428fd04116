"""The pipeline's stages against plain versions, and the operators' queries against their SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import packing, queries
from lakeloom.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def phrases(text, k=5):
    w = WORD.findall(text.lower())
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def fixture():
    rng = random.Random(8)
    words = {"en": ["the", "of", "and", "thing", "with", "where", "other", "stone"], "de": ["der", "und", "zu", "für", "nicht", "über", "einzeln", "haus"]}
    rows = []
    for i in range(80):
        lang = "en" if i % 3 else "de"
        lines = [" ".join(rng.choice(words[lang]) + str(rng.randrange(40)) * (rng.random() < 0.6) for _ in range(rng.randint(6, 14))) for _ in range(rng.randint(2, 6))]
        if i % 7 == 0:
            lines.insert(1, "the shared line of all of the things with stone and other" if lang == "en" else "der und zu für nicht über einzeln haus der haus zu")
        text = "\n".join(lines)
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    long = " ".join(rng.choice(words["en"]) + str(rng.randrange(500)) for _ in range(120))
    rows += [(200, long, "en", "s0", 1), (201, long.replace("stone", "rock", 1), "en", "s1", 1), (202, "\n".join([long[:200], long[200:]]), "en", None, 1)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, "123 ... ---", None, "s2", 9), (303, rows[5][1], "en", "s3", 2)]
    return rows


def test_stages_against_plain_versions(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "source mixing", "best-fit packing"]
    docs = spark.createDataFrame(fixture(), COLUMNS)
    stages = [f for _, f in corpus_pipeline.STAGES]

    spoken = spark.createDataFrame(stages[0](spark, docs, SF).collect(), COLUMNS)
    assert spoken.columns == docs.columns
    want = {r[0] for r in fixture() if r[1] and re.search(r"[^\W\d_]", r[1])}
    assert {r["doc_id"] for r in spoken.collect()} == want  # all clean documents stay

    before = sorted(spoken.collect(), key=lambda r: r["doc_id"])
    lined = spark.createDataFrame(stages[1](spark, spoken, SF).collect(), COLUMNS)
    seen, expect = [], {}
    for r in before:
        kept = []
        for s in r["text"].split("\n"):
            x = set(WORD.findall(s.lower()))
            if not x or not any(100 * len(x & y) >= 80 * len(x | y) for y in seen):
                kept.append(s)
            if x:
                seen.append(x)
        if WORD.search("\n".join(kept)):
            expect[r["doc_id"]] = "\n".join(kept)
    got = {r["doc_id"]: r for r in lined.collect()}
    assert {i: r["text"] for i, r in got.items()} == expect and len(expect) < len(before)

    single = spark.createDataFrame(stages[2](spark, lined, SF).collect(), COLUMNS)
    sets = {i: phrases(t) for i, t in expect.items()}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    assert {r["doc_id"] for r in single.collect()} == set(group.values())

    mixed = spark.createDataFrame(stages[3](spark, single, SF).collect(), COLUMNS)
    sizes, taken = Counter(), Counter()
    for r in single.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixed.collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes) and all(taken[s] <= 3 * sizes[s] for s in sizes)

    packed = stages[4](spark, mixed, SF).collect()
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_run_applies_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = want.columns
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(want.fetchall())


def test_mixed_corpus_has_every_row(spark):
    got = queries.op1_mix_sources(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count()
    off = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).filter("abs(t - g) > 1").count()
    assert off == 0


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right / n > 0.97


def test_stages_with_clashing_names_repeats_null_ids_and_no_rows(spark):
    odd = ("__d", "__h", "__gone", "__th", "__0", "__text", "__letter", "__class", "__own", "__row", "__lang", "__score", "__removed", "node", "words", "size")
    rows = [*fixture()[:12], *fixture()[:3], (None, fixture()[3][1], "en", None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    clashing = docs.selectExpr("*", *(f"'x' as `{c}`" for c in odd))
    for table in (clashing, clashing.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns, name
            out.collect()
    plain = [[tuple(r)[:5] for r in stage(spark, table, SF).collect()] for _, stage in corpus_pipeline.STAGES[:3] for table in (docs, clashing)]
    assert all(sorted(map(repr, a)) == sorted(map(repr, b)) for a, b in zip(plain[::2], plain[1::2], strict=True))


def test_samples_of_very_many_languages(spark):
    from lakeloom.llm import langcrf

    labelled = spark.range(2000).selectExpr("concat('text ', id) as text", "concat('l', id) as lang")
    assert len(langcrf.training_sample(labelled)) == 2000
