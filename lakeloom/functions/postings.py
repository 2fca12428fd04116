"""A stored positional index of texts: postings in folders by a hash of the term, in order of terms.

A search reads the folders of its terms only, and in their files the row groups of these terms; documents are not read. A posting
is (term, key, part, tf, positions, length): the places of a term in one part of a row, and the length of the whole
row in terms. A folder that is large is several files, each in order of terms; a search adds up the postings of rows with one key.

A null text has no terms; a document without terms has no postings but counts among the documents. Rows that repeat a key
count as one document each, and their occurrences add up. A search without any word finds nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from lakeloom.functions.text import WEIGHTS, terms

#: Saturation of repeated terms and share of the length's correction in ranks.
SATURATION, BY_LENGTH = 1.2, 0.75


def stem(term: Column) -> Column:
    """English plurals cut (Harman's S rules): -ies to -y unless -eies or -aies, else -es to -e unless -aes, -ees or -oes, else -s cut unless -us or -ss."""
    ends = lambda *tails: reduce(lambda a, b: a | b, [term.endswith(x) for x in tails])
    cut = lambda n: F.substring(term, F.lit(1), F.length(term) - n)
    return (
        F.when(ends("ies") & ~ends("eies", "aies"), F.concat(cut(3), F.lit("y")))
        .when(ends("es") & ~ends("aes", "ees", "oes"), cut(1))
        .when(ends("s") & ~ends("us", "ss"), cut(1))
        .otherwise(term)
    )


def stem_word(word: str) -> str:
    """stem() of a word of a query."""
    if word.endswith("ies") and not word.endswith(("eies", "aies")):
        return word[:-3] + "y"
    if word.endswith("es") and not word.endswith(("aes", "ees", "oes")):
        return word[:-1]
    return word[:-1] if word.endswith("s") and not word.endswith(("us", "ss")) else word


class PostingIndex:
    """An index in a folder; any session that is given the folder can search it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._about = spark, root, None

    def build(self, docs: DataFrame, key: str, parts: dict[str, str], stems: bool = False, stop_words: Sequence[str] = (), buckets: int = 64) -> PostingIndex:
        """parts: column name to weight label. stop_words keep their places, so phrases are not joined across them.

        A row's words become postings in the task that reads it, so only postings are shuffled, once, to their folders; a folder too large for one task is split."""
        x = docs.select(F.col(key).alias("key"), *[F.coalesce(terms(c), F.array().cast("array<string>")).alias(f"part{i}") for i, c in enumerate(parts)])
        x = x.withColumn("length", reduce(lambda a, b: a + b, [F.size(f"part{i}") for i in range(len(parts))]))
        schema = StructType().add("term", "string").add(x.schema["key"]).add("part", "integer").add("weight", "double").add("tf", "long").add("positions", ArrayType(IntegerType())).add("length", "integer").add("first", "boolean")
        found = x.mapInArrow(_row_postings([WEIGHTS[label] for label in parts.values()], stems, tuple(stop_words)), schema)
        found = found.withColumn("bucket", _bucket(F.col("term"), buckets))
        found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/postings")
        stored = self.spark.read.schema(found.schema).parquet(f"{self.root}/postings")
        repeated = x.filter("key is not null").groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
        held = F.sum((F.col("first") & F.col("key").isNotNull()).cast("long"))
        if repeated.isEmpty():
            known = stored.groupBy("bucket", "term").agg(held.alias("documents"), F.sum("tf").alias("tf"))
        else:  # a key's rows count once; the others are counted as they are
            repeated = self._kept(repeated, "repeated")
            once = stored.join(repeated, "key", "left_anti").groupBy("bucket", "term").agg(held.alias("documents"), F.sum("tf").alias("tf"))
            several = stored.join(repeated, "key", "left_semi").groupBy("bucket", "term").agg(F.count_distinct("key").alias("documents"), F.sum("tf").alias("tf"))
            known = once.unionByName(several).groupBy("bucket", "term").agg(F.sum("documents").alias("documents"), F.sum("tf").alias("tf"))
        known.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/terms")
        about = x.agg(F.count("*").alias("documents"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean"))
        about.select("*", F.lit(buckets).alias("buckets"), F.lit(stems).alias("stems"), F.lit(found.drop("bucket").schema.json()).alias("schema")).write.parquet(f"{self.root}/about")
        return self

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def about(self):
        """One row: documents, mean length, buckets, stems."""
        if self._about is None:
            self._about = self.spark.read.parquet(f"{self.root}/about").first()
        return self._about

    def _words(self, text: str) -> list[str]:
        """The terms of a text of a query, in order, repeats kept."""
        words = re.findall(r"\w+", text.lower())
        return [stem_word(w) for w in words] if self.about()["stems"] else words

    def _rows(self, folder: str, words: Sequence[str], schema) -> DataFrame:
        buckets = F.array_distinct(F.transform(F.array(*map(F.lit, words)), lambda w: _bucket(w, self.about()["buckets"])))
        wanted = self.spark.range(1).select(buckets).first()[0] if words else []
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").filter(F.col("bucket").isin(wanted) & F.col("term").isin(list(words)))

    def postings(self, words: Sequence[str]) -> DataFrame:
        """The postings of these terms; only their folders are read."""
        return self._rows("postings", words, StructType.fromJson(json.loads(self.about()["schema"])).add("bucket", "integer"))

    def frequencies(self, words: Sequence[str]) -> dict[str, int]:
        """How many documents hold each term: a row for each word of the query."""
        return {r["term"]: r["documents"] for r in self._rows("terms", words, "term string, documents long, tf long, bucket int").collect()}

    def search(self, all_of: str = "", phrases: Sequence[str] = (), any_of: str = "", none_of: str = "") -> DataFrame:
        """key, rank, phrase_hits: documents with every word of all_of, every phrase (in one part), at least one word of any_of if there are any,
        and no word of none_of. The rank sums over terms and parts the part's weight times the term's rarity, ln(1 + (n - d + 0.5) / (d + 0.5)),
        times tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean length)). phrase_hits: places where phrases begin."""
        must, some, never = set(self._words(all_of)), set(self._words(any_of)), sorted(set(self._words(none_of)))
        chains = [c for c in map(self._words, phrases) if c]
        ranked = sorted(must | some | {w for c in chains for w in c})
        must |= {w for c in chains for w in c}
        about, known = self.about(), self.frequencies(ranked)
        rows = self.postings(sorted({*ranked, *never}))
        n, mean = float(about["documents"]), about["mean"] or 1.0
        told, in_chains = [], sorted({w for c in chains for w in c})
        for i, w in enumerate(ranked):
            mine = lambda c, w=w: F.when(F.col("term") == w, F.col(c))
            told += [F.sum(mine("tf")).alias(f"_tf{i}"), F.max(mine("length")).alias(f"_length{i}")]  # the rows of one key add up
        told += [F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("positions")))).alias(f"_at{i}") for i, w in enumerate(in_chains)]
        by_part = rows.groupBy("key", "part").agg(F.max("weight").alias("_weight"), F.collect_set("term").alias("_terms"), *told)

        def score(i: int, w: str) -> Column:
            tf = F.col(f"_tf{i}")
            by_length = 1 - BY_LENGTH + BY_LENGTH * F.col(f"_length{i}") / mean
            return F.coalesce(F.col("_weight") * _rarity(n, known.get(w, 0)) * (tf * (SATURATION + 1) / (tf + SATURATION * by_length)), F.lit(0.0))

        by_part = by_part.withColumn("_rank", reduce(lambda a, b: a + b, [score(i, w) for i, w in enumerate(ranked)], F.lit(0.0)))
        hits = [_chain_hits([F.col(f"_at{in_chains.index(w)}") for w in c]) for c in chains]
        by_part = by_part.select("key", "_rank", "_terms", *[h.alias(f"_hits{i}") for i, h in enumerate(hits)])
        of_key = by_part.groupBy("key").agg(F.sum("_rank").alias("rank"), F.flatten(F.collect_list("_terms")).alias("_terms"), *[F.sum(f"_hits{i}").alias(f"_hits{i}") for i in range(len(chains))])
        kept = of_key
        for w in sorted(must):
            kept = kept.filter(F.array_contains("_terms", w))
        for i in range(len(chains)):
            kept = kept.filter(F.col(f"_hits{i}") > 0)
        if some:
            kept = kept.filter(F.arrays_overlap("_terms", F.array(*map(F.lit, sorted(some)))))
        if never:
            kept = kept.filter(~F.arrays_overlap("_terms", F.array(*map(F.lit, never))))
        if not ranked:
            kept = kept.limit(0)
        total = reduce(lambda a, b: a + b, [F.col(f"_hits{i}") for i in range(len(chains))], F.lit(0).cast("long"))
        return kept.select("key", "rank", total.alias("phrase_hits"))


def _row_postings(weights: Sequence[float], stems: bool, stop_words: Sequence[str], block_words: int = 1 << 20):
    """The postings of each row: its words grouped in Arrow batches. first: whether no earlier part of the row has the term."""
    import pyarrow as pa

    n_parts, stop = len(weights), frozenset(stop_words)

    def block(rows):
        lists = [rows.column(f"part{i}") for i in range(n_parts)]
        sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
        at = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
        part = np.repeat(np.arange(n_parts), [int(n.sum()) for n in sizes])
        coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        spoken, number = [], {}
        code_of = np.full(len(coded.dictionary), -1, np.int64)
        for i, word in enumerate(coded.dictionary.to_pylist()):
            if word not in stop:
                term = stem_word(word) if stems else word
                if (c := number.setdefault(term, len(spoken))) == len(spoken):
                    spoken.append(term)
                code_of[i] = c
        code = code_of[coded.indices.to_numpy(zero_copy_only=False)]
        use = code >= 0
        row, at, part, code = row[use], at[use], part[use], code[use]
        of_row = row * max(len(spoken), 1) + code
        group = of_row * n_parts + part
        order = np.argsort(group, kind="stable")
        group, of_row = group[order], of_row[order]
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(group)) if len(heads) else heads
        owner, head = pa.array(row[order][heads]), of_row[heads]
        first = np.ones(len(heads), bool)
        first[1:] = head[1:] != head[:-1]
        offsets = pa.array(np.append(heads, len(group)).astype(np.int32))
        of_part = part[order][heads]
        return pa.record_batch({
            "term": pa.array(spoken, pa.string()).take(pa.array(code[order][heads])), "key": rows.column("key").take(owner), "part": pa.array(of_part.astype(np.int32)), "weight": pa.array(np.asarray(weights)[of_part]),
            "tf": pa.array(ends - heads), "positions": pa.ListArray.from_arrays(offsets, pa.array(at[order].astype(np.int32))), "length": rows.column("length").take(owner), "first": pa.array(first),
        })

    def run(batches):
        for batch in batches:
            words = np.cumsum(batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(batch):  # a block has about so many words, or one longer row
                b = max(a + 1, int(np.searchsorted(words, (words[a - 1] if a else 0) + block_words, "right")))
                yield block(batch.slice(a, b - a))
                a = b

    return run


def _chain_hits(places: Sequence[Column]) -> Column:
    """How many positions begin a phrase whose words have these positions."""
    empty = F.array().cast("array<int>")
    back = lambda p, i: F.transform(F.coalesce(p, empty), lambda x: x - i)
    moved = [back(p, i) for i, p in enumerate(places)]
    return F.size(reduce(F.array_intersect, moved[1:], F.array_distinct(moved[0]))).cast("long")


def _rarity(n: float, d: int) -> float:
    return math.log(1 + (n - d + 0.5) / (d + 0.5))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")
