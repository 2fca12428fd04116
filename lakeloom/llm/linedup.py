"""Line de-duplication by an exact set-similarity join.

All of it is DataFrame functions. Lines are cut from the texts once; their places are stored apart from their words.
Classes are stored in buckets: a line's words cross the network once to get there, and again only for lines in a pair.

A line is the set of its words after lower-casing; it goes if an earlier line, by (doc_id, line
number), has a Jaccard similarity of ``percent`` or more with it. Matches are judged on the
input, not on what is left.

1. *Classes.* Equal lines (lower-cased, all white space a space) are one class from the start; its
   place is that of its first line. Words are counted, ordered and posted once a class, however often it occurs.
2. *Rarity.* The words of all classes are counted in 2**20 hash buckets. Words are ordered by the
   logarithm of their bucket's count, in 16 levels, then by hash; any order gives the same result.
   A word that is alone in its bucket is level 0, is in one class only and is not posted.
3. *Prefix filter.* Of n words in that order a class posts the first n - ceil(t n) + 1: two sets that
   match have a posted word in common. A posting has the word, the class, its place in the
   prefix, the size, and a 64-bit parity map of the whole set.
4. *Filters in the join.* Sizes must be within ``percent`` of each other (length filter); from the
   first common word on, both sets must have enough words left (positional filter); and the
   parity maps may differ in no more bits than the sets may in words. The shorter set of a pair
   needs fewer postings, so the others are left out of its side.
5. *Lists.* Words are counted as they are posted, but for those whose bucket proves them rare. A list of at most
   ``SHORT`` postings is joined with itself. Longer lists are dealt to groups of about ``GROUP`` classes, in which all are tried against the first
   one: that finds most members of large families of near copies. Classes that are not
   known to be late by then are tried against the earlier ones of the list, so that a family whose members match its first
   one makes no more pairs than it has members; lists that may have more than ``LONG`` are split by size classes. The length of a list is its exact number of postings, not a bound from buckets.
6. *Verification* of the pairs that are left, on the words of both lines. A map of 64 bits is full
   long before a set has hundreds of words, so pairs of long lines first meet by maps of 256 bits.

Classes are told apart by 64-bit hashes of their lines, words by 64-bit hashes until they are verified.

Defined results: null text has no lines; lines without words stay; a text's last line may lack
its newline; rows that share a doc_id share their places (equal lines at the same place stay);
a null doc_id is before any other; columns beyond doc_id and text are carried along; a line may
have any number of words.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, fresh_names

BUCKETS, BUCKET_SHIFT, LEVELS, BIT_SLOTS = 1 << 20, 44, 16, 1 << 14
LEVEL_SHIFT = 59
SHORT, LONG, GROUP = 256, 4096, 64
WIDE, WIDE_FROM = 4, 96
ODD_SPACES = "\t\x0b\f\r"


def _normal(text: str) -> Column:
    """Lower-cased, with a space for all white space but newlines."""
    odd = F.lit(False)
    for c in ODD_SPACES:
        odd = odd | F.contains(F.col(text), F.lit(c))
    return F.lower(F.when(odd, F.translate(F.col(text), ODD_SPACES, " " * len(ODD_SPACES))).otherwise(F.col(text)))


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def _slots(numbers: np.ndarray) -> Column:
    """A constant array of longs."""
    return F.split(F.lit(",".join(map(str, numbers.tolist()))), ",").cast("array<bigint>")


class Membership:
    """A filter of fixed size over longs: drops most rows whose long is not in the table, none whose long is.
    Its BIT_SLOTS rows of 64 bits are broadcast to a join, so that no plan holds the table."""

    def __init__(self, table: DataFrame, column: str, name: str):
        self.column, self.slot, self.bits = column, f"__slot_{name}", f"__bits_{name}"
        self.table = table.groupBy(self._slot().alias(self.slot)).agg(F.bit_or(_bit(F.col(column))).alias(self.bits))

    def _slot(self) -> Column:
        return F.shiftright(self.column, 6).bitwiseAND(F.lit(BIT_SLOTS - 1))

    def _has(self) -> Column:
        return (self._slot() == F.col(self.slot)) & (F.col(self.bits).bitwiseAND(_bit(F.col(self.column))) != 0)

    def keep(self, rows: DataFrame) -> DataFrame:
        """The rows whose long may be in the table."""
        return rows.join(F.broadcast(self.table), self._has(), "left_semi")

    def drop(self, rows: DataFrame) -> DataFrame:
        """The others."""
        return rows.join(F.broadcast(self.table), self._has(), "left_anti")


def _words(line: str) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _bit(h: Column) -> Column:
    return _shift("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)))


def _hashes(line: str) -> Column:
    """The hashes of a line's words, each once. Words are between single spaces but for some, whose gaps hash as empty words."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


class Rarity:
    """The levels of words, by the logarithm of the count of their bucket, as a table of four bits for each of 2**20 buckets.
    Level 0 has the words that are alone in their bucket; the others are equal steps of the logarithm up to the largest one."""

    PARTS = 4  # of a factor of two; a count's logarithm fits a byte
    EACH = 16  # levels in a long

    def __init__(self, classes: DataFrame, scratch: Scratch):
        words = classes.select(F.explode(F.split("s", " ")).alias("w")).filter("w <> ''")
        counts = words.groupBy(F.shiftrightunsigned(F.xxhash64("w"), BUCKET_SHIFT).alias("b")).agg(F.count("*").alias("n"))
        # no logarithm is 0 but that of a single word: 2 has PARTS
        log = _shift("shiftleft", F.floor(F.log2("n") * self.PARTS + 1e-9).cast("long"), F.col("b").bitwiseAND(F.lit(7)) * 8)
        packed = counts.groupBy(F.shiftright("b", 3).alias("slot")).agg(F.bit_or(log).alias("logs"))
        packed = scratch.save(packed, "counts").toArrow()  # at most 2**17 rows
        logs = np.zeros(BUCKETS // 8, np.int64)
        logs[packed.column("slot").to_numpy()] = packed.column("logs").to_numpy()
        logs = logs.view(np.uint8)
        self.step = int(logs.max(initial=0)) // (LEVELS - 1) + 1
        levels = np.where(logs == 0, 0, 1 + logs // self.step).astype(np.uint64).reshape(-1, self.EACH)
        self.table = _slots(np.bitwise_or.reduce(levels << (np.arange(self.EACH, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64))

    def key(self, h: Column) -> Column:
        """A long that sorts rare words first: the level, then 59 bits of hash."""
        slot = F.get(self.table, F.shiftrightunsigned(h, BUCKET_SHIFT + 4).cast("int"))
        level = _shift("shiftrightunsigned", slot, F.shiftrightunsigned(h, BUCKET_SHIFT - 2).bitwiseAND(F.lit(60))).bitwiseAND(F.lit(LEVELS - 1))
        return F.coalesce(F.shiftleft(level, LEVEL_SHIFT), F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(h, 64 - LEVEL_SHIFT))

    def most(self, level: int) -> int:
        """The largest count that a level can stand for."""
        return int(2 ** (level * self.step / self.PARTS))


class LineJoin:
    """The join of one corpus's lines with its earlier lines."""

    def __init__(self, spark: SparkSession, docs: DataFrame, percent: int = 80):
        self.spark, self.docs, self.percent, self.scratch = spark, docs, percent, Scratch(spark)

    def _lines(self) -> DataFrame:
        """doc_id, th (hash of the text), line, s, class of each line with words."""
        each = self.docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(_normal("text"), "\n")).alias("line", "s"))
        lines = each.filter(F.trim("s") != "").withColumn("class", F.xxhash64("s"))
        return self.scratch.save(lines, "lines")

    @staticmethod
    def _at() -> Column:
        return F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "line")

    def _classes(self, lines: DataFrame) -> DataFrame:
        """class, at (the place of its first line), copies (its lines), s. Stored in buckets by class, so that lines looked up by class stay where they are."""
        each = lines.groupBy("class").agg(F.min(self._at()).alias("at"), F.count("*").alias("copies"), F.any_value("s").alias("s"))
        return self.scratch.save_buckets(each, "classes", "class")

    def _prefixes(self, classes: DataFrame, rarity: Rarity) -> DataFrame:
        """class, at, n, map, prefix: a class's size, parity map, and the keys of its rarest words."""
        hashed = classes.select("class", "at", _hashes("s").alias("h"))
        parity = F.aggregate("h", F.lit(0).cast("long"), lambda seen, h: seen.bitwiseXOR(_bit(h)))
        sized = hashed.select("class", "at", F.size("h").alias("n"), parity.alias("map"), F.sort_array(F.transform("h", rarity.key)).alias("keys"))
        posted = F.col("n") - F.floor((F.col("n").cast("long") * self.percent + 99) / 100).cast("int") + 1
        return self.scratch.save(sized.select("class", "at", "n", "map", F.slice("keys", F.lit(1), posted).alias("prefix")), "prefixes")

    def _fits(self) -> Column:
        """The filters on a pair of postings x and y of one word."""
        p, both = self.percent, F.col("x.n") + F.col("y.n")
        length = 100 * F.least("x.n", "y.n") >= p * F.greatest("x.n", "y.n")
        places = (100 + p) * F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= p * both
        maps = (100 + p) * F.bit_count(F.col("x.map").bitwiseXOR(F.col("y.map"))) <= (100 - p) * both
        return length & places & maps

    def _in_short_role(self) -> Column:
        """Whether a posting can meet a set of at least its own size."""
        return (100 + self.percent) * (F.col("n") - F.col("pos")) >= 2 * self.percent * F.col("n")

    @staticmethod
    def _ordered() -> Column:
        return (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.class") < F.col("y.class")))

    @staticmethod
    def _pairs(joined: DataFrame) -> DataFrame:
        return joined.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))

    def _short_lists(self, postings: DataFrame) -> DataFrame:
        """Pairs within lists that have a proven bound. Both sides are the same exchange."""
        dealt = postings.repartition("token")
        return self._pairs(dealt.alias("x").join(dealt.alias("y"), (F.col("x.token") == F.col("y.token")) & self._ordered() & self._fits()))

    def _hot(self, prefixes: DataFrame, rarity: Rarity) -> DataFrame:
        """token, list: the words posted more than SHORT times, with that number."""
        proven = sum(rarity.most(v) <= SHORT for v in range(LEVELS))
        tokens = prefixes.select(F.explode("prefix").alias("token")).filter(F.shiftright("token", LEVEL_SHIFT) >= proven)
        return self.scratch.save(tokens.groupBy("token").agg(F.count("*").alias("list")).filter(F.col("list") > SHORT), "hot")

    def _against_first(self, lists: DataFrame) -> DataFrame:
        """Pairs of each class with the first one of its group of each list."""
        dealt = lists.withColumn("group", F.pmod(F.xxhash64("class", "token"), F.ceil(F.col("list") / GROUP)))
        first = dealt.groupBy("token", "group").agg(F.min(F.struct("at", "class", "n", "map", "pos")).alias("f")).select("token", "group", "f.*")
        return self._pairs(dealt.alias("x").join(first.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.group") == F.col("y.group")) & (F.col("x.class") != F.col("y.class")) & self._fits()))

    def _long_lists(self, lists: DataFrame, late: DataFrame) -> DataFrame:
        """Pairs within the longer lists, except those whose later class is known to be late. Lists up to LONG meet in one
        exchange, the longest are split by size."""
        size = F.log(F.col("n").cast("double")) / math.log(100 / self.percent)
        may_be_late = Membership(late, "class", "late")
        some = may_be_late.keep(lists).join(late.withColumn("late", F.lit(True)), "class", "left").withColumn("late", F.coalesce("late", F.lit(False)))
        postings = may_be_late.drop(lists).withColumn("late", F.lit(False)).unionByName(some)
        split = F.col("list") > LONG
        is_open = (~F.col("x.late") & (F.col("y.at") < F.col("x.at"))) | (~F.col("y.late") & (F.col("x.at") < F.col("y.at")))
        others = self._ordered() & self._fits() & is_open
        dealt = postings.filter(~split).repartition("token")
        mid = dealt.filter(self._in_short_role()).alias("x").join(dealt.alias("y"), (F.col("x.token") == F.col("y.token")) & others)
        mid = self.scratch.save(self._pairs(mid).distinct(), "pairs-mid")
        x = postings.filter(split).filter(self._in_short_role()).withColumn("band", F.explode(F.sequence(F.floor(size - 1e-9), F.floor(size + 1 + 1e-9))))
        y = postings.filter(split).withColumn("band", F.floor(size))
        same = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band"))
        return mid.union(self._pairs(x.alias("x").join(y.alias("y"), same & others))).distinct()

    @staticmethod
    def _postings(prefixes: DataFrame, *more: str) -> DataFrame:
        return prefixes.select("class", "n", "map", *more, F.posexplode("prefix").alias("pos", "token")).filter(F.col("token") >= 1 << LEVEL_SHIFT)

    def _late(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The later class of each pair whose words are similar enough."""
        ids = self.scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "ids")
        wanted = classes.select("class", "at", "s").join(ids.hint("shuffle_hash"), "class")  # the buckets of classes are read as they are
        wanted = self.scratch.save(wanted.withColumn("n", F.size(F.array_distinct(_words("s")))), "wanted")
        # up to WIDE_FROM words the map in the postings says enough
        words = wanted.filter(F.col("n") > WIDE_FROM).select("class", F.explode(F.array_distinct(_words("s"))).alias("w")).select("class", F.xxhash64("w").alias("h"))
        maps = [f"m{i}" for i in range(WIDE)]
        part, bit = F.shiftright("h", 6).bitwiseAND(F.lit(WIDE - 1)), _bit(F.col("h"))
        wide = words.groupBy("class").agg(*[F.bit_xor(F.when(part == i, bit).otherwise(F.lit(0).cast("long"))).alias(m) for i, m in enumerate(maps)])
        wide = self.scratch.save(wanted.select("class", "n").join(wide, "class", "left"), "wide")
        x, y = (wide.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), *[F.col(m).alias(f"{m}_{c}") for m in maps]) for c in "ab")
        differ = sum((F.coalesce(F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))), F.lit(0)) for m in maps), F.lit(0))
        both = F.col("n_a").cast("long") + F.col("n_b")
        may_be_alike = (100 + self.percent) * differ <= (100 - self.percent) * both
        near = pairs.join(x, "a").join(y, "b").filter(may_be_alike).select("a", "b", both.alias("both"))
        full = near.join(wanted.select(F.col("class").alias("b"), F.col("at").alias("at_b"), F.col("s").alias("s_b")), "b")
        full = full.join(wanted.select(F.col("class").alias("a"), F.col("at").alias("at_a"), F.col("s").alias("s_a")), "a")
        alike = full.filter((100 + self.percent) * F.size(F.array_intersect(_words("s_a"), _words("s_b"))) >= self.percent * F.col("both"))
        return alike.select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).when(F.col("at_b") < F.col("at_a"), F.col("a")).alias("class")).filter("class is not null").distinct()

    def late_classes(self, classes: DataFrame) -> DataFrame:
        """The classes that have an earlier similar one."""
        save = self.scratch.save
        rarity = Rarity(classes, self.scratch)
        prefixes = self._prefixes(classes, rarity)
        hot = self._hot(prefixes, rarity)
        is_hot = Membership(hot, "token", "hot")
        long = is_hot.keep(self._postings(prefixes, "at")).join(hot, "token", "left").withColumn("list", F.coalesce("list", F.lit(SHORT)))
        lists = save(long, "lists")
        short = self._short_lists(is_hot.drop(self._postings(prefixes)))
        early = save(short.union(self._against_first(lists)).distinct(), "pairs-1")
        self.scratch.drop("prefixes", "hot")
        first = save(self._late(early, classes), "late-1")
        rest = save(self._long_lists(lists, first).join(early, ["a", "b"], "left_anti"), "pairs-2")
        second = save(self._late(rest, classes), "late-2")
        self.scratch.drop("lists", "pairs-1", "pairs-2", "pairs-mid", "wanted", "wide", "ids")
        return first.union(second).distinct()

    def removed_lines(self) -> DataFrame:
        """doc_id, th, gone: the sorted numbers of the lines that go."""
        lines = self._lines()
        classes = self._classes(lines)
        places = self.scratch.save(lines.select("doc_id", "th", "line", "class"), "places")
        self.scratch.drop("lines")
        late = self.late_classes(classes).withColumn("late", F.lit(True))
        heads = classes.filter("copies > 1").select("class", F.col("at").alias("head"))
        marked = self.scratch.save(heads.join(late, "class", "full").select("class", "head", F.coalesce("late", F.lit(False)).alias("late")), "marked")
        self.scratch.drop("classes")
        found = Membership(marked, "class", "marked").keep(places).join(marked, "class")
        is_copy = F.col("head").isNotNull() & (self._at() != F.col("head"))
        gone = found.filter(F.col("late") | is_copy).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line")).alias("gone"))
        gone = self.scratch.save(gone, "gone")
        self.scratch.drop("places", "late-1", "late-2", "marked")
        return gone


def _kept(lines: Column, gone: Column) -> Column:
    """The lines without those at the sorted numbers in gone, joined again. One pass over each list."""
    before = F.concat(F.array(F.lit(-1)), gone)
    marks = F.array_join(F.zip_with(gone, F.slice(before, 1, F.size(gone)), lambda a, b: F.lpad(F.lit("1"), a - b, "0")), "")
    flags = F.split(marks, "")
    return F.array_join(F.zip_with(F.slice(lines, 1, F.size(lines)), F.slice(flags, 1, F.size(lines)), lambda s, f: F.when(F.coalesce(f, F.lit("0")) != "1", s)), "\n")


def dedup_lines(spark: SparkSession, docs: DataFrame, percent: int = 80, names: tuple = ("n_lines", "n_removed")) -> DataFrame:
    """The rows of docs with their text cut, and the numbers of lines and of removed ones under the two names."""
    d, h, th, cut = fresh_names(docs.columns, "__d", "__h", "__th", "__gone")
    gone = LineJoin(spark, docs, percent).removed_lines().withColumnsRenamed({"doc_id": d, "th": h, "gone": cut})
    both = docs.withColumn(th, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(th) == F.col(h)), "left")
    split = F.split("text", "\n")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(_kept(split, F.col(cut)))
    n_lines, n_removed = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)), F.coalesce(F.size(cut), F.lit(0))
    n_removed = F.when(F.col(cut).isNull(), F.lit(0)).otherwise(n_removed)
    return both.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], n_lines.cast("long").alias(names[0]), n_removed.cast("long").alias(names[1]))
