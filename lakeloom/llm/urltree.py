"""URL filters by a path-template tree, with DataFrame functions only.

Urls are cut into host and path. Rules decide first: a rule (host, path) fits its host and all
subdomains if the path starts with the rule's; the longest wins. What no rule covers is decided
by the tree:

1. *Shapes.* Digits and long hexadecimal runs of a segment become ``{n}`` and ``{x}``. Urls are
   counted by host and shape path before anything is grouped, so a host with a third of all
   urls is a few rows from here on.
2. *Wildcards.* From the root down, a node with more than ``fanout`` children turns the children
   that hold less than ``least_share`` of its urls into ``*``.
3. *Merging.* Siblings whose distribution over the next level overlaps with their node's by at
   least ``overlap``, and whose share of blocked labels is within two standard errors of the
   node's, in the host and over all hosts, become ``*`` too.
4. *Purity.* Labels are the urls that rules decide. A node's purity is the share of blocked ones, smoothed with
   ``strength`` labels' weight by the mean of its parent's purity and that of the same node in the tree of all
   hosts together, from the base rate of all labels over the host down to the template. So a host without
   labels is judged by what its templates are elsewhere. Templates of at least ``reject`` purity are blocked.

Levels beyond ``depth`` are one ``**`` segment.

Defined results: a null url or one without ``://`` has an empty host and path and is judged as
host '' (no rule fits); without any labels the base rate is ``prior``; repeated rows are judged each; urls of any
length are cut into segments whole; columns beyond page_id and url are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: list[Rule]) -> Column:
    """The name of the longest rule that fits host and path, or null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        found = F.when(fits, F.lit(r.name)).otherwise(found)
    return found


def _shape(segment: Column) -> Column:
    s = F.regexp_replace(segment, r"(?<![0-9A-Za-z])[0-9a-fA-F]*[0-9][0-9a-fA-F]{7,}(?![0-9A-Za-z])", "{x}")
    return F.regexp_replace(s, r"[0-9]+(?![^{]*\})", "{n}")


def shape_path(path: str, depth: int) -> Column:
    parts = F.filter(F.split(F.col(path), "/"), lambda s: s != "")
    head = F.transform(F.slice(parts, 1, depth), _shape)
    return F.when(F.size(parts) > depth, F.concat(head, F.array(F.lit("**")))).otherwise(head)


class TemplateTree:
    def __init__(self, depth: int = 4, fanout: int = 20, least_share: float = 0.02, overlap: float = 0.9, strength: float = 8.0, prior: float = 0.2, reject: float = 0.5):
        self.depth, self.fanout, self.least_share, self.overlap = depth, fanout, least_share, overlap
        self.strength, self.prior, self.reject = strength, prior, reject

    def _generalise(self, paths: DataFrame, level: int) -> DataFrame:
        """Turns rare children at a level into wildcards. template holds the levels above as they are now.

        Children are counted by aggregation and met again by joins: a host's paths may be as many as its urls here.
        """
        up = F.slice("template", 1, level) if level else F.array().cast("array<string>")
        x = paths.withColumn("__up", up).withColumn("__c", F.get("template", F.lit(level)))
        kids = x.filter("__c is not null").groupBy("host", "__up", "__c").agg(F.sum("n").alias("__own"))
        nodes = kids.groupBy("host", "__up").agg(F.count("*").alias("__kinds"), F.sum("__own").alias("__n")).filter(F.col("__kinds") > self.fanout)
        rare = kids.join(nodes, ["host", "__up"]).filter(F.col("__own") < self.least_share * F.col("__n")).select("host", "__up", "__c", F.lit(True).alias("__rare"))
        x = x.join(rare, ["host", "__up", "__c"], "left")
        return x.select(*[c for c in paths.columns if c != "template"], F.when(F.coalesce("__rare", F.lit(False)), self._with_star(level)).otherwise(F.col("template")).alias("template"))

    def _with_star(self, level: int) -> Column:
        return F.transform("template", lambda s, i: F.when(i == level, F.lit("*")).otherwise(s))

    def _merge(self, paths: DataFrame, level: int) -> DataFrame:
        """Turns children that are like their node into one wildcard branch."""
        x = paths.withColumn("__up", F.slice("template", 1, level) if level else F.array().cast("array<string>")).withColumn("__c", F.get("template", F.lit(level))).withColumn("__next", F.coalesce(F.get("template", F.lit(level + 1)), F.lit("")))
        node = Window.partitionBy("host", "__up")
        total = lambda c, *by: F.sum(c).over(Window.partitionBy("host", "__up", *by))
        x = x.withColumn("__n", F.sum("n").over(node)).withColumn("__nl", F.sum("labelled").over(node)).withColumn("__nb", F.sum("blocked").over(node))
        x = x.withColumn("__next_n", total("n", "__next")).withColumn("__cn", total("n", "__c")).withColumn("__cl", total("labelled", "__c")).withColumn("__cb", total("blocked", "__c")).withColumn("__cnext", total("n", "__c", "__next"))
        common = F.least(F.col("__cnext") / F.col("__cn"), F.col("__next_n") / F.col("__n")) * F.col("n") / F.col("__cnext")
        x = x.withColumn("__overlap", F.sum(common).over(Window.partitionBy("host", "__up", "__c")))
        # the same branch and its siblings in the trees of all hosts together
        key = [F.col("__up"), F.coalesce("__c", F.lit("")).alias("__k")]
        pooled = x.groupBy(*key).agg(F.sum("labelled").alias("__pl"), F.sum("blocked").alias("__pb"))
        pooled = pooled.join(pooled.groupBy("__up").agg(F.sum("__pl").alias("__pnl"), F.sum("__pb").alias("__pnb")), "__up")
        x = x.withColumn("__k", F.coalesce("__c", F.lit(""))).join(pooled, ["__up", "__k"])

        def alike(l: str, b: str, all_l: str, all_b: str) -> Column:
            p = (F.col(all_b) + self.prior) / (F.col(all_l) + 1)
            off = F.abs((F.col(b) + p) / (F.col(l) + 1) - p)
            return ((F.col(l) == 0) == (F.col(all_l) == 0)) & (off <= 2 * F.sqrt(p * (1 - F.least(p, F.lit(1.0))) / (F.col(l) + 1)))

        same = F.col("__c").isNotNull() & (F.col("__c") != "**") & (F.col("__cn") < F.col("__n")) & (F.col("__overlap") >= self.overlap) & alike("__cl", "__cb", "__nl", "__nb") & alike("__pl", "__pb", "__pnl", "__pnb")
        keep = [c for c in paths.columns if c != "template"]
        return x.select(*keep, F.when(same, self._with_star(level)).otherwise(F.col("template")).alias("template"))

    def fit(self, spark: SparkSession, labelled: DataFrame, scratch: Scratch) -> DataFrame:
        """host, shape, template, purity of each kind of url. labelled: host, path, label (true: blocked; null: unlabelled)."""
        shaped = labelled.select("host", shape_path("path", self.depth).alias("shape"), "label")
        paths = shaped.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count(F.when(F.col("label"), 1)).alias("blocked"))
        paths = scratch.save(paths.withColumn("template", F.col("shape")), "shapes")
        for level in range(self.depth):
            paths = scratch.save(self._generalise(paths, level), f"wild-{level}")
        # from here on a node has a bounded number of children, so its rows are few whatever the host
        few = paths.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        few = few.withColumn("wild", F.col("template"))
        for level in range(self.depth):
            few = scratch.save(self._merge(few, level), f"merge-{level}")
        few = scratch.save(few, "merged")
        levels = few.select("host", "template", "labelled", "blocked", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("level"))
        nodes = levels.groupBy("host", F.slice("template", 1, F.col("level")).alias("node"), "level").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        nodes = scratch.save(nodes, "nodes")
        whole = few.select("host", "template").distinct().select("host", "template", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("level"))
        whole = whole.withColumn("node", F.slice("template", 1, F.col("level"))).join(nodes, ["host", "node", "level"])
        pooled = nodes.groupBy("node", "level").agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
        whole = whole.join(pooled, ["node", "level"])
        chain = whole.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("level", "l", "b", "all_l", "all_b"))).alias("chain"))
        labels = nodes.filter("level = 0").agg(F.sum("l").alias("l"), F.sum("b").alias("b")).first()
        base = F.lit(float(labels["b"]) / labels["l"] if labels["l"] else self.prior)
        weight = F.lit(self.strength)

        def step(p: Column, x: Column) -> Column:
            everywhere = (x["all_b"] + weight * p["everywhere"]) / (x["all_l"] + weight)
            own = (x["b"] + weight * (p["own"] + everywhere) / 2) / (x["l"] + weight)
            return F.struct(everywhere.alias("everywhere"), own.alias("own"))

        purity = F.aggregate("chain", F.struct(base.alias("everywhere"), base.alias("own")), step)["own"]
        scored = chain.select("host", "template", purity.alias("purity"))
        named = few.select("host", "wild", "template").join(scored, ["host", "template"])
        return scratch.save(paths.select("host", "shape", F.col("template").alias("wild")).join(named, ["host", "wild"]).select("host", "shape", "template", "purity"), "templates")


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[Rule], tree: TemplateTree | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of pages."""
    tree, scratch = tree or TemplateTree(), Scratch(spark)
    host, path = split_url()
    cut = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", fitting_rule(rules))
    blocks = [r.name for r in rules if r.block]
    label = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocks))
    cut = scratch.save(cut.withColumn("label", label).withColumn("shape", shape_path("path", tree.depth)), "urls")
    templates = tree.fit(spark, cut.select("host", "path", "label"), scratch)
    both = cut.join(templates, ["host", "shape"])
    blocked = F.coalesce(F.col("label"), F.col("purity") >= tree.reject)
    template = F.concat(F.lit("/"), F.array_join("template", "/"))
    return both.select("page_id", "host", "path", "rule", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), template.alias("template"), "purity")
