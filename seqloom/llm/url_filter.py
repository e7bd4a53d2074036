"""URL verdicts by rules and, beyond them, by a tree of path templates for each host.

What rules decide labels the URLs that they fit. The tree of a host parts its paths segment by
segment: segments that few of a node's URLs have are variable and become one wildcard, branches
that look alike (how paths go on below them, and the share of blocked among their labelled URLs)
are merged, and each branch has the share of blocked URLs, smoothed by its parent's. Templates
whose share is above a limit are rejected. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column, fresh

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Host and path behind the first ://.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ALLOW, BLOCK = "allow", "block"
#: The name of variable segments; digits within a segment are one mark.
ANY, DIGITS = "*", "#"
#: Keys with over one row in so many are looked up in a broadcast: there are fewer than this.
HOT = 1_000


@dataclass(frozen=True)
class Limits:
    """What makes a template. A segment is a branch of its own if it has one in `share` of its
    node's URLs and `least` of them, so a node has at most share branches and a wildcard. Branches
    are alike if the parts of their URLs that end there, and that go on with digits, differ by
    at most `shape`, and their blocked shares by less than `z` standard errors. `smooth` is the
    weight of the parent's share; over `reject` a template is rejected. Segments from `depth` on
    don't part templates."""

    share: int = 20
    least: int = 3
    shape: float = 0.25
    z: float = 1.96
    smooth: float = 4.0
    reject: float = 0.75
    depth: int = 8


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and without ://."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), _UPPER, _UPPER.lower()), F.regexp_extract(text, URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if there is none.

    Rules are (verdict, text), text a host and the start of a path. One fits its host and all
    subdomains. Of rules of one length block comes first, then the order of their texts.
    """
    chosen, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == BLOCK, [-ord(c) for c in r[1]])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        chosen, verdict = F.when(fits, text).otherwise(chosen), F.when(fits, what).otherwise(verdict)
    return chosen, verdict


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows with the row of found of their key. found has each key once and, as weight, how many
    rows have it: keys with over one in HOT are broadcast, the others are dealt by a shuffle, so
    that no task meets more than a thousandth of the rows with one key."""
    total = found.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) * HOT > total
    most = F.broadcast(found.where(hot).drop(weight))
    return rows.join(most, keys).unionByName(rows.join(F.broadcast(most.select(*keys)), keys, "left_anti").join(found.where(~hot).drop(weight), keys))


def _level(live: DataFrame, i: int, limits: Limits, scratch: Scratch) -> DataFrame:
    """live(host, node, pattern, segments, n, allow, block, purity), a level down."""
    here, on = F.get("segments", F.lit(i)), F.get("segments", F.lit(i + 1))
    sums = [F.sum(c).alias(c) for c in ("n", "allow", "block")]
    ends, digits = F.sum(F.when(on.isNull(), F.col("n")).otherwise(0)), F.sum(F.when(F.contains(on, F.lit(DIGITS)), F.col("n")).otherwise(0))
    children = scratch.keep(live.groupBy("host", "node", here.alias("segment")).agg(*sums, F.max("purity").alias("purity"), F.count(F.lit(1)).alias("rows"), ends.alias("ends"), digits.alias("digits")), f"children-{i}")
    totals = scratch.keep(children.groupBy("host", "node").agg(F.sum("n").alias("total"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("children")), f"totals-{i}")
    own = (F.col("n") * limits.share >= F.col("total")) & (F.col("n") >= limits.least)
    marked = lookup(children.drop("rows"), totals.drop("rows"), ["host", "node"], "children").withColumn("branch", F.when(own, F.col("segment")).otherwise(ANY))
    branches = marked.groupBy("host", "node", "branch").agg(*sums, F.max("purity").alias("purity"), F.sum("ends").alias("ends"), F.sum("digits").alias("digits"))
    # Windows within a node meet at most share + 1 branches.
    labelled = F.col("allow") + F.col("block")
    branches = branches.withColumns({"m": labelled, "rate": F.when(labelled > 0, F.col("block") / labelled).otherwise(F.lit(0.0)), "ended": F.col("ends") / F.col("n"), "numbered": F.col("digits") / F.col("n")})
    kind = F.when(F.col("ended") >= 0.5, 0).when(F.col("numbered") >= 0.5, 1).otherwise(2)
    order = Window.partitionBy("host", "node").orderBy(F.col("m") > 0, kind, "rate", "branch")
    before = {c: F.lag(c).over(order) for c in ("m", "block", "rate", "ended", "numbered")}
    branches = branches.withColumns({f"p_{c}": x for c, x in before.items()})
    both = F.try_divide(F.col("block") + F.col("p_block"), F.col("m") + F.col("p_m"))
    gap = F.col("rate") - F.col("p_rate")
    apart = (F.col("m") > 0) & (gap * gap > limits.z * limits.z * both * (1 - both) * (F.try_divide(F.lit(1.0), F.col("m")) + F.try_divide(F.lit(1.0), F.col("p_m"))))
    unlike = (F.abs(F.col("ended") - F.col("p_ended")) > limits.shape) | (F.abs(F.col("numbered") - F.col("p_numbered")) > limits.shape) | ((F.col("m") > 0) != (F.col("p_m") > 0)) | apart
    branches = branches.withColumn("new", F.when(F.col("p_m").isNull() | unlike, 1).otherwise(0)).withColumn("part", F.sum("new").over(order))
    part = Window.partitionBy("host", "node", "part")
    share = (F.sum("block").over(part) + limits.smooth * F.col("purity")) / (F.sum("m").over(part) + limits.smooth)
    named = branches.select("host", "node", "branch", F.struct(F.array_join(F.array_sort(F.collect_list("branch").over(part)), "|").alias("name"), share.alias("purity")).alias("entry"))
    nodes = named.groupBy("host", "node").agg(F.map_from_entries(F.collect_list(F.struct("branch", "entry"))).alias("branches"))
    nodes = scratch.keep(nodes.join(totals.select("host", "node", "rows"), ["host", "node"]), f"nodes-{i}")  # a row per node on both sides
    entry = F.coalesce(F.try_element_at("branches", here), F.try_element_at("branches", F.lit(ANY)))
    down = lookup(live.drop("purity"), nodes, ["host", "node"], "rows").withColumn("entry", entry)
    return down.select("host", F.concat("node", F.lit("/"), "entry.name").alias("node"), "pattern", "segments", "n", "allow", "block", "entry.purity")


def templates(labelled: DataFrame, scratch: Scratch, limits: Limits = Limits()) -> DataFrame:
    """(host, pattern, template, purity, n) of labelled(host, pattern, label): paths whose digits are
    marked, the template that they come to in their host's tree and its smoothed blocked share.

    A share is smoothed by that of the branch above, a host's by that of all labelled URLs.
    """
    count = lambda what: F.count_if(F.col("label") == what)
    paths = scratch.keep(labelled.groupBy("host", "pattern").agg(F.count(F.lit(1)).alias("n"), count(ALLOW).alias("allow"), count(BLOCK).alias("block")), "paths")
    whole = paths.agg(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    overall = (whole[1] + 1) / (whole[0] + whole[1] + 2)
    hosts = paths.groupBy("host").agg(((F.sum("block") + limits.smooth * overall) / (F.sum("allow") + F.sum("block") + limits.smooth)).alias("purity"), F.count(F.lit(1)).alias("rows"))
    segments = F.when(F.col("pattern") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("pattern", 2, 1 << 30), "/"))
    rows = lookup(paths, scratch.keep(hosts, "hosts"), ["host"], "rows").select("host", F.lit("").alias("node"), "pattern", segments.alias("segments"), "n", "allow", "block", "purity")
    found = []
    for i in range(limits.depth + 1):
        rows = scratch.keep(rows, f"level-{i}")
        ended = (F.size("segments") <= i) | F.lit(i == limits.depth)
        found.append(rows.where(ended))
        live = rows.where(~ended)
        if live.isEmpty():
            break
        rows = _level(live, i, limits, scratch)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select("host", "pattern", F.col("node").alias("template"), "purity", "n")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], *, url_col: str = "url", limits: Limits = Limits()) -> DataFrame:
    """pages with host, path, rule, template, purity and verdict.

    The verdict is that of the longest rule that fits; without one, block if the smoothed share of
    blocked URLs of the path's template is over limits.reject, else allow. Labels are what rules
    decide. A null URL or one without :// has an empty host and path, which are judged like others.
    Repeated rows are URLs of their own; an empty table gives no rows. Columns that are named like
    the results are replaced, all others stay.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    names = ["host", "path", "rule", "template", "purity", "verdict"]
    held = [c for c in pages.columns if c not in names]
    (doc,) = fresh(pages, "doc")
    rows = pages.select(F.struct(*[column(c) for c in held]).alias(doc), *[x.alias(c) for c, x in zip(("host", "path"), parts(column(url_col)))])
    rule, label = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(doc, "host", "path", rule.alias("rule"), label.alias("label"), F.regexp_replace("path", "[0-9]+", DIGITS).alias("pattern"))
    found = scratch.keep(templates(rows, scratch, limits), "templates")
    joined = lookup(rows, found, ["host", "pattern"], "n")
    verdict = F.coalesce("label", F.when(F.col("purity") > limits.reject, BLOCK).otherwise(ALLOW))
    return joined.select(*[column(c, doc).alias(c) for c in held], "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
