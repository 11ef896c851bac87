"""URL filters: explicit rules first, then a path-template tree learned per host.

Host: what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in
lower case; path: from there to ``?``, ``#`` or the end. A null url or one without ``://`` has both empty.

Rules are (host, path) prefixes: a rule fits its host and all subdomains if the path
starts with the rule's path; of those that fit the longest counts.

The tree. A path's segments are first written with ``#`` for each run of digits. Level by level,
below a host and the template so far, a segment becomes ``*`` if

* it is variable: its parent has more than ``MANY`` different segments and it holds less
  than ``RARE`` of the parent's pages; or
* its branch is statistically like the parent's others: the share of distrusted labels lies within ``Z``
  standard errors of the parent's share, and its pages go on as deep as the parent's do on average
  (within ``DEPTH_GAP`` segments).

So branches that behave alike merge, and those that stand out keep their name. Paths are
followed to their end. Segments that all patterns below a template share, as far as each goes, are passed over
at once, up to the first where two differ; so the rounds are as many as branchings stand above one another,
however deep paths are (a crawler trap of thousands of segments, or patterns that each go on a segment
further, take one). Past ``NAMED`` segments an only child is written ``*`` too, which merges
nothing. A template is rejected if its smoothed share of distrusted labels is at least
``REJECT``: ``PRIOR`` pseudo-labels pull it to the host's share, which is pulled to the overall one likewise.

All of it is aggregates and joins on (host, template) tables: a host with a third of all pages is
counted by partial aggregates first, and what is joined are its different patterns.

Repeated rows are judged alike; null ids are kept; without labels the method blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wastelens.llm.common import read, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MANY = 20
RARE = 0.02
Z = 2.0
DEPTH_GAP = 0.5
NAMED = 6
PRIOR = 10.0
REJECT = 0.5
KEY = ["host", "pattern"]


def host_and_path(url: str) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, parts, 1), UPPER, LOWER), F.regexp_extract(u, parts, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. ``rules``: (rule, verdict);
    a rule is a host, then a path that starts with ``/``."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, v in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one overrides
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def pattern_of(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def _shown(segment: Column, level: Column) -> Column:
    """An only child's segment (from 0) as its template shows it."""
    return F.when(level < NAMED, segment).otherwise("*")


def shared_passed(rows: DataFrame) -> DataFrame:
    """``rows`` (host, template, level, rest) moved on over the segments that the patterns of a (host,
    template) share: each agrees with the longest one as far as it goes itself, up to the first place where one does not."""
    group = ["host", "template"]
    longest = rows.groupBy(*group).agg(F.max_by("rest", F.struct(F.size("rest"), "pattern")).alias("longest"))
    first = F.array_position(F.zip_with("rest", "longest", lambda a, b: a.eqNullSafe(b)), False)
    rows = rows.join(longest, group).withColumn("agree", F.when(first == 0, F.size("rest")).otherwise(first - 1).cast("int")).drop("longest")
    fork = rows.where("agree < size(rest)").groupBy(*group).agg(F.min("agree").alias("fork"))
    rows = rows.join(fork, group, "left").withColumn("passed", F.least(F.coalesce("fork", F.size("rest")), F.size("rest")))
    names = F.transform(F.slice("rest", 1, F.col("passed")), lambda s, i: F.concat(F.lit("/"), _shown(s, i + F.col("level"))))
    return rows.withColumns({"template": F.concat("template", F.array_join(names, "")), "level": F.col("level") + F.col("passed"),
                             "rest": F.slice("rest", F.col("passed") + 1, F.size("rest"))}).drop("agree", "fork", "passed")


def templates(pages: DataFrame) -> DataFrame:
    """(host, pattern, template, n, labelled, bad) from (host, pattern, y), one row for each
    pattern; y 1 for a distrusted page, 0 for a trusted one, null without a label."""
    rows = stored(pages.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count("y").alias("labelled"), F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("bad"))
        .withColumn("rest", F.filter(F.split("pattern", "/"), lambda s: s != ""))
        .withColumns({"template": F.lit(""), "level": F.lit(0)}))
    done = [rows.where("size(rest) = 0")]
    while True:
        rows = rows.where("size(rest) > 0")
        if rows.isEmpty():
            break
        rows = stored(shared_passed(rows))
        done.append(rows.where("size(rest) = 0"))
        here = rows.where("size(rest) > 0").withColumn("segment", F.get("rest", F.lit(0))) \
            .withColumn("more", F.size("rest") * F.col("n"))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad", "more")]
        child = here.groupBy("host", "template", "segment").agg(F.first("level").alias("level"), *sums)
        parent = child.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("children"), *[F.sum(c).alias("p_" + c) for c in ("n", "labelled", "bad", "more")])
        rate = F.col("p_bad") / F.greatest(F.col("p_labelled"), F.lit(1))
        own = F.col("bad") / F.greatest(F.col("labelled"), F.lit(1))
        error = F.sqrt(rate * (1 - rate) / F.greatest(F.col("labelled"), F.lit(1)))
        variable = (F.col("children") > MANY) & (F.col("n") < RARE * F.col("p_n"))
        alike = (F.col("children") > 1) & ((F.col("labelled") == 0) | (F.abs(own - rate) <= Z * error)) \
            & (F.abs(F.col("more") / F.col("n") - F.col("p_more") / F.col("p_n")) <= DEPTH_GAP)
        only = _shown(F.col("segment"), F.col("level"))
        named = child.join(parent, ["host", "template"]).select(
            "host", "template", "segment",
            F.when(variable | alike, "*").when(F.col("children") == 1, only).otherwise(F.col("segment")).alias("shown"))
        rows = stored(here.drop("more").join(named, ["host", "template", "segment"]).withColumns({
            "template": F.concat("template", F.lit("/"), "shown"), "level": F.col("level") + 1,
            "rest": F.slice("rest", 2, F.size("rest"))}).drop("segment", "shown"))
        done.append(rows.where("size(rest) = 0"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*KEY, F.concat("template", F.when(F.col("pattern").endswith("/"), "/").otherwise("")).alias("template"),
                      "n", "labelled", "bad")


def purity(rows: DataFrame) -> DataFrame:
    """(host, template, bad_share): smoothed share of distrusted labels."""
    total = rows.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = total[1] / total[0] if total[0] else 0.0
    host = rows.groupBy("host").agg(
        ((F.sum("bad") + PRIOR * overall) / (F.sum("labelled") + PRIOR)).alias("host_share"))
    leaf = rows.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    return leaf.join(host, "host").select(
        "host", "template", ((F.col("bad") + PRIOR * F.col("host_share")) / (F.col("labelled") + PRIOR)).alias("bad_share"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_share) of each page. ``labelled``: (_page, y)
    with y 1 for distrusted pages; a page labelled twice counts by its larger label."""
    host, path = host_and_path(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")) \
        .withColumn("pattern", pattern_of(F.col("path")))
    known = labelled.groupBy("_page").agg(F.max("y").alias("y"))
    rows = templates(base.join(known, F.col("page_id") == F.col("_page"), "left").select(*KEY, "y"))
    verdicts = rows.select(*KEY, "template").join(purity(rows), ["host", "template"])
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    return base.join(verdicts, KEY, "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(ruled, F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        "template", F.round("bad_share", 9).alias("bad_share"))


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(_page, y): a page shows the document whose number ends its path; low quality is distrusted."""
    number = F.regexp_extract(host_and_path("url")[1], r"([0-9]{1,18})[^0-9/]*/?$", 1)
    shown = pages.select(F.col("page_id").alias("_page"), number.try_cast("long").alias("_doc"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(
        (1 - F.min("quality").cast("int")).alias("y"))
    return shown.join(known, "_doc").select("_page", "y")


def op3_url_templates(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, page_labels(pages, read(spark, sf_dir, "labels")), RULES)
