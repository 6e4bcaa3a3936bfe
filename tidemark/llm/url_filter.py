"""URL verdicts: explicit rules, else a tree of path templates per host with labelled purity.

Templates: the distinct (host, path) pairs, with their row and label counts, descend level by level until their
paths end. Below one node of a host's tree a segment position becomes the wildcard ``*`` when its values vary
(at least VARIES distinct values, with fewer than ROWS_PER_VALUE rows each); else a number, with or without an
extension, becomes ``*``, and branches whose labelled rate does not differ from that of their siblings together by
more than Z deviations of the difference are merged into one branch, ``~``, and go on as one; a branch with fewer than
LEAST labels, or whose siblings have fewer, stays apart. A node of fewer than VARIES paths can't vary
any more: what is left of its paths is written down at once, numbers as ``*``, so only nodes that many deep
paths share take further levels. A template is rejected when its smoothed purity, (bad + PRIOR * host's rate) /
(labelled + PRIOR) with the host's rate smoothed by the overall rate in the same way, reaches REJECT; one without
labels is allowed.

Each level is one aggregate of counts by branch, written out, and one join with it, which Spark can split
where one host or branch holds many rows; no host's paths are gathered in one task.

Rules: (host, path, verdict). A rule fits its host and every subdomain when the path starts with the
rule's; the longest host + path wins, then block before allow, then the smaller text. Host suffixes
are joined to the rules, so there may be any number of them.

Defined results: null url or none with ``://`` has empty host and path, fits no rule and is judged by
the template of the empty host; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

VARIES, ROWS_PER_VALUE, Z, LEAST, PRIOR, REJECT = 8, 20.0, 1.96, 5, 20.0, 0.8
NUMBER = r"^[0-9]+([.][A-Za-z0-9]+)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def templates(urls: DataFrame, scratch: Scratch) -> DataFrame:
    """``urls``: distinct host, path with n, labelled, bad. Returns host, path, template, n_labelled, purity."""
    done = []
    u = urls.select("host", "path", "n", "labelled", "bad", F.split("path", "/").alias("seg"), F.lit("").alias("tmpl"))
    starred = lambda x: F.when(x.rlike(NUMBER), F.lit("*")).otherwise(x)
    d = 0
    while True:
        # A path starts with "/", so the first piece of the split is what stands before it.
        here = u.withColumn("s", F.get("seg", F.lit(d + 1)))
        branch = here.where("s is not null").groupBy("host", "tmpl", "s").agg(F.count("*").alias("paths"), *(F.sum(c).alias(c) for c in ("n", "labelled", "bad")))
        branch = scratch.put(branch, "branches")
        node = branch.groupBy("host", "tmpl").agg(F.sum("paths").alias("all_paths"), F.count("*").alias("values"), F.sum("n").alias("rows"), F.sum("labelled").alias("pl"), F.sum("bad").alias("pb"))
        # The branch against its siblings together: two proportions, both with evidence.
        others, others_bad = F.col("pl") - F.col("labelled"), F.col("pb") - F.col("bad")
        rate = (F.col("pb") + 1) / (F.col("pl") + 2)
        apart = F.abs(F.try_divide(F.col("bad"), F.col("labelled")) - F.try_divide(others_bad, others))
        near = apart <= Z * F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), others)))
        alike = F.coalesce((F.col("labelled") >= LEAST) & (others >= LEAST) & near, F.lit(False))
        varies = (F.col("values") >= VARIES) & (F.col("rows") < F.col("values") * ROWS_PER_VALUE)
        step = F.when(varies | F.col("s").rlike(NUMBER), F.lit("*")).when((F.col("values") > 1) & alike, F.lit("~")).otherwise(F.col("s"))
        steps = branch.join(scratch.put(node, "nodes"), ["host", "tmpl"]).where(F.col("all_paths") >= VARIES)
        steps = scratch.put(steps.select("host", "tmpl", "s", step.alias("step")), "steps")
        here = scratch.put(here.join(steps, ["host", "tmpl", "s"], "left"), "urls")
        rest = F.transform(F.slice("seg", F.lit(d + 2), F.size("seg")), starred)
        ended = here.where("step is null").withColumn("tmpl", F.when(F.col("s").isNull(), F.col("tmpl")).otherwise(F.concat("tmpl", F.lit("/"), F.array_join(rest, "/"))))
        done.append(ended.select("host", "path", "tmpl", "labelled", "bad"))
        u = here.where("step is not null").withColumn("tmpl", F.concat("tmpl", F.lit("/"), "step")).drop("s", "step")
        d += 1
        if u.isEmpty():
            break
    known = done[0]
    for x in done[1:]:
        known = known.union(x)
    # Purity with the host's rate, itself smoothed by the overall rate, as the prior.
    per = scratch.put(known.groupBy("host", F.col("tmpl").alias("template")).agg(F.sum("labelled").alias("n_labelled"), F.sum("bad").alias("n_bad")), "templates")
    total = per.agg(F.coalesce(F.try_divide(F.sum("n_bad"), F.sum("n_labelled")), F.lit(0.0)).alias("rate"))
    hosts = per.groupBy("host").agg(F.sum("n_labelled").alias("hl"), F.sum("n_bad").alias("hb")).crossJoin(total)  # one row
    hosts = scratch.put(hosts.select("host", ((F.col("hb") + PRIOR * F.col("rate")) / (F.col("hl") + PRIOR)).alias("host_rate")), "hosts")
    per = per.join(hosts, "host").select("host", "template", "n_labelled", ((F.col("n_bad") + PRIOR * F.col("host_rate")) / (F.col("n_labelled") + PRIOR)).alias("purity"))
    per = scratch.put(per, "purities")
    return known.withColumnRenamed("tmpl", "template").join(per, ["host", "template"]).select("host", "path", "template", "n_labelled", "purity")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, rule_verdict for the urls that a rule fits."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    fit = urls.select("host", "path", F.explode(suffixes).alias("rule_host")).join(r, "rule_host").where(F.startswith("path", F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = F.min(F.struct((-F.length(text)).alias("l"), (F.col("verdict") != "block").alias("v"), text.alias("rule"), F.col("verdict")))
    return fit.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", F.col("b.verdict").alias("rule_verdict"))


def judge(pages: DataFrame, rules: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template, n_labelled, purity.

    ``pages``: page_id, url; ``rules``: host, path, verdict; ``labels``: page_id, bad (0 or 1).
    """
    scratch = Scratch(pages.sparkSession)
    seen = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    marked = labels.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    urls = (
        seen.join(marked, "page_id", "left")
        .groupBy("host", "path")
        .agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    )
    urls = scratch.put(urls, "counted")
    known = templates(urls, scratch).join(fitting_rules(urls, rules), ["host", "path"], "left")
    known = scratch.put(known, "known")
    verdict = F.coalesce("rule_verdict", F.when((F.col("purity") >= REJECT) & (F.col("n_labelled") > 0), "block").otherwise("allow"))
    return seen.join(known, ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "n_labelled", "purity")
