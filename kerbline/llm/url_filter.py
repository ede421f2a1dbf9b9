"""URL filtering by rules and by a path-template tree that is learned from labelled pages.

Per host, the tree is built from the root, one branching at a time, to the last segment of each path. Under a node,
segments with digits become a wildcard. A child whose share of bad labels can't be told from its siblings' merges with the wildcard
too, however many or few they are. The children that can are merged with one another where their shares are alike: those whose
shares fall into one of BINS bins, and neighbouring bins that can't be told apart. Such a branch is called by its first child's name
with a ``#`` behind it, which no path has. A template is rejected if its smoothed share of bad labels reaches ``threshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import ascii_lower, cut

#: Segments that the SQL looks at, which the given tables do not reach; the tree has no such bound.
DEPTH = 4
MIN_Z = 2.0
BINS = 10
PRIOR = 5.0
MIN_LABELS = 5
THRESHOLD = 0.5
#: (host, path, verdict); a rule fits a host and its subdomains where the path begins with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://``: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _share(bad: Column, labelled: Column, prior_share: Column) -> Column:
    return (bad + F.lit(PRIOR) * prior_share) / (labelled + F.lit(PRIOR))


def _apart(b1: Column, n1: Column, b2: Column, n2: Column, min_z: float) -> Column:
    """Whether two shares of bad labels differ by ``min_z`` deviations."""
    pooled = (b1 + b2 + 1) / (n1 + n2 + 2)
    gap = (b1 + 1) / (n1 + 2) - (b2 + 1) / (n2 + 2)
    return gap * gap > F.lit(min_z * min_z) * (pooled * (1 - pooled) * (1 / (n1 + 2) + 1 / (n2 + 2)))


def _few(min_z: float) -> int:
    """The most labels, MIN_LABELS at most, that can be dealt to two children in no way that tells these apart; -1 if there is no such number."""

    def apart(b1, n1, b2, n2):
        pooled, gap = (b1 + b2 + 1) / (n1 + n2 + 2), (b1 + 1) / (n1 + 2) - (b2 + 1) / (n2 + 2)
        return gap * gap > min_z * min_z * pooled * (1 - pooled) * (1 / (n1 + 2) + 1 / (n2 + 2))

    ok = -1
    for n in range(MIN_LABELS + 1):
        if any(apart(b1, n1, b2, n - n1) for n1 in range(n + 1) for b1 in range(n1 + 1) for b2 in range(n - n1 + 1)):
            break
        ok = n
    return ok


def _merged(named: DataFrame, min_z: float) -> DataFrame:
    """(host, template, bin, as): the names of merged branches of the children (host, template, seg, c_labelled, c_bad, bin) that stand out."""
    c = F.col
    bins = named.groupBy("host", "template", "bin").agg(F.sum("c_labelled").alias("n"), F.sum("c_bad").alias("b"), F.min("seg").alias("first"), F.count("*").alias("children"))
    ordered = Window.partitionBy("host", "template").orderBy("bin")  # BINS rows at most
    apart = _apart(c("b"), c("n"), F.lag("b").over(ordered), F.lag("n").over(ordered), min_z)
    bins = bins.withColumn("apart", F.coalesce(apart, F.lit(True))).withColumn("branch", F.sum(c("apart").cast("int")).over(ordered))
    branch = Window.partitionBy("host", "template", "branch")
    several = F.sum("children").over(branch) > 1
    return bins.select("host", "template", "bin", F.concat(F.min("first").over(branch), F.when(several, "#").otherwise("")).alias("as"))


def template_tree(urls: DataFrame, min_z: float = MIN_Z) -> DataFrame:
    """(host, path, template) for each distinct (host, path) of ``urls`` (host, path, labelled, bad).

    The table is reduced to distinct paths first, with counts. Each round takes the paths that have a further segment. A node with too few labels
    for any children to be told apart is done at once: all below is wildcards. Where all paths of a node go on with the same segments, which
    is seen by the first and the last of them, it takes these in one step. So rounds follow the branchings that labels can tell, not the
    longest path.
    """
    c = F.col
    few = _few(min_z)
    seg = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s))
    paths = cut(
        urls.groupBy("host", "path")
        .agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        .select("host", "path", "labelled", "bad", seg.alias("segments"), F.lit("").alias("template"), F.lit(0).alias("pos"))
    )
    whole = paths.where(F.size("segments") == 0)
    rows = paths.where(F.size("segments") > 0)
    while not rows.isEmpty():
        rows = rows.withColumn("seg", F.get("segments", c("pos"))).withColumn("rest", F.slice("segments", c("pos") + 2, F.size("segments")))
        children = rows.groupBy("host", "template", "seg").agg(
            F.sum("labelled").alias("c_labelled"), F.sum("bad").alias("c_bad"), F.min("rest").alias("low"), F.max("rest").alias("high")
        )
        # nodes are summed from their children: no task sees more than one row for each of these
        nodes = children.groupBy("host", "template").agg(
            F.sum("c_labelled").alias("n_labelled"),
            F.sum("c_bad").alias("n_bad"),
        )
        rest_labelled, rest_bad = c("n_labelled") - c("c_labelled"), c("n_bad") - c("c_bad")
        differs = (c("seg") != "*") & _apart(c("c_bad"), c("c_labelled"), rest_bad, rest_labelled, min_z)
        share = (c("c_bad") + 1) / (c("c_labelled") + 2)
        marked = children.join(nodes, ["host", "template"]).select(
            "host", "template", "seg", "c_labelled", "c_bad", "low", "high", F.when(differs, F.floor(share * BINS)).otherwise(-1).alias("bin")
        )
        marked = cut(marked)
        named = marked.join(_merged(marked.where("bin >= 0"), min_z), ["host", "template", "bin"], "left").withColumn("as", F.coalesce("as", F.lit("*")))
        below = named.groupBy("host", "template", "as").agg(
            F.sum("c_labelled").alias("n"), F.sum("c_bad").alias("b"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        # an only child stands apart from no siblings or doesn't; along a chain of these the answer is one
        same = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False)
        chain = F.when(c("n") <= few, F.array().cast("array<string>")).otherwise(F.slice("low", 1, F.when(same == 0, F.size("low")).otherwise((same - 1).cast("int"))))
        alone = _apart(c("b"), c("n"), F.lit(0), F.lit(0), min_z)
        below = below.select(
            "host", "template", "as", (c("n") <= few).alias("few"), (F.size(chain) + 1).alias("step"),
            F.array_join(F.concat(F.array(F.lit(""), c("as")), F.transform(chain, lambda s: F.when(alone, s).otherwise("*"))), "/").alias("on"),
        )
        step = named.select("host", "template", "seg", "as").join(below, ["host", "template", "as"]).drop("as")
        pos = c("pos") + c("step")
        left = F.size("segments") - pos
        ended = F.when(c("few"), F.repeat(F.lit("/*"), left)).otherwise("")
        paths = cut(
            rows.join(step, ["host", "template", "seg"]).select(
                "host", "path", "labelled", "bad", "segments", F.concat("template", "on", ended).alias("template"),
                F.when(c("few"), F.size("segments")).otherwise(pos).alias("pos"),
            )
        )
        whole = whole.unionByName(paths.where(c("pos") >= F.size("segments")))
        rows = paths.where(c("pos") < F.size("segments"))
    return whole.select("host", "path", "template", "labelled", "bad")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    threshold: float = THRESHOLD,
    min_labels: int = MIN_LABELS,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, bad_share.

    ``labels`` (doc_id, quality, toxic) marks pages by id: bad if toxic = 1 or quality = 0, unlabelled if both are null or there is no
    row; of several rows for an id, one bad row makes it bad. A null url, or one without ``://``, has empty host and path and is judged
    with the others of that kind. Templates with fewer than ``min_labels`` labels are allowed. Other columns are not read.
    """
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(
        F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0
    )
    marks = labels.select(F.col("doc_id").alias("marked"), bad.alias("b")).where("marked is not null and b is not null")
    marks = marks.groupBy("marked").agg(F.max("b").alias("b"))
    url = F.col(f"`{url_col}`")
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    marked = base.join(marks, F.col("page_id") == F.col("marked"), "left")
    marked = cut(
        marked.select(
            "page_id", "host", "path", F.when(F.col("b").isNull(), 0).otherwise(1).alias("labelled"), F.coalesce("b", F.lit(0)).alias("bad")
        )
    )
    tree = template_tree(marked)
    whole = marked.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = ((whole[0] or 0) + 1) / ((whole[1] or 0) + 2)
    judged = tree.groupBy(F.col("host").alias("h"), "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    share = _share(F.col("bad"), F.col("labelled"), F.lit(prior))
    judged = judged.select(
        "h", F.col("template").alias("t"), share.alias("bad_share"),
        F.when((F.col("labelled") >= min_labels) & (share >= threshold), "block").otherwise("allow").alias("learned"),
    )
    by_path = tree.join(judged, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t"))).select(
        F.col("host").alias("of_host"), F.col("path").alias("of_path"), "template", "bad_share", "learned"
    )
    by_path = cut(by_path)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return marked.join(by_path, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path"))).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("learned")).alias("verdict"), "template", "bad_share"
    )
