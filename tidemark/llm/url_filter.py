"""URL filter by a path-template tree, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

#: A segment in less than this share of the urls of its place is variable, and becomes a wildcard. Up to 1 / RARE segments of a place are left.
RARE = 0.01
#: Siblings are alike if the affinity of what follows them, the sum of sqrt(p * q), is at least ALIKE, and that of names in it, which ids and ends are not, NAMED.
ALIKE, NAMED = 0.9, 0.5
#: A template is rejected if (blocked + PRIOR) / (labelled + 2 * PRIOR) is at least PURITY.
PRIOR, PURITY = 1.0, 0.8
#: Siblings whose smoothed shares of blocked labels differ by more are not alike.
APART = 0.5
#: Rejected branches that may be sent to every task.
FEW_BRANCHES = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path prefix).
Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part after the first :// up to / ? or #, A-Z lower-cased, and then up to ? or #; both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none does) and its verdict."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in reversed(ordered):
        own, _, prefix = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """All segments of the path, ids as *. Ids are numbers, long hexadecimal numbers and segments with four digits or more; a file's ending is dropped."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(F.regexp_like(s, F.lit(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$|^[0-9a-fA-F-]{8,}$|([^0-9]*[0-9]){4}")), F.lit("*")).otherwise(s))


def alike_siblings(children: DataFrame, below: DataFrame) -> DataFrame:
    """(host, template, own, lead): siblings with the largest one that they are alike to, if it is larger.

    children (host, template, own, n, labelled, hits) are the literal segments of each place, at most 1 / RARE;
    below (host, template, own, follows, k) counts what follows them. So a row meets at most 1 / RARE others.
    """
    place = ["host", "template"]
    shares = below.join(children, [*place, "own"]).select(*place, "own", "n", "labelled", "hits", "follows", (F.col("k") / F.col("n")).alias("p"))
    x, y = shares.alias("x"), shares.alias("y")
    larger = (F.col("y.n") > F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.own") < F.col("x.own")))
    both = x.join(y, (F.col("x.host") == F.col("y.host")) & (F.col("x.template") == F.col("y.template")) & (F.col("x.follows") == F.col("y.follows")) & larger)
    common = F.sqrt(F.col("x.p") * F.col("y.p"))
    smoothed = lambda s: (F.col(f"{s}.hits") + PRIOR) / (F.col(f"{s}.labelled") + 2 * PRIOR)
    apart = (F.col("x.labelled") > 0) & (F.col("y.labelled") > 0) & (F.abs(smoothed("x") - smoothed("y")) > APART)
    met = both.where(~apart).groupBy("x.host", "x.template", "x.own", F.col("y.own").alias("other"), F.col("y.n").alias("other_n"))
    named = F.when(F.col("x.follows").isin("*", ""), 0.0).otherwise(common)
    met = met.agg(F.round(F.sum(common), 9).alias("affinity"), F.round(F.sum(named), 9).alias("named")).where((F.col("affinity") >= ALIKE) & (F.col("named") >= NAMED))
    best = met.groupBy(*place, "own").agg(F.max("other_n").alias("most"))
    return met.join(best, [*place, "own"]).where("other_n = most").groupBy(*place, "own").agg(F.min("other").alias("lead"))


def templates(tree: DataFrame) -> DataFrame:
    """tree (host, branch, n, labelled, hits), one row per distinct branch of a host, with `template`.

    The template grows by one segment a level. Segments that are rare at their place become *, and
    siblings that are alike become the largest of them, labelled or not; deeper levels then see them as one.
    A branch that is alone under its template keeps its other segments, so the levels end where the tree stops branching.
    """
    state, done, level = cut(tree.withColumn("template", F.slice("branch", 1, 0))), None, 0
    place = ["host", "template"]
    while True:
        shared = state.groupBy(*place).agg(F.count(F.lit(1)).alias("branches"), F.sum("n").alias("total"))
        rows = state.join(shared, place).withColumn("own", F.get("branch", F.lit(level)))
        ended = rows.where("own is null or branches = 1").select("host", "branch", "n", "labelled", "hits", F.concat("template", F.slice("branch", F.lit(level + 1), F.size("branch"))).alias("template"))
        done = ended if done is None else done.union(ended)
        rows = cut(rows.where("own is not null and branches > 1").withColumn("follows", F.coalesce(F.get("branch", F.lit(level + 1)), F.lit(""))))
        if rows.isEmpty():
            return cut(done)
        children = rows.groupBy(*place, "own").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("hits").alias("hits"), F.first("total").alias("total"))
        children = cut(children.where("own != '*'").withColumn("rare", F.col("n") < RARE * F.col("total")))
        literal = children.where("not rare").select(*place, "own", "n", "labelled", "hits")
        below = rows.groupBy(*place, "own", "follows").agg(F.sum("n").alias("k"))
        leads = alike_siblings(literal, below)
        names = children.join(leads, [*place, "own"], "left").select(*place, "own", F.when(F.col("rare"), F.lit("*")).otherwise(F.coalesce("lead", "own")).alias("name"))
        grown = rows.join(names, [*place, "own"], "left").withColumn("template", F.concat("template", F.array(F.coalesce("name", "own"))))
        state, level = cut(grown.select("host", "branch", "n", "labelled", "hits", "template")), level + 1


def rejected_branches(urls: DataFrame) -> DataFrame:
    """(host, branch) of the branches whose template is rejected, from urls (host, branch: segments, blocked: 1, 0 or null).

    All work after the first aggregation is on distinct branches of a host. In a
    template of several branches each labelled one has one vote, its share of
    blocked labels, as the urls of a branch are no independent evidence about others.
    """
    tree = urls.groupBy("host", "branch").agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("hits"))
    named = templates(tree)
    found = named.groupBy("host", "template").agg(F.count(F.lit(1)).alias("branches"), F.sum("labelled").alias("labelled"), F.sum("hits").alias("hits"), F.count_if(F.col("labelled") > 0).alias("voters"), F.sum(F.when(F.col("labelled") > 0, F.col("hits") / F.col("labelled"))).alias("votes"))
    many = F.col("branches") > 1
    blocked, of = F.when(many, F.coalesce("votes", F.lit(0.0))).otherwise(F.col("hits").cast("double")), F.when(many, F.col("voters")).otherwise(F.col("labelled"))
    bad = found.where(F.round((blocked + PRIOR) / (of + 2 * PRIOR), 9) >= PURITY).select("host", "template")
    return cut(named.join(bad, ["host", "template"], "left_semi").select("host", "branch"))


def filter_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url).

    The longest rule that fits decides. Its verdicts are also the labels from which
    the template tree learns, per host, which kinds of path are blocked; a url without
    a rule is blocked if its template is rejected, else allowed. A template without
    labels has purity 0.5 and is allowed. Null urls have empty host and path and are
    allowed unless a rule fits; repeated rows stay, and an empty table gives none.
    Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("branch", segments(F.col("path")))
    bad = rejected_branches(judged.select("host", "branch", (F.col("ruled") == "block").cast("int").alias("blocked")))
    # urls with a rule need no template; a key of their own keeps them spread
    key = F.when(F.col("rule").isNull(), F.concat_ws("/", F.lit("t"), "host", F.array_join("branch", "/"))).otherwise(F.concat(F.lit("r"), F.xxhash64("page_id", "path").cast("string")))
    bad = cut(bad.select(F.concat_ws("/", F.lit("t"), "host", F.array_join("branch", "/")).alias("key"), F.lit("block").alias("learned")).distinct())
    bad = F.broadcast(bad) if bad.count() <= FEW_BRANCHES else bad
    return judged.withColumn("key", key).join(bad, "key", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "learned", F.lit("allow")).alias("verdict"))
