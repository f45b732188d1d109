"""URL filter by a tree of path templates for each host, with DataFrame functions only.

A path is a row of segments, of any number.  A segment becomes a wildcard by its look (digits, ids of
letters and digits), or because its siblings below the same parent are many; that is asked until no segment
changes, since parents become the same when the segments above them do.  The generalised paths of a host, its
templates, are the leaves of a tree of prefixes.

Labels are what is known of some urls: the verdict of the rule that fits, or words that speak for
spam.  A node's purity is the share of blocked urls below it, where a url without label counts by the share of its
host.  Siblings whose purities a two-sample test cannot tell apart are merged and share their counts.
From the host down, every node's purity is smoothed towards its parent's.  A url that no rule fits is blocked
by the odds of its template and of its own words together: a template that is mostly blocked takes
urls without any such word along, and a word in a clean branch is not enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import joined_by_key, restored, set_aside, written

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Siblings of a varying segment: at least so many, and so many for each url below their parent.
SIBLINGS, SPREAD = 12, 0.2
#: Weight of the next wider share, and standard errors up to which siblings are merged.
PRIOR, SIMILAR = 4.0, 2.0
#: Digits to which shares are equal: of siblings with equal shares, which no test can tell apart, one row stands for all.
DIGITS = 12
#: How often blocked and other urls have a word that speaks for spam; the odds above which a url is blocked.
WORD_IF_BAD, WORD_IF_GOOD, REJECT = 0.6, 0.01, 1.0
#: Words in a host or path that speak for spam (fixed values).
SPAM = r"(?i)(?:^|[^a-z])(?:spam|casino|poker|bets?|betting|pills?|viagra|cialis|porn|xxx|escorts?|payday|adserver|malware|phishing|warez)(?:[^a-z]|$)"
FROM, TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), FROM, TO), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one goes before
        name = F.when(fits(host, path, rule), rule[1] + rule[2]).otherwise(name)
        verdict = F.when(fits(host, path, rule), rule[0]).otherwise(verdict)
    return name, verdict


def looks(segment: Column) -> Column:
    """The segment with what varies by its look made a wildcard: runs of digits, and letters with three of them or more between."""
    return F.regexp_replace(F.regexp_replace(segment, "[0-9]+", "*"), r"(?:[A-Za-z]*\*){3,}[A-Za-z]*", "*")


def share(bad: Column, n: Column, prior: Column) -> Column:
    return (bad + F.lit(PRIOR) * prior) / (n + F.lit(PRIOR))


def levels(paths: DataFrame, *keep: str) -> DataFrame:
    """A row for every segment of every path: ``level`` (from 0), ``parent`` (a hash of the segments before) and ``segment``."""
    start = F.struct(F.lit(0).cast("long").alias("hash"), F.array().cast("array<long>").alias("before"))
    before = F.aggregate("segs", start, lambda s, x: F.struct(F.xxhash64(s["hash"], x).alias("hash"), F.array_append(s["before"], s["hash"]).alias("before")))["before"]
    rows = paths.select(*keep, F.posexplode(F.arrays_zip(before.alias("before"), F.col("segs").alias("segs"))).alias("level", "at"))
    return rows.select(*keep, "level", F.col("at.before").alias("parent"), F.col("at.segs").alias("segment"))


def generalised(paths: DataFrame) -> tuple[DataFrame, bool]:
    """``paths`` (``id, host, segs, n`` and others) with wildcards for the segments that vary below their parent, and whether there are any."""
    nodes = levels(paths, "host", "n").groupBy("host", "level", "parent", "segment").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    below = nodes.groupBy("host", "level", "parent").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    varies = written(below.where((F.col("kinds") >= SIBLINGS) & (F.col("kinds") >= SPREAD * F.col("n"))).select("host", "level", "parent", "rows"), "varies")
    if varies.isEmpty():  # a segment that has become a wildcard is alone below its parent
        return paths, False
    found = joined_by_key(levels(paths, "id", "host").drop("segment"), varies, ["host", "level", "parent"])
    wild = found.groupBy("id").agg(F.collect_set("level").alias("wild"))
    segs = F.transform("segs", lambda s, i: F.when(F.array_contains("wild", i), "*").otherwise(s))
    return paths.join(wild, "id", "left").withColumn("segs", F.when(F.col("wild").isNull(), F.col("segs")).otherwise(segs)).select(*paths.columns), True


def merged_siblings(nodes: DataFrame) -> DataFrame:
    """``host, level, parent, segment, rows`` with the counts ``n`` and ``bad`` of the group of similar siblings that each is in.

    Siblings in order of their shares: a step where two neighbours differ by more than the error of two
    samples begins a new group.  Of siblings with equal shares one row stands for all, so that a parent has no more rows
    to order than its siblings have different shares; those with few urls, which are most, have few."""
    nodes = nodes.withColumn("step", F.round(F.col("bad") / F.col("n"), DIGITS))
    steps = nodes.groupBy("host", "level", "parent", "step").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("rows"))
    order = Window.partitionBy("host", "level", "parent").orderBy("step")
    before = {k: F.lag(k).over(order) for k in ("n", "bad")}
    both = (F.col("bad") + before["bad"]) / (F.col("n") + before["n"])
    error = F.sqrt(F.greatest(F.lit(0.0), both * (1 - both)) * (1 / F.col("n") + 1 / before["n"]))
    apart = F.coalesce((F.col("bad") / F.col("n") - before["bad"] / before["n"] > SIMILAR * error + 1e-9).cast("int"), F.lit(0))
    steps = steps.withColumn("apart", apart).withColumn("group", F.sum("apart").over(order))
    whole = Window.partitionBy("host", "level", "parent", "group")
    steps = steps.select("host", "level", "parent", "step", "rows", F.sum("n").over(whole).alias("n"), F.sum("bad").over(whole).alias("bad"))
    own = nodes.select("host", "level", "parent", "segment", "step", F.col("rows").alias("below"))
    return joined_by_key(own, steps, ["host", "level", "parent", "step"]).select("host", "level", "parent", "segment", "n", "bad", F.col("below").alias("rows"))


def template_shares(rows: DataFrame) -> DataFrame:
    """``host, key, share, rows``: the smoothed purity of every path's template.  ``rows``: ``host, key, segs, bad`` for each url
    (``key``: the path by its look; ``bad``: 1 blocked, 0 allowed, null not labelled)."""
    paths = rows.groupBy("host", "key").agg(F.any_value("segs").alias("segs"), F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    paths = written(paths.withColumn("id", F.monotonically_increasing_id()), "paths")
    total = paths.agg(F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.0))).first()[0]  # one number
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("bad").alias("host_bad"), F.count("*").alias("rows"))
    hosts = hosts.select("host", share(F.col("host_bad"), F.col("host_n"), F.lit(total)).alias("host_share"), "rows")
    changed = True
    while changed:  # as often as varying segments are nested
        paths, changed = generalised(paths)
        paths = written(paths, "paths") if changed else paths
    # A url without label counts by its host's share.
    paths = joined_by_key(paths.withColumn("template", F.concat_ws("/", "segs")), hosts, ["host"])
    paths = written(paths.withColumn("bad", F.col("bad") + (F.col("n") - F.col("labelled")) * F.col("host_share")), "paths")
    templates = paths.groupBy("host", "template").agg(F.any_value("segs").alias("segs"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.any_value("host_share").alias("host_share"), F.count("*").alias("rows"))
    templates = written(templates.withColumn("id", F.monotonically_increasing_id()), "templates")
    nodes = levels(templates, "host", "n", "bad").groupBy("host", "level", "parent", "segment").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("rows"))
    nodes = merged_siblings(written(nodes, "nodes"))
    above = joined_by_key(levels(templates, "id", "host"), nodes, ["host", "level", "parent", "segment"])
    above = above.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("level", "n", "bad"))).alias("above"))
    smoothed = F.aggregate("above", F.col("host_share"), lambda s, x: share(x["bad"], x["n"], s))
    shares = templates.join(above, "id", "left").select("host", "template", F.coalesce(smoothed, "host_share").alias("share"), "rows")
    return joined_by_key(paths.select("host", "key", "n", "template"), shares, ["host", "template"]).select("host", "key", "share", F.col("n").alias("rows"))


def judged_urls(pages: DataFrame, rules=RULES, url: str = "url", label: Column | None = None) -> DataFrame:
    """Judges every url.  Adds ``host, path, rule`` (null if none fits), ``share`` (the purity of its template; null if a
    rule fits) and ``verdict`` to the rows.  ``label``: what else is known of a row (1 blocked, 0 allowed, else null).

    A null url or one without ``://`` has an empty host and path and is judged like any other url
    of that host.  Repeated rows repeat and count as often; an empty table gives an empty table; columns named like the
    new ones are replaced; odds that are exactly even allow.  A path may have any number of segments."""
    new = ("host", "path", "rule", "share", "verdict")
    given = F.lit(None).cast("int") if label is None else label.cast("int")
    df = set_aside(pages, url, _label=given)
    kept = [c for c in df.columns if c != "_label"]
    df = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    word = F.col("host").rlike(SPAM) | F.col("path").rlike(SPAM)
    segs = F.filter(F.transform(F.split("path", "/"), looks), lambda s: s != "")
    df = df.withColumns({"rule": name, "_verdict": verdict, "_word": word, "segs": segs})
    bad = F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", 0).otherwise(F.coalesce("_label", F.when(F.col("_word"), 1)))
    df = written(df.withColumns({"key": F.concat_ws("/", "segs"), "bad": bad}).drop("_label"), "urls")
    shares = template_shares(df.select("host", "key", "segs", "bad"))
    ready = df.where("_verdict is not null").select(*kept, "host", "path", "rule", F.lit(None).cast("double").alias("share"), F.col("_verdict").alias("verdict"))
    rest = joined_by_key(df.where("_verdict is null").select(*kept, "host", "path", "rule", "key", "_word"), shares, ["host", "key"])
    told = F.when(F.col("_word"), WORD_IF_BAD / WORD_IF_GOOD).otherwise((1 - WORD_IF_BAD) / (1 - WORD_IF_GOOD))
    blocked = F.col("share") * told > REJECT * (1 - F.col("share"))
    out = ready.union(rest.select(*kept, "host", "path", "rule", "share", F.when(blocked, "block").otherwise("allow").alias("verdict")))
    return restored(out, pages.columns, *new)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url", "share")


def oracle() -> str:
    """The same in SQL, node by node."""
    names, verdicts = [], []
    for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fit = f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND path LIKE '{path}%'"
        names.append(f"{fit} THEN '{host}{path}'")
        verdicts.append(f"{fit} THEN '{verdict}'")
    at = "array_to_string(list_slice(segs, 1, level - 1), '/')"
    below = "(PARTITION BY host, level, parent)"
    # A segment is counted once for each parent; rounds go on as long as one varies.
    rounds = f"""turns AS (SELECT 0 AS turn, host, key, n, labelled, bad, segs FROM p0 WHERE len(segs) > 0
 UNION ALL SELECT turn + 1, host, key, any_value(n), any_value(labelled), any_value(bad), list(CASE WHEN varies THEN '*' ELSE segment END ORDER BY level) FROM (
  SELECT *, bool_or(varies) OVER () AS changes FROM (SELECT *, sum(once) OVER {below} >= {SIBLINGS} AND sum(once) OVER {below} >= {SPREAD} * sum(n) OVER {below} AS varies FROM (
   SELECT *, CASE WHEN row_number() OVER (PARTITION BY host, level, parent, segment) = 1 THEN 1 ELSE 0 END AS once FROM (
    SELECT *, {at} AS parent, segs[level] AS segment FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS level FROM turns) a) b) c) d) e WHERE changes GROUP BY turn, host, key),
done AS (SELECT host, key, n, labelled, bad, segs FROM turns WHERE turn = (SELECT max(turn) FROM turns) UNION ALL SELECT host, key, n, labelled, bad, segs FROM p0 WHERE len(segs) = 0)"""
    share = lambda bad, n, prior: f"({bad} + {PRIOR} * {prior}) / ({n} + {PRIOR})"
    return f"""WITH RECURSIVE cut AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{FROM}', '{TO}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (SELECT *, CASE {" ".join(names)} END AS rule, CASE {" ".join(verdicts)} END AS given, regexp_matches(host, '{SPAM}') OR regexp_matches(path, '{SPAM}') AS word,
 list_filter(list_transform(string_split(path, '/'), lambda s: regexp_replace(regexp_replace(s, '[0-9]+', '*', 'g'), '(?:[A-Za-z]*\\*){{3,}}[A-Za-z]*', '*', 'g')), lambda s: s <> '') AS segs FROM parts),
r AS (SELECT *, array_to_string(segs, '/') AS key, CASE WHEN given = 'block' THEN 1 WHEN given = 'allow' THEN 0 WHEN word THEN 1 END AS bad FROM named),
p0 AS (SELECT host, key, count(*) AS n, count(bad) AS labelled, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, any_value(segs) AS segs FROM r GROUP BY host, key),
{rounds},
whole AS (SELECT coalesce(sum(bad) / sum(n), 0.0) AS g FROM p0),
hosts AS (SELECT host, {share("sum(bad)", "sum(n)", "(SELECT g FROM whole)")} AS host_share FROM p0 GROUP BY host),
q AS (SELECT p.host, key, n, bad + (n - labelled) * host_share AS bad, host_share, segs, array_to_string(segs, '/') AS template FROM done p JOIN hosts USING (host)),
t AS (SELECT host, template, any_value(segs) AS segs, sum(n) AS n, sum(bad) AS bad, any_value(host_share) AS host_share FROM q GROUP BY host, template),
te AS (SELECT *, {at} AS parent, segs[level] AS segment FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS level FROM t) x),
nodes AS (SELECT host, level, parent, segment, sum(n) AS n, sum(bad) AS bad, round(sum(bad) / sum(n), {DIGITS}) AS step FROM te GROUP BY host, level, parent, segment),
steps AS (SELECT host, level, parent, step, sum(n) AS n, sum(bad) AS bad FROM nodes GROUP BY host, level, parent, step),
beside AS (SELECT *, lag(n) OVER o AS n0, lag(bad) OVER o AS b0 FROM steps WINDOW o AS (PARTITION BY host, level, parent ORDER BY step)),
parted AS (SELECT *, CASE WHEN bad / n - b0 / n0 > {SIMILAR} * sqrt(greatest(0.0, (bad + b0) / (n + n0) * (1 - (bad + b0) / (n + n0))) * (1 / n + 1 / n0)) + 1e-9 THEN 1 ELSE 0 END AS apart FROM beside),
grouped AS (SELECT *, sum(apart) OVER (PARTITION BY host, level, parent ORDER BY step) AS grp FROM parted),
pooled AS (SELECT host, level, parent, step, sum(n) OVER g AS n, sum(bad) OVER g AS bad FROM grouped WINDOW g AS (PARTITION BY host, level, parent, grp)),
above AS (SELECT te.host, te.template, te.level, pooled.n, pooled.bad FROM te JOIN nodes USING (host, level, parent, segment) JOIN pooled ON pooled.host = te.host AND pooled.level = te.level AND pooled.parent = te.parent AND pooled.step = nodes.step),
down AS (SELECT host, template, len(segs) AS depth, 0 AS level, host_share AS share FROM t
 UNION ALL SELECT d.host, d.template, d.depth, d.level + 1, {share("a.bad", "a.n", "d.share")} FROM down d JOIN above a ON a.host = d.host AND a.template = d.template AND a.level = d.level + 1)
SELECT page_id, r.host, path, rule, CASE WHEN given IS NOT NULL THEN given WHEN share * CASE WHEN word THEN {WORD_IF_BAD / WORD_IF_GOOD} ELSE {(1 - WORD_IF_BAD) / (1 - WORD_IF_GOOD)} END > {REJECT} * (1 - share) THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN q ON r.host = q.host AND r.key = q.key JOIN down d ON d.host = q.host AND d.template = q.template AND d.level = d.depth"""
