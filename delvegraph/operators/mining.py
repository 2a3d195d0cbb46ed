"""Change-history mining over ``commits(commit_id, ts, author, ordinal)`` and ``commit_files(commit_id, file)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delvegraph.operators.history import newest_first_windows

HALF_LIFE_DAYS = 182.5
BULK = 30


def sized(commit_files: DataFrame, most: int = BULK) -> DataFrame:
    """Distinct (commit_id, file) without bulk commits of more than ``most`` files."""
    cf = commit_files.select("commit_id", "file").distinct()
    ok = cf.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)
    return cf.join(ok.select("commit_id"), "commit_id", "left_semi")


def cochange_pairs(commits: DataFrame, commit_files: DataFrame, support: int = 3, windows: int = 3, bulk: int = BULK) -> DataFrame:
    """(a, b, together, conf_a, conf_b, recur) with a < b: commits that touch both, the share
    of each one's commits, and in how many of the equal-count windows it recurs.

    Commits are bounded by ``bulk`` files, so the self join makes at most
    ``bulk`` pairs a row.
    """
    cf = sized(commit_files, bulk)
    n = commits.count()
    slot = newest_first_windows(commits, max(1, min(windows, n)))
    a = cf.join(slot, "commit_id").select("commit_id", "slot", F.col("file").alias("a"))
    pairs = a.join(cf.select("commit_id", F.col("file").alias("b")), "commit_id").filter("a < b")
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"), F.bit_count(F.bit_or(F.expr("shiftleft(1, slot)"))).alias("recur")).filter(F.col("together") >= support)
    freq = cf.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(freq.select(F.col("file").alias("a"), F.col("n").alias("na")), "a")
        .join(freq.select(F.col("file").alias("b"), F.col("n").alias("nb")), "b")
        .select("a", "b", "together", (F.col("together") / F.col("na")).alias("conf_a"), (F.col("together") / F.col("nb")).alias("conf_b"), F.col("recur").cast("long").alias("recur"))
    )


def partners(pairs: DataFrame, file) -> DataFrame:
    """(path, together, deg, deg_rev) of one file's partners, by degree and then path."""
    one = pairs.filter(F.col("a") == file).select(F.col("b").alias("path"), "together", F.col("conf_a").alias("deg"), F.col("conf_b").alias("deg_rev"))
    two = pairs.filter(F.col("b") == file).select(F.col("a").alias("path"), "together", F.col("conf_b").alias("deg"), F.col("conf_a").alias("deg_rev"))
    return one.unionByName(two).orderBy(F.desc("deg"), "path")


def surprising(pairs: DataFrame, coupled: DataFrame) -> DataFrame:
    """Pairs without a known dependency either way; ``coupled(a, b)``."""
    both = coupled.select("a", "b").unionByName(coupled.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


def greedy_cover(pairs: list[tuple]) -> list[tuple]:
    """(file, covered pairs): repeatedly the file in most uncovered pairs, smallest on ties."""
    left, out = set(pairs), []
    while left:
        count: dict = {}
        for a, b in left:
            count[a] = count.get(a, 0) + 1
            count[b] = count.get(b, 0) + 1
        best = min(count, key=lambda f: (-count[f], f))
        own = sorted(p for p in left if best in p)
        out.append((best, own))
        left.difference_update(own)
    return out


def violation_groups(pairs: DataFrame) -> DataFrame:
    """(nth, file, pairs): ``greedy_cover`` of all ``pairs(a, b)`` in rounds over the cluster.

    A file that beats all its neighbours by (uncovered pairs, smallest id) is taken before
    any of them whatever happens elsewhere, so a round takes all such files at once; the
    greedy order is that of (pairs descending, file).
    """
    from delvegraph.plans.staging import stage

    left = stage(pairs.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while found is None or left.measured["rows"]:
        ends = left.select(F.col("a").alias("file"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("file"), F.col("a").alias("other")))
        degree = stage(ends.groupBy("file").agg(F.count(F.lit(1)).alias("n")))
        beside = ends.join(degree, "file").join(degree.select(F.col("file").alias("other"), F.col("n").alias("m")), "other")
        beaten = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("file")))
        core = stage(beside.groupBy("file").agg(F.first("n").alias("pairs"), F.max(beaten).alias("beaten")).filter("not beaten").select("file", "pairs"))
        found = core if found is None else found.unionByName(core)
        left = stage(left.join(core.select(F.col("file").alias("a")), "a", "left_anti").join(core.select(F.col("file").alias("b")), "b", "left_anti").select("a", "b"))
    nth = F.row_number().over(Window.orderBy(F.desc("pairs"), "file")) - 1
    return found.select(nth.alias("nth"), "file", F.col("pairs").cast("int").alias("pairs"))


def owners(commits: DataFrame, commit_files: DataFrame, as_of) -> DataFrame:
    """(file, author, score, share, sole): commits decayed by half every 182.5 days before
    ``as_of``; ``sole``: one author holds over 80 %."""
    age = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 86400.0
    score = F.exp(-F.ln(F.lit(2.0)) * F.greatest(age, F.lit(0.0)) / HALF_LIFE_DAYS)
    each = commit_files.select("commit_id", "file").distinct().join(commits, "commit_id").groupBy("file", "author").agg(F.sum(score).alias("score"))
    by_file = Window.partitionBy("file")
    each = each.withColumn("share", F.col("score") / F.sum("score").over(by_file))
    return each.withColumn("sole", F.max("share").over(by_file) > 0.8)


def churn(commits: DataFrame, commit_files: DataFrame, since=None, until=None) -> DataFrame:
    """(file, commits, first_ts, last_ts) within a half-open time window."""
    c = commits
    if since is not None:
        c = c.filter(F.col("ts") >= F.lit(since))
    if until is not None:
        c = c.filter(F.col("ts") < F.lit(until))
    return commit_files.select("commit_id", "file").distinct().join(c, "commit_id").groupBy("file").agg(F.count(F.lit(1)).alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def hotspots(symbols: DataFrame, churned: DataFrame) -> DataFrame:
    """(file, complexity, commits, heat, worst): summed complexity times commits; files
    with a zero factor are left out.  ``symbols(file, name, ccx)``."""
    per = symbols.groupBy("file").agg(F.sum("ccx").alias("complexity"), F.max_by("name", F.struct("ccx", "name")).alias("worst"))
    return per.join(churned.select("file", "commits"), "file").withColumn("heat", F.col("complexity") * F.col("commits")).filter("heat > 0").select("file", "complexity", "commits", "heat", "worst")


def churn_prior(nodes: DataFrame, churned: DataFrame) -> DataFrame:
    """(id, p): (commits + 1) / sum over ``nodes(id, file)``; uniform without history."""
    raw = nodes.join(churned.select("file", "commits"), "file", "left").select("id", (F.coalesce("commits", F.lit(0)) + 1).alias("u"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("u").alias("t")))).select("id", (F.col("u") / F.col("t")).alias("p"))


def parse_git_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) from ``lines(line_no, value)`` of
    ``git log --name-only --format=@%H|%ct|%ae``, newest first."""
    head = F.col("value").startswith("@")
    at = F.sum(F.when(head, 1).otherwise(0)).over(Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.filter("value <> ''").withColumn("ordinal", at)
    parts = F.split(F.substring("value", 2, 1 << 20), r"\|")
    commits = rows.filter(head).select(parts[0].alias("commit_id"), F.timestamp_seconds(parts[1].cast("long")).alias("ts"), parts[2].alias("author"), "ordinal")
    files = rows.filter(~head).select("ordinal", F.col("value").alias("file")).join(commits.select("ordinal", "commit_id"), "ordinal").select("commit_id", "file")
    return commits, files
