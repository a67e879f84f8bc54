"""Aggregations and scores: stability, risk, co-change, unused exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.plans.kernels import reach_counts
from cartograph.runtime import spool


def fans(file_edges: DataFrame, files: DataFrame) -> DataFrame:
    """path, fan_in, fan_out over import edges."""
    e = file_edges.where("kind = 'import'").select("src", "dst").distinct()
    ends = e.select(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    n = ends.groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return files.select("path").join(n, "path", "left").na.fill(0, ["fan_in", "fan_out"])


STABILITY_ORDER = {"instability": ["instability", "fan_in"], "fan-in": ["fan_in", "instability"], "fan-out": ["fan_out", "instability"], "path": []}
RISK_ORDER = {"score": ["score", "transitive_dependents", "churn_commits"], "churn": ["churn_commits", "score"], "dependents": ["transitive_dependents", "score"], "path": []}
COCHANGE_ORDER = {"score": ["score", "shared_commits"], "shared": ["shared_commits", "score"], "path": []}


def stability(file_edges: DataFrame, files: DataFrame, flag_threshold: float | None = None, file: str | None = None, sort: str | None = None) -> DataFrame:
    """path, fan_in, fan_out, instability, category, flagged; of one file, and in an order of STABILITY_ORDER, where asked."""
    t = flag_threshold if flag_threshold is not None else 0.5
    i, o = F.col("fan_in"), F.col("fan_out")
    n = fans(file_edges, files).withColumn("instability", F.when(i + o == 0, 0.0).otherwise(o / (i + o)))
    flagged = (i > 10) & (F.col("instability") > t)
    x = F.col("instability")
    category = (
        F.when((i == 0) & (o == 0), "isolated").when((x > 0.5) & (i > 10), "unstable_and_central").when((x < 0.2) & (i > 5), "stable_abstraction")
        .when((i == 0) & (x >= 0.95), "healthy_leaf").when(x.between(0.35, 0.65), "balanced").otherwise("stable")
    )
    out = n.withColumn("category", category).withColumn("flagged", flagged)
    out = out if file is None else out.where(F.col("path") == file)
    return out if sort is None else out.orderBy(*[F.desc(c) for c in STABILITY_ORDER[sort]], "path")


def stability_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("files"), F.round(F.avg("instability"), 6).alias("avg_instability"))


def in_window(churn: DataFrame, days: int, now: int) -> DataFrame:
    return churn.where(F.col("committed_at").isNull() | (F.col("committed_at") >= now - days * 86400))


def risk(file_edges: DataFrame, files: DataFrame, churn: DataFrame, now: int, days: int = 90, threshold: float = 0.0, top: int | None = None, sort: str = "score", file: str | None = None) -> DataFrame:
    """path, direct_dependents, transitive_dependents, churn_commits, score, normalized_score, reason, over import edges.

    score: log2(transitive + 1) * log2(commits + 1), or log2(direct + 1) if no file has commits in the window. Scores are normalized to the highest of the rows that are left
    after the file filter and the threshold.
    """
    e = file_edges.where("kind = 'import'").select("src", "dst").distinct()
    direct = e.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("direct_dependents"))
    through = reach_counts(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("node").alias("path"), F.col("reached").alias("transitive_dependents"))
    commits = in_window(churn, days, now).groupBy("path").agg(F.count_distinct("commit_sha").alias("churn_commits"))
    n = files.select("path").join(direct, "path", "left").join(through, "path", "left").join(commits, "path", "left").na.fill(0)
    # Two scalars, computed by aggregation and attached to each row, instead of a window over all files in one task.
    any_churn = n.agg(F.max("churn_commits").alias("most"))
    n = n.crossJoin(F.broadcast(any_churn))
    d, t, c = F.col("direct_dependents"), F.col("transitive_dependents"), F.col("churn_commits")
    score = F.when(F.col("most") > 0, F.log2(t + 1) * F.log2(c + 1)).otherwise(F.log2(d + 1))
    with_git = F.format_string(f"%d direct dependents, %d transitive dependents, %d churn commits in last {days} days", d, t, c)
    without = F.format_string("git churn unavailable; score falls back to dependency-only blast radius (%d direct dependents, %d transitive dependents)", d, t)
    n = n.withColumn("score", score).withColumn("reason", F.when(F.col("most") > 0, with_git).otherwise(without)).where(F.col("score") >= threshold).drop("most")
    n = n if file is None else n.where(F.col("path") == file)
    n = n.crossJoin(F.broadcast(n.agg(F.max("score").alias("highest"))))
    share = F.when(F.col("highest") > 0, F.round(100 * F.col("score") / F.col("highest"))).otherwise(0).cast("long")
    n = n.select("path", "direct_dependents", "transitive_dependents", "churn_commits", "score", share.alias("normalized_score"), "reason")
    if top is None:
        return n
    return n.orderBy(*[F.desc(c) for c in RISK_ORDER[sort]], "path").limit(top)


def risk_summary(rows: DataFrame) -> DataFrame:
    """git_available, scored_files, avg_score, max_score of the rows of risk()."""
    some = F.coalesce(F.max("churn_commits") > 0, F.lit(False))
    return rows.agg(some.alias("git_available"), F.count("*").alias("scored_files"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"))


def cochange(churn: DataFrame, target: str, now: int, days: int = 90, min_shared: int = 1, top: int | None = None, sort: str = "score") -> DataFrame:
    """path, shared_commits, target_commits, candidate_commits, score, normalized_score."""
    c = in_window(churn, days, now).select("path", "commit_sha").distinct()
    own = c.where(F.col("path") == target).select("commit_sha")
    total = own.agg(F.count("*").alias("target_commits"))
    shared = c.where(F.col("path") != target).join(own, "commit_sha", "left_semi").groupBy("path").agg(F.count("*").alias("shared_commits")).where(F.col("shared_commits") >= min_shared)
    all_of = c.join(shared.select("path"), "path", "left_semi").groupBy("path").agg(F.count("*").alias("candidate_commits"))
    n = shared.join(all_of, "path").crossJoin(F.broadcast(total)).withColumn("score", F.col("shared_commits") / F.col("target_commits"))
    n = n.crossJoin(F.broadcast(n.agg(F.max("score").alias("highest"))))
    n = n.withColumn("normalized_score", F.round(100 * F.col("score") / F.col("highest")).cast("long")).drop("highest")
    return n if top is None else n.orderBy(*[F.desc(c) for c in COCHANGE_ORDER[sort]], "path").limit(top)


def frequent_pairs(churn: DataFrame, now: int, days: int = 90, min_shared: int = 2, large: int = 100, max_large: int = 10_000) -> DataFrame:
    """path, other, shared_commits, score, of all pairs of files that at least min_shared commits of the window touch together; score: of the rarer file's commits.

    A pair is as frequent as its rarer file at most, so files below the bound leave first. Commits of up to ``large`` files then list their pairs. A larger commit lists none: its files
    carry the list of large commits that they are in, a pair known from small commits looks its lists up, and a pair that large commits alone make frequent meets
    in one of the first of these lists. So one commit that touches everything costs its files, not their pairs. More than ``max_large`` such commits are an error.
    """
    c = in_window(churn, days, now).select("path", "commit_sha").distinct()
    often = spool(c.groupBy("path").agg(F.count("*").alias("commits")).where(F.col("commits") >= min_shared))
    kept = spool(c.join(often.select("path"), "path", "left_semi"))
    size = kept.groupBy("commit_sha").agg(F.count("*").alias("files"))
    sized = spool(kept.join(size, "commit_sha"))
    small, big = sized.where(F.col("files") <= large), sized.where(F.col("files") > large)
    if (n := big.select("commit_sha").distinct().count()) > max_large:
        raise ValueError(f"{n} commits of over {large} files; raise the bound")
    far = small.select("commit_sha", F.col("path").alias("other"))
    few = small.join(far, "commit_sha").where("path < other").groupBy("path", "other").agg(F.count("*").alias("n_small"))
    lists = spool(big.groupBy("path").agg(F.array_sort(F.collect_list("commit_sha")).alias("in_large")))
    # Two lists that share min_shared commits share one of either's first, all but min_shared - 1 of them.
    entry = lists.where(F.size("in_large") >= min_shared).withColumn("commit_sha", F.explode(F.slice("in_large", F.lit(1), F.size("in_large") - (min_shared - 1))))
    a, b = entry.select("commit_sha", "path", "in_large"), entry.select("commit_sha", F.col("path").alias("other"), F.col("in_large").alias("in_other"))
    alone = a.join(b, "commit_sha").where("path < other").where(F.size(F.array_intersect("in_large", "in_other")) >= min_shared).select("path", "other").distinct()
    candidates = few.unionByName(alone.withColumn("n_small", F.lit(0).cast("long"))).groupBy("path", "other").agg(F.max("n_small").alias("n_small"))
    with_lists = candidates.join(lists, "path", "left").join(lists.select(F.col("path").alias("other"), F.col("in_large").alias("in_other")), "other", "left")
    shared = with_lists.withColumn("shared_commits", F.col("n_small") + F.coalesce(F.size(F.array_intersect("in_large", "in_other")), F.lit(0))).where(F.col("shared_commits") >= min_shared)
    found = shared.join(often, "path").join(often.select(F.col("path").alias("other"), F.col("commits").alias("other_commits")), "other")
    return found.select("path", "other", "shared_commits", (F.col("shared_commits") / F.least("commits", "other_commits")).alias("score"))


def unused(symbols: DataFrame, symbol_edges: DataFrame) -> DataFrame:
    """Exported symbols that nothing calls."""
    called = symbol_edges.select(F.col("dst_path").alias("path"), F.col("dst").alias("qualname"))
    return symbols.where("exported").join(called, ["path", "qualname"], "left_anti").select("path", "name", "qualname", "kind", "visibility", F.col("start_line").alias("line"), F.lit(0).cast("long").alias("inbound_references"))
