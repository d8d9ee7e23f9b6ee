"""Repository graphs, histories, probes, selectors and the object cache, as joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.functions.paths import glob_regex, tree_kind
from quillsieve.operators.rollup import first_of


def object_paths(index: DataFrame, graph: DataFrame) -> DataFrame:
    """(sha1, path): of the index its last path for an object, of the graph what the index lacks."""
    last = index.groupBy("sha1").agg(F.max_by("path", "seq").alias("index_path"))
    first = graph.groupBy("sha1").agg(F.min_by("path", "seq").alias("graph_path"))
    return last.join(first, "sha1", "full_outer").select("sha1", F.coalesce("index_path", "graph_path").alias("path"))


def all_paths(index: DataFrame, graph: DataFrame) -> DataFrame:
    """(sha1, paths): every path of an object, index first, each where it was first seen."""
    both = index.select("sha1", "path", F.lit(0).alias("origin"), "seq").union(graph.select("sha1", "path", F.lit(1).alias("origin"), "seq"))
    once = both.groupBy("sha1", "path").agg(F.min(F.struct("origin", "seq")).alias("at"))
    return once.groupBy("sha1").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]).alias("paths"))


def named_objects(objects: DataFrame, paths: DataFrame) -> DataFrame:
    """Objects with their path, or a name made of the hash."""
    return objects.join(paths, "sha1", "left").withColumn("path", F.coalesce("path", F.concat(F.lit("[blob:"), F.left("sha1", F.lit(8)), F.lit("]"))))


def mark_deleted(objects: DataFrame, current: DataFrame) -> DataFrame:
    now = current.select("sha1").distinct().withColumn("__now", F.lit(True))
    return objects.join(now, "sha1", "left").withColumn("is_deleted", F.col("__now").isNull()).drop("__now")


def pending(objects: DataFrame, processed: DataFrame) -> DataFrame:
    """Objects that a resumed scan has still to do."""
    return objects.join(processed.select("sha1"), "sha1", "left_anti")


def candidates(blobs: DataFrame, index: DataFrame, graph: DataFrame) -> DataFrame:
    """(sha1, origin): blobs in the order of trust: 0 in the index, 1 in the graph, 2 others."""
    at = lambda df, n: df.select("sha1").distinct().withColumn(f"__{n}", F.lit(n))
    joined = blobs.select("sha1").distinct().join(at(index, 0), "sha1", "left").join(at(graph, 1), "sha1", "left")
    return joined.select("sha1", F.coalesce("__0", "__1", F.lit(2)).alias("origin"))


def acquire(objects: DataFrame, pack: DataFrame, cache: DataFrame, loose: DataFrame, valid: Column) -> DataFrame:
    """Content and source of each object: pack, then cache (where ``valid`` holds for it), then loose."""
    take = lambda df, n: df.select("sha1", F.col("content").alias(n))
    out = objects.select("sha1").join(take(pack, "__pack"), "sha1", "left").join(take(cache.filter(valid), "__cache"), "sha1", "left").join(take(loose, "__loose"), "sha1", "left")
    source = F.when(F.col("__pack").isNotNull(), "pack").when(F.col("__cache").isNotNull(), "cache").when(F.col("__loose").isNotNull(), "loose")
    return out.select("sha1", F.coalesce("__pack", "__cache", "__loose").alias("content"), source.alias("source"))


def commit_walk(commits: DataFrame, heads: DataFrame, limit: int = 100) -> DataFrame:
    """(sha1, depth) of the commits reached from ``heads`` (sha1) through ``parents``, nearest first, up to ``limit`` (0: all).

    Each level is a join of the last with the parents, less what was seen; of a level the smaller hashes come first.
    """
    frontier = heads.select("sha1").distinct().join(commits.select("sha1"), "sha1", "left_semi").withColumn("depth", F.lit(0))
    seen, depth = frontier, 0
    parents = commits.select(F.col("sha1").alias("child"), F.explode("parents").alias("sha1"))
    exists = commits.select("sha1")
    while True:
        found = seen.count()
        if limit and found >= limit:
            break
        depth += 1
        reached = parents.join(frontier.select(F.col("sha1").alias("child")), "child", "left_semi").select("sha1").distinct()
        frontier = reached.join(seen, "sha1", "left_anti").join(exists, "sha1", "left_semi").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "sha1").limit(limit) if limit else seen


def tag_targets(tags: DataFrame, hops: int = 8) -> DataFrame:
    """(sha1, target, target_type) of annotated tags, tags of tags followed up to ``hops`` times."""
    out = tags.select("sha1", "target", "target_type")
    step = tags.select(F.col("sha1").alias("target"), F.col("target").alias("__t"), F.col("target_type").alias("__k"))
    for _ in range(hops):
        more = F.col("target_type") == "tag"
        out = out.join(step, "target", "left").select("sha1", F.when(more & F.col("__t").isNotNull(), F.col("__t")).otherwise(F.col("target")).alias("target"), F.when(more & F.col("__k").isNotNull(), F.col("__k")).otherwise(F.col("target_type")).alias("target_type"))
    return out


def expand_trees(roots: DataFrame, entries: DataFrame, depth: int = 64) -> DataFrame:
    """(root, sha1, path) of the blobs under trees (sha1) given entries (tree, mode, name, sha1); gitlinks are left out."""
    kinds = entries.select(F.col("tree").alias("at"), F.col("name"), F.col("sha1").alias("entry"), tree_kind(F.col("mode")).alias("kind"))
    level = roots.select(F.col("sha1").alias("root"), F.col("sha1").alias("at"), F.lit("").alias("prefix"))
    out = None
    for _ in range(depth):
        rows = level.join(kinds, "at").withColumn("path", F.concat("prefix", "name")).checkpoint()
        blobs = rows.filter("kind = 'blob'").select("root", F.col("entry").alias("sha1"), "path")
        out = blobs if out is None else out.union(blobs)
        level = rows.filter("kind = 'tree'").select("root", F.col("entry").alias("at"), F.concat("path", F.lit("/")).alias("prefix"))
        if level.isEmpty():
            return out
    raise RuntimeError(f"a tree is deeper than {depth} levels")


def commit_files(commits: DataFrame, entries: DataFrame, heads: DataFrame, limit: int = 0) -> DataFrame:
    """(commit, depth, sha1, path) of the blobs of the commits reached from ``heads``: commits (sha1, tree, parents), entries of trees."""
    walked = commit_walk(commits, heads, limit).join(commits.select("sha1", "tree"), "sha1")
    blobs = expand_trees(walked.select(F.col("tree").alias("sha1")).distinct(), entries)
    return walked.select(F.col("sha1").alias("commit"), "depth", "tree").join(blobs.withColumnRenamed("root", "tree"), "tree").select("commit", "depth", "sha1", "path")


def commit_messages(commits: DataFrame) -> DataFrame:
    """Messages of commits (sha1, message) in the form that text scans take; empty ones are left out."""
    rows = commits.filter(F.coalesce("message", F.lit("")) != "")
    return rows.select(F.concat(F.lit("[commit:"), F.left("sha1", F.lit(8)), F.lit(":message]")).alias("filename"), F.col("message").alias("text"), F.lit(False).alias("is_deleted"), F.col("sha1").alias("commit_sha1"))


def history_views(entries: DataFrame) -> DataFrame:
    """Entries of a history that are scanned: one for each path and blob (path and commit without a blob), removed ones without a blob left out."""
    kept = entries.filter(~((F.col("status") == "removed") & F.col("blob_sha").isNull()))
    key = F.concat_ws(":", "path", F.coalesce("blob_sha", "commit_sha"))
    return first_of(kept.withColumn("view_key", key), ["repo", "view_key"], ["seq"])


def history_coverage(entries: DataFrame) -> DataFrame:
    """(repo, commits, considered, scanned, deduplicated, deleted) of each repository's history."""
    totals = entries.groupBy("repo").agg(F.countDistinct("commit_sha").alias("commits"), F.count("*").alias("considered"), F.count_if(F.col("status") == "removed").alias("deleted"), F.count_if(~((F.col("status") == "removed") & F.col("blob_sha").isNull())).alias("__usable"))
    scanned = history_views(entries).groupBy("repo").agg(F.count("*").alias("scanned"))
    return totals.join(scanned, "repo", "left").select("repo", "commits", "considered", F.coalesce("scanned", F.lit(0)).alias("scanned"), (F.col("__usable") - F.coalesce("scanned", F.lit(0))).alias("deduplicated"), "deleted")


def score_probes(probes: DataFrame, total: int = 130) -> DataFrame:
    """(url, git_path, confidence, label) of each candidate from its probes (probe, weight, valid, status).

    A HEAD probe refused with 403 makes 25 and PROTECTED; one that failed otherwise leaves nothing.
    """
    head = F.col("probe") == "HEAD"
    sums = probes.groupBy("url", "git_path").agg(F.coalesce(F.sum(F.when(F.col("valid"), F.col("weight"))), F.lit(0)).alias("points"), F.coalesce(F.bool_or(head & (F.col("status") == 403)), F.lit(False)).alias("refused"), F.coalesce(F.bool_or(head & ~F.col("valid")), F.lit(False)).alias("failed"))
    score = F.when(F.col("refused"), 25).otherwise(F.least(F.floor(F.col("points") * 100 / total), F.lit(100))).cast("int")
    scored = sums.filter(F.col("refused") | ~F.col("failed")).withColumn("confidence", score)
    # Least confidence of each label.
    label = F.when(F.col("refused"), "PROTECTED").when(F.col("confidence") >= 90, "CONFIRMED").when(F.col("confidence") >= 70, "HIGH").when(F.col("confidence") >= 45, "MEDIUM").when(F.col("confidence") >= 20, "LOW").otherwise("NONE")
    return scored.select("url", "git_path", "confidence", label.alias("label"))


def confident(scored: DataFrame, least: int = 45) -> DataFrame:
    """The candidates that are sure enough to be scanned."""
    return scored.filter(F.col("confidence") >= least)


def best_probe(scored: DataFrame, least: int = 20) -> DataFrame:
    """The candidate of the highest confidence for each url, the first path on ties."""
    return first_of(scored.filter(F.col("confidence") >= least), ["url"], [-F.col("confidence"), "git_path"])


def select_repositories(repositories: DataFrame, selectors: DataFrame) -> DataFrame:
    """Repositories (full_name) that a selector names, by whole name or glob, whatever the case.

    Plain selectors join on the lower-cased name; only globs, a short list of the user's, are tried on every name.
    """
    globs = selectors.filter(F.col("selector").rlike(r"[*?]")).select(glob_regex(F.col("selector")).alias("__rx")).distinct()
    plain = selectors.filter(~F.col("selector").rlike(r"[*?]")).select(F.lower("selector").alias("__name")).distinct()
    if (n := globs.count()) > 1000:
        raise ValueError(f"{n} globs; at most 1000 can be matched")
    patterns = [r[0] for r in globs.collect()]
    hit = F.lit(False)
    for rx in patterns:
        hit = hit | F.col("full_name").rlike(rx)
    marked = repositories.join(plain, F.lower("full_name") == F.col("__name"), "left")
    return marked.filter(F.col("__name").isNotNull() | hit).drop("__name")


def evict(cache: DataFrame, limit: int, now: int, ttl: int, keep_share: float = 0.9) -> DataFrame:
    """Rows that stay in an object cache (sha1, size, created_at): fresh ones, the newest up to the limit's share.

    Over the limit the oldest go until ``keep_share`` of it is reached. Sizes are summed by second of
    creation first and then over those sums, so the running window holds one row a second, not every object.
    """
    fresh = cache.filter(F.col("created_at") > now - ttl) if ttl else cache
    per = fresh.groupBy("created_at").agg(F.sum("size").alias("s"))
    sums = per.withColumn("day", F.expr("created_at div 86400"))
    days = sums.groupBy("day").agg(F.sum("s").alias("d"))
    later = days.withColumn("after", F.sum("d").over(W.orderBy(F.desc("day"))) - F.col("d")).drop("d")
    within = sums.join(F.broadcast(later), "day").withColumn("upto", F.col("after") + F.sum("s").over(W.partitionBy("day").orderBy(F.desc("created_at"))) - F.col("s")).select("created_at", "upto")
    ranked = fresh.join(within, "created_at").withColumn("newer", F.col("upto") + F.sum("size").over(W.partitionBy("created_at").orderBy(F.desc("sha1"))))
    total = fresh.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    return ranked.crossJoin(F.broadcast(total)).filter((F.col("total") <= limit) | (F.col("newer") <= int(limit * keep_share))).select(cache.columns)


def put(cache: DataFrame, objects: DataFrame, now: int, source_url: str = "") -> DataFrame:
    """A cache (sha1, content, size, created_at, source_url) with more objects (sha1, content); a new row replaces an old one."""
    rows = objects.groupBy("sha1").agg(F.first("content").alias("content"))
    fresh = rows.select("sha1", "content", F.octet_length("content").cast("long").alias("size"), F.lit(now).cast("long").alias("created_at"), F.lit(source_url).alias("source_url"))
    return cache.join(fresh.select("sha1"), "sha1", "left_anti").select(fresh.columns).unionByName(fresh)


def cleanup(cache: DataFrame, now: int, ttl: int) -> DataFrame:
    """The rows that have not outlived ``ttl`` seconds; 0 keeps all."""
    return cache.filter(F.col("created_at") > now - ttl) if ttl else cache


def clear(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def cache_stats(cache: DataFrame, now: int, ttl: int) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("created_at") <= now - ttl).alias("expired"))


def estimated_size(sizes: DataFrame, objects: int) -> DataFrame:
    """Bytes of a repository: the index's sizes, or 4096 for each object where it has none."""
    return sizes.agg(F.coalesce(F.sum("file_size"), F.lit(objects * 4096)).cast("long").alias("estimated_bytes"))
