"""Outcomes, telemetry and work lists of scans: merges, order, early ends, unions of object sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.functions.paths import ai_kind, is_sensitive

# Statuses that are tried again by every strategy or by the two stronger ones, and the limits of adaptive workers.
ALWAYS = (429,)
#: By strategy: retries at most, and milliseconds of the first wait and of the longest.
STRATEGIES = {"aggressive": (10, 100, 60_000), "standard": (3, 500, 30_000), "conservative": (1, 1000, 10_000)}
LEAST_WORKERS, MOST_WORKERS, THROTTLE, HEADROOM, COOLDOWN, DECAY = 5, 200, 0.10, 0.02, 50, 0.2
#: Blobs by which reachability is probed, and the share of them that a strict check wants.
PROBES, STRICT = 10, 0.3


def object_ids(*sets: DataFrame) -> DataFrame:
    """(sha1) of the union of object sets, each once."""
    out = sets[0].select("sha1")
    for more in sets[1:]:
        out = out.union(more.select("sha1"))
    return out.distinct()


def without(objects: DataFrame, known: DataFrame) -> DataFrame:
    """(sha1) of the objects that are not known, each once: commits among all objects are those that are no blobs."""
    return objects.select("sha1").distinct().join(known.select("sha1"), "sha1", "left_anti")


def work_list(blobs: DataFrame, commits: DataFrame, paths: DataFrame, current: DataFrame) -> DataFrame:
    """(sha1, origin, path, is_deleted, priority) of blobs, then of commits that are no blobs, each once.

    Priority 0 is a deleted blob of a sensitive path, 1 a deleted one, 2 one of a sensitive path, 3 any
    other, 4 a commit. Paths are (sha1, path), current objects (sha1).
    """
    both = blobs.select("sha1", F.lit(0).alias("origin")).union(commits.select("sha1", F.lit(1).alias("origin"))).groupBy("sha1").agg(F.min("origin").alias("origin"))
    known = paths.groupBy("sha1").agg(F.min("path").alias("path"))
    now = current.select("sha1").distinct().withColumn("__now", F.lit(True))
    rows = both.join(known, "sha1", "left").join(now, "sha1", "left")
    gone, special = F.col("__now").isNull(), F.coalesce(is_sensitive(F.col("path")), F.lit(False))
    priority = F.when(F.col("origin") == 1, 4).when(gone & special, 0).when(gone, 1).when(special, 2).otherwise(3)
    return rows.select("sha1", "origin", "path", gone.alias("is_deleted"), priority.alias("priority"))


def ai_first(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``order``: files at paths of AI tools are 0, others 1; a scan that may end early sorts by it."""
    return files.withColumn("order", F.when(ai_kind(F.col(path)).isNotNull(), 0).otherwise(1))


def scan_candidates(files: DataFrame, max_bytes: int, binaries: bool, is_binary: Column) -> DataFrame:
    """Files (path, length) to scan: none too large, none of a binary kind where these are not wanted; with their ``order``."""
    fit = files.filter(F.col("length") <= max_bytes)
    return ai_first(fit if binaries else fit.filter(~is_binary))


def until(findings: DataFrame, most: int = 0, stop_on_critical: bool = False, order: tuple[str, ...] = ("seq", "line", "pattern_id", "match")) -> DataFrame:
    """The findings that an ordered scan had when it ended: the first ``most``, or all up to and with the first critical one.

    The least critical place is one row, and the limit is a top-k: nothing is sorted as a whole.
    """
    place = F.struct(*order)
    out = findings
    if stop_on_critical:
        first = findings.filter("severity = 'CRITICAL'").agg(F.min(place).alias("__stop"))
        out = out.crossJoin(F.broadcast(first)).filter(F.col("__stop").isNull() | (place <= F.col("__stop"))).drop("__stop")
    return out.orderBy(*order).limit(most) if most else out


def in_input_order(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Results (target, ...) with the place ``seq`` of their target in the input (seq, target), sorted by it."""
    return results.join(targets.select("seq", "target"), "target").orderBy("seq")


def merged(parts: DataFrame, sums: tuple[str, ...], peaks: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """Telemetry of parts as one: counters are summed, peaks are the greatest; nulls count as nothing."""
    return parts.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums], *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in peaks])


def merged_counts(parts: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, name, n) of maps of counts, summed by name."""
    rows = parts.select(*keys, F.explode(column).alias("name", "n"))
    return rows.groupBy(*keys, "name").agg(F.sum("n").cast("long").alias("n"))


def accumulated(outcomes: DataFrame) -> DataFrame:
    """One row of a scan's outcomes (outcome, reason, bytes, tech, source): counts, bytes, technologies and sources."""
    did = F.col("outcome") == "scanned"
    return outcomes.agg(
        F.count_if(did).alias("blobs_scanned"),
        F.count_if(F.col("outcome") == "failed").alias("blobs_failed"),
        F.count_if(F.col("outcome") == "skipped").alias("blobs_skipped"),
        F.coalesce(F.sum(F.when(did, F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_scanned"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(did, F.col("tech")))))).alias("tech_stack"),
    )


def retry_metrics(requests: DataFrame) -> DataFrame:
    """One row of a request log (request, attempt, status; a null status is a network error): attempts, retries, results, counts of statuses."""
    last = requests.groupBy("request").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempt"))
    done = last.agg(F.count_if(F.col("status").between(200, 399)).alias("succeeded"), F.count_if(F.col("status").isNull() | ~F.col("status").between(200, 399)).alias("failed"))
    some = F.col("status").isin(403, 404, 429, 500, 502, 503, 504)
    counts = requests.filter(some).groupBy(F.col("status").cast("string").alias("s")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("status_counts"))
    totals = requests.agg(F.count("*").alias("attempts"), F.count_if(F.col("attempt") > 0).alias("retries"), F.count_if(F.col("status").isNull()).alias("network_errors"))
    return totals.crossJoin(done).crossJoin(counts).select("attempts", "retries", "succeeded", "failed", "network_errors", "status_counts")


def should_retry(status: Column, strategy: str = "standard") -> Column:
    strong = strategy in ("standard", "aggressive")
    return F.coalesce(status.isin(*ALWAYS) | (status.between(500, 599) & F.lit(strong)), F.lit(False))


def longest_wait(attempt: Column, strategy: str = "standard") -> Column:
    """Milliseconds that a retry waits at most: the first wait doubled each time, up to the longest; the wait itself is drawn below it."""
    _, first, longest = STRATEGIES[strategy]
    return F.least(F.lit(first) * F.pow(F.lit(2), F.least(attempt, F.lit(30))), F.lit(float(longest))).cast("long")


def probe_sample(candidates: DataFrame, order: tuple[str, ...] = ("origin", "sha1")) -> DataFrame:
    """(sha1, place) of up to ``PROBES`` candidates (sha1, origin), evenly spaced in their order.

    Places come from counts by origin and a rank within it, so only the ranks of chosen places are kept.
    """
    total = candidates.count()
    if not total:
        return candidates.select("sha1", F.lit(0).alias("place")).limit(0)
    size = min(total, PROBES)
    step = total // size if size > 1 else 1
    wanted = [min(k * step, total - 1) for k in range(size)]
    # the candidates up to the last place, as a top-k; their ranks are over those alone
    first = candidates.orderBy(*order).limit(wanted[-1] + 1)
    ranked = first.withColumn("place", F.row_number().over(W.orderBy(*order)) - 1)
    return ranked.filter(F.col("place").isin(*wanted)).select("sha1", "place")


def accessible(probes: DataFrame, packs_read: bool = False, strict: bool = False) -> DataFrame:
    """(objects_accessible) of probed objects (sha1, ok): any one will do, or with ``strict`` three in ten; a pack that was read proves it."""
    ok, total = F.count_if(F.col("ok")), F.count("*")
    enough = ok >= F.greatest(F.ceil(total * STRICT), F.lit(1)) if strict else ok > 0
    return probes.agg((F.lit(packs_read) | ((total > 0) & enough)).alias("objects_accessible"))


def adjust_workers(state: dict, processed: int) -> dict:
    """One adjustment of a count of workers to the errors of a window; the window keeps a fifth of its counts.

    ``state`` has workers, initial, requests, errors and last_decrease. Half the workers go where over a
    tenth of the requests failed, not again within fifty blobs; a tenth of the first number is added where
    under a fiftieth did and there were fifty requests. Spark schedules its own tasks; this replays logs.
    """
    requests, errors = state["requests"], state["errors"]
    out = {**state, "requests": int(requests * DECAY), "errors": int(errors * DECAY)}
    if not requests:
        return out
    rate = errors / requests
    if rate > THROTTLE and processed >= state["last_decrease"] + COOLDOWN:
        return {**out, "workers": max(state["workers"] // 2, LEAST_WORKERS), "last_decrease": processed}
    if rate < HEADROOM and requests >= 50:
        return {**out, "workers": min(state["workers"] + max(state["initial"] // 10, 1), min(state["initial"], MOST_WORKERS))}
    return out


def decayed_errors(log: DataFrame, window: str = "window") -> DataFrame:
    """(window, requests, errors) of a request log (window, ok): each window's counts and a fifth of those before it, rounded down.

    A window's counts fade below one after a few windows, so a bounded look back gives them whole: sixteen
    windows hold any count under 5 ** 16.
    """
    per = log.groupBy(window).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("e"))
    back = W.orderBy(window).rowsBetween(-16, 0)
    kept = per.withColumn("all", F.collect_list(F.struct("n", "e")).over(back))
    fade = lambda field: F.aggregate("all", F.lit(0).cast("long"), lambda acc, x: F.floor(acc * DECAY).cast("long") + x[field])
    return kept.select(window, fade("n").alias("requests"), fade("e").alias("errors"))
