"""Roll-ups and deduplication of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.functions.paths import ai_metadata
from quillsieve.functions.text import SEVERITIES, severity_rank

#: The order in which the first of equal findings counts.
ORDER = ("filename", "line", "pattern_id", "match")


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, n) for the four severities, zeros too; other severities count nowhere."""
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    every = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(F.broadcast(counts.filter(F.col("severity").isin(*SEVERITIES))), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def risk(findings: DataFrame) -> DataFrame:
    """(risk_score, risk_label): capped points by severity, repeats counted."""
    points = F.lit(0)
    # Points and cap by severity, and the least score of each label.
    for severity, each, cap in (("CRITICAL", 20, 60), ("HIGH", 10, 30), ("MEDIUM", 5, 15)):
        points = points + F.least(F.count_if(F.col("severity") == severity) * each, F.lit(cap))
    return findings.agg(F.least(points, F.lit(100)).cast("int").alias("risk_score")).withColumn("risk_label", risk_label(F.col("risk_score")))


def risk_label(score: Column) -> Column:
    return F.when(score >= 70, "CRITICAL").when(score >= 40, "HIGH").when(score >= 15, "MEDIUM").otherwise("CLEAR")


def first_of(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key: repeats meet in map-side minima, so no task gets all rows of a popular one."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    grouped = df.groupBy(*[k.alias(f"__k{n}") for n, k in enumerate(named)])
    return grouped.agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__first")).select("__first.*")


def unique_findings(findings: DataFrame) -> DataFrame:
    """One finding for each pattern and full match."""
    return first_of(findings, ["pattern_id", "match"], list(ORDER))


def shown_findings(findings: DataFrame) -> DataFrame:
    """One finding for each pattern and first 40 characters of the match: the gravest, then the first."""
    return first_of(findings, ["pattern_id", F.left("match", F.lit(40))], [severity_rank(F.col("severity")), *ORDER])


def unique_secrets(findings: DataFrame) -> DataFrame:
    return findings.select("pattern_id", "match").distinct().agg(F.count("*").alias("unique_secrets"))


def ai_summary(findings: DataFrame) -> DataFrame:
    """(ai_category, n) of the findings about AI tools."""
    tagged = findings.select(ai_metadata(F.col("pattern_id"), F.col("filename")).alias("ai"))
    return tagged.filter("ai.ai_related").groupBy(F.col("ai.ai_category").alias("ai_category")).agg(F.count("*").alias("n"))


def tallies(df: DataFrame, column: str) -> DataFrame:
    """One row with the map of counts by value, sorted by key; an empty map for no rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("tallies"))


def contributors(commits: DataFrame) -> DataFrame:
    """(author_email, author): the name of each address's first commit (by ``seq``)."""
    return commits.filter(F.col("author_email").isNotNull()).groupBy("author_email").agg(F.min_by("author", "seq").alias("author"))


def tech_stack(tagged: DataFrame, column: str = "tech") -> DataFrame:
    """The technologies of an array column, each once and sorted."""
    return tagged.select(F.explode(column).alias("t")).distinct().agg(F.sort_array(F.collect_list("t")).alias("tech_stack"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(pattern_id, level, description) of each rule: its gravest level and its first description."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    rules = findings.groupBy("pattern_id").agg(F.max(level).alias("rank"), F.min_by("description", F.struct("filename", "line", "match")).alias("description"))
    return rules.select("pattern_id", F.when(F.col("rank") == 3, "error").when(F.col("rank") == 2, "warning").otherwise("note").alias("level"), "description")


def recent_critical(findings: DataFrame, size: int = 20) -> DataFrame:
    """Whether any of the last ``size`` findings of the same file is critical."""
    frame = W.partitionBy("filename").orderBy("line", "pattern_id", "match").rowsBetween(1 - size, 0)
    return findings.withColumn("recent_critical", F.max((F.col("severity") == "CRITICAL").cast("int")).over(frame) == 1)


def scan_totals(outcomes: DataFrame) -> DataFrame:
    """Totals over scan outcomes (outcome, reason, bytes): skips of resource_budget are not in skipped_total."""
    skip, fail = F.col("outcome") == "skipped", F.col("outcome") == "failed"
    return outcomes.agg(
        F.count_if(F.col("outcome") == "scanned").alias("scanned"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "scanned", F.col("bytes"))), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(skip & (F.coalesce(F.col("reason"), F.lit("")) != "resource_budget")).alias("skipped_total"),
        F.count_if(fail).alias("failed_total"),
    )


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings as reports show them."""
    ai = ai_metadata(F.col("pattern_id"), F.col("filename"))
    return findings.select(
        F.col("filename").alias("file"), "line", F.col("pattern_id").alias("type"), F.col("description").alias("desc"), "severity", F.left("match", F.lit(120)).alias("match"), F.left("context", F.lit(200)).alias("context"), F.col("is_deleted").alias("deleted"), F.col("commit_sha1").alias("blob_sha1"), "confidence_adjustment", ai["ai_related"].alias("ai_related"), ai["ai_category"].alias("ai_category"), ai["ai_tags"].alias("ai_tags"),
    )


