"""Report aggregates (A1-A6, X5), resource groups (C8), top-k sections (T1-T4) and sinks
(S6 JSON report, S7 URL list).

Aggregates are one ``groupBy(hostname)`` each with conditional counts, which Spark combines
map-side before the shuffle. Top-k sections use ``row_number() <= k`` per group, which Spark
plans as a partial per-partition limit before the shuffle, so a host with a third of all rows
still ships only k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposa.functions import classify as C
from exposa.functions import fixed
from exposa.functions import urls as U
from exposa.operators.publish import publish


def _count_if(cond) -> F.Column:
    return F.count(F.when(cond, F.lit(1))).cast("long")


def scan_statistics(discovered_rows: DataFrame, resources: DataFrame) -> DataFrame:
    """Per host: URLs discovered (all source rows), checked (resources), currently accessible
    (status 200, soft-404s included), and documents / images / data files among those (A1)."""
    disc = discovered_rows.groupBy("hostname").agg(F.count("*").cast("long").alias("urls_discovered"))
    cat = U.file_category(F.col("path"))
    ok = F.col("status_code") == 200
    res = resources.groupBy("hostname").agg(
        F.count("*").cast("long").alias("urls_checked"),
        _count_if(ok).alias("currently_accessible"),
        _count_if(ok & (cat == "document")).alias("documents"),
        _count_if(ok & (cat == "image")).alias("images"),
        _count_if(ok & (cat == "data")).alias("data_files"),
    )
    return disc.join(res, "hostname", "full").select(
        "hostname", F.coalesce("urls_discovered", F.lit(0).cast("long")).alias("urls_discovered"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in
          ["urls_checked", "currently_accessible", "documents", "images", "data_files"]])


def severity_counts(resources: DataFrame, findings: DataFrame) -> DataFrame:
    """Per host: findings by assessed severity; info adds resources analysed INFORMATIONAL (A2)."""
    f = findings.groupBy("hostname").agg(
        *[_count_if(F.col("finding_severity") == s).alias(f"{s.lower()}_count") for s in
          ["CRITICAL", "HIGH", "MEDIUM", "LOW"]],
        _count_if(F.col("finding_severity") == "INFORMATIONAL").alias("info_findings"))
    r = resources.groupBy("hostname").agg(
        _count_if(F.col("severity") == "INFORMATIONAL").alias("info_resources"))
    j = r.join(f, "hostname", "left")
    z = F.lit(0).cast("long")
    return j.select("hostname", *[F.coalesce(f"{s}_count", z).alias(f"{s}_count")
                                  for s in ["critical", "high", "medium", "low"]],
                    (F.coalesce("info_findings", z) + F.col("info_resources")).alias("info_count"))


def sensitive_file_count(resources: DataFrame) -> DataFrame:
    """Per host: resources of the sensitive types (A3)."""
    return resources.groupBy("hostname").agg(
        _count_if(F.col("resource_type").isin(fixed.SENSITIVE_FILE_TYPES)).alias("potential_sensitive_files"))


def resource_groups(resources: DataFrame) -> DataFrame:
    """(resource, group) rows (C8): the first type group that applies, plus the non-exclusive
    ``historical`` (not current) and ``not_accessible`` groups."""
    rt = F.col("resource_type")
    typed = None
    for name, types in fixed.RESOURCE_GROUPS:
        typed = F.when(rt.isin(types), F.lit(name)) if typed is None else typed.when(rt.isin(types), F.lit(name))
    groups = F.filter(F.array(typed, F.when(~F.col("is_current"), F.lit("historical")),
                              F.when(~F.col("is_accessible"), F.lit("not_accessible"))),
                      lambda g: g.isNotNull())
    return resources.select("hostname", "normalized_url", "url", F.explode(groups).alias("group_name"))


def group_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("hostname", "group_name").agg(F.count("*").cast("long").alias("resources"))


def top_findings(findings: DataFrame, k: int = fixed.TOP_FINDINGS) -> DataFrame:
    """First k CRITICAL and HIGH findings per host by normalized URL, with overflow."""
    f = findings.where(F.col("finding_severity").isin("CRITICAL", "HIGH"))
    w = Window.partitionBy("hostname", "finding_severity").orderBy("normalized_url")
    top = f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    totals = f.groupBy("hostname", "finding_severity").agg(F.count("*").cast("long").alias("total"))
    return top.join(totals, ["hostname", "finding_severity"]).select(
        "hostname", "finding_severity", F.col("rank").cast("long").alias("rank"), "url", "title",
        F.greatest(F.col("total") - k, F.lit(0).cast("long")).alias("more"))


def top_resources(groups: DataFrame, k: int = fixed.TOP_RESOURCES) -> DataFrame:
    """First k documents and images per host, with overflow."""
    g = groups.where(F.col("group_name").isin("documents", "images"))
    w = Window.partitionBy("hostname", "group_name").orderBy("normalized_url")
    top = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    totals = g.groupBy("hostname", "group_name").agg(F.count("*").cast("long").alias("total"))
    return top.join(totals, ["hostname", "group_name"]).select(
        "hostname", "group_name", F.col("rank").cast("long").alias("rank"), "url",
        F.greatest(F.col("total") - k, F.lit(0).cast("long")).alias("more"))


def historical_urls(resources: DataFrame, k: int = fixed.TOP_RESOURCES) -> DataFrame:
    """Resources no longer current: first k per host and the total."""
    h = resources.where(~F.col("is_current"))
    w = Window.partitionBy("hostname").orderBy("normalized_url")
    top = h.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    totals = h.groupBy("hostname").agg(F.count("*").cast("long").alias("total"))
    return top.join(totals, "hostname").select("hostname", F.col("rank").cast("long").alias("rank"),
                                               "url", "total")


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Findings of severity CRITICAL..LOW in section order (T4)."""
    f = findings.where(F.col("finding_severity") != "INFORMATIONAL")
    return f.select("hostname", "finding_severity",
                    C.severity_rank(F.col("finding_severity")).alias("severity_rank"), "url", "title"
                    ).orderBy("hostname", "severity_rank", "url")


def secret_summary(resources_with_secrets: DataFrame) -> DataFrame:
    """Per host: total secret matches and resources having any."""
    r = resources_with_secrets
    return r.groupBy("hostname").agg(F.sum("secret_count").cast("long").alias("total_secrets_found"),
                                     _count_if(F.col("secret_count") > 0).alias("resources_with_secrets"))


def url_list(resources: DataFrame) -> DataFrame:
    """``[status] url`` per resource, ``[UNKNOWN]`` without a response."""
    status = F.when(F.col("status_code").isNotNull(),
                    F.concat(F.lit("["), F.col("status_code").cast("string"), F.lit("] "))
                    ).otherwise(F.lit("[UNKNOWN] "))
    return resources.select("hostname", "normalized_url", F.concat(status, F.col("url")).alias("line"))


def historical_count(resources: DataFrame) -> DataFrame:
    """Per host: resources no longer current (header field of S6)."""
    return resources.groupBy("hostname").agg(_count_if(~F.col("is_current")).alias("historical_urls"))


def report_header(targets: DataFrame, captures: DataFrame, stats: DataFrame, counts: DataFrame, sensitive: DataFrame,
                  secrets_summary: DataFrame, historical: DataFrame, max_depth: int | None = None,
                  include_subdomains: bool = False) -> DataFrame:
    """One row per target (S6 header): target, configuration, capture times and statistics."""
    st = (stats.join(counts, "hostname", "left").join(sensitive, "hostname", "left")
          .join(secrets_summary, "hostname", "left").join(historical, "hostname", "left"))
    own = U.with_parts(captures.select("url", "captured_at"), "url", "c_")
    times = own.groupBy(U.site("c_scheme", "c_netloc").alias("hostname")).agg(
        F.min("captured_at").alias("start_time"), F.max("captured_at").alias("end_time"))
    t = targets.select("hostname", F.struct("base_url", "hostname", "base_domain", "scheme", "port").alias("target"))
    conf = F.struct(F.lit(max_depth).cast("int").alias("max_depth"), F.lit(include_subdomains).alias("include_subdomains"))
    stat_cols = ["urls_discovered", "urls_checked", "currently_accessible", "historical_urls", "documents", "images",
                 "data_files", "potential_sensitive_files", "critical_count", "high_count",
                 "medium_count", "low_count", "info_count", "total_secrets_found"]
    return t.join(st, "hostname", "left").join(times, "hostname", "left").select(
        "hostname", "target", conf.alias("configuration"), "start_time", "end_time",
        F.struct(*[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in stat_cols]).alias("statistics"))


def report_findings(findings: DataFrame, secrets: DataFrame) -> DataFrame:
    """One row per finding (S6 body) with its redacted secrets as a nested list. Secrets are
    gathered per finding only (bounded by one response); findings are never gathered per
    target, so a host with millions of findings stays spread over many tasks and files."""
    sec = secrets.groupBy("normalized_url").agg(F.array_sort(F.collect_list(F.struct(
        "line_number", "match_pos", F.col("secret_type").alias("type"), "redacted_value",
        (F.col("confidence") / 100.0).alias("confidence")))).alias("secrets"))
    empty = F.array().cast("array<struct<type:string,redacted_value:string,confidence:double>>")
    return findings.join(sec, "normalized_url", "left").select(
        "hostname", "normalized_url", F.col("finding_severity").alias("severity"), "title",
        F.col("finding_description").alias("description"), "evidence", "remediation", "url",
        "resource_type", "is_accessible",
        F.coalesce(F.transform("secrets", lambda s: s.dropFields("line_number", "match_pos")), empty)
        .alias("secrets"))


#: Folders that a sink spreads the hosts over.
HOST_BUCKETS = 64


def bucketed(df: DataFrame) -> DataFrame:
    """A folder per bucket of hosts, not per host: there may be millions of those."""
    return df.withColumn("host_bucket", F.pmod(F.xxhash64("hostname"), F.lit(HOST_BUCKETS)).cast("int"))


def write_json_report(header: DataFrame, findings_rows: DataFrame, path: str) -> None:
    """JSON sink: ``header`` (one line per target, with the time of writing) and ``findings`` (one line
    per finding), both by bucket of hosts, published together (``publish.published`` gives their folders)."""
    stamped = bucketed(header.withColumn("generated_at", F.current_timestamp()))
    rows = bucketed(findings_rows).repartitionByRange("host_bucket", "hostname", "normalized_url")
    publish(header.sparkSession, path, {
        "header": lambda folder: stamped.write.partitionBy("host_bucket").json(folder),
        "findings": lambda folder: rows.write.partitionBy("host_bucket").json(folder)})


def write_url_list(lines: DataFrame, path: str) -> None:
    """Text sink: the lines of ``url_list``, by bucket of hosts, published as ``urls``."""
    rows = bucketed(lines).repartitionByRange("host_bucket", "hostname", "normalized_url").select("host_bucket", "line")
    publish(lines.sparkSession, path, {"urls": lambda folder: rows.write.partitionBy("host_bucket").text(folder)})


def write_section_tables(tables: dict[str, DataFrame], path: str) -> None:
    """The report's tables (S8), one Parquet table per section, by bucket of hosts, published together."""
    if tables:
        spark = next(iter(tables.values())).sparkSession
        publish(spark, path, {name: (lambda folder, df=df: bucketed(df).write.partitionBy("host_bucket").parquet(folder))
                              for name, df in tables.items()})


def report_sections(header: DataFrame, groups: DataFrame, findings: DataFrame, resources: DataFrame) -> DataFrame:
    """The report's sections as one table (S8): hostname, section, pos, label, url, value. Counts have a label and a
    value; listed rows their place, and how many more there are (historical: how many in all)."""
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    names = [f.name for f in header.schema["statistics"].dataType.fields]
    stats = header.select("hostname", F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("pos"), F.lit(n).alias("label"),
                                                                   F.col(f"statistics.{n}").alias("value")) for i, n in enumerate(names, 1)])).alias("s"))
    parts = [
        stats.select("hostname", F.lit("statistics").alias("section"), "s.pos", "s.label", none.alias("url"), "s.value"),
        group_counts(groups).select("hostname", F.lit("groups").alias("section"), zero.alias("pos"), F.col("group_name").alias("label"),
                                    none.alias("url"), F.col("resources").alias("value")),
        top_findings(findings).select("hostname", F.concat(F.lit("top_"), F.lower("finding_severity")).alias("section"),
                                      F.col("rank").alias("pos"), F.col("title").alias("label"), "url", F.col("more").alias("value")),
        top_resources(groups).select("hostname", F.concat(F.lit("top_"), F.col("group_name")).alias("section"), F.col("rank").alias("pos"),
                                     none.alias("label"), "url", F.col("more").alias("value")),
        historical_urls(resources).select("hostname", F.lit("historical").alias("section"), F.col("rank").alias("pos"), none.alias("label"),
                                          "url", F.col("total").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
