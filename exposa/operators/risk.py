"""Risk grading (J7, R1, R2, X3) and finding texts.

The 36-entry risk matrix and the text tables are fixed-size dimensions: they are applied as
literal map lookups inside the projection (no join, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.functions import fixed


def _map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def risk_key(rtype: Column, has_secrets: Column, accessible: Column) -> Column:
    return F.concat_ws("|", rtype, has_secrets.cast("string"), accessible.cast("string"))


def matrix_severity(rtype: Column, has_secrets: Column, accessible: Column) -> Column:
    """Risk matrix lookup, INFORMATIONAL when the key is absent."""
    m = {f"{t}|{str(s).lower()}|{str(a).lower()}": sev for t, s, a, sev in fixed.RISK_MATRIX}
    return F.coalesce(F.element_at(_map(m), risk_key(rtype, has_secrets, accessible)),
                      F.lit("INFORMATIONAL"))


def with_assessment(resources: DataFrame) -> DataFrame:
    """Add ``base_severity`` (matrix), ``assessed_severity`` (after the critical-secret upgrade
    and the context modifiers) to resources carrying secret_count / has_critical_secret."""
    has_secrets = F.col("secret_count") > 0
    r = resources.withColumn("base_severity", matrix_severity(F.col("resource_type"), has_secrets,
                                                               F.col("is_accessible")))
    sev = F.when(F.col("has_critical_secret"), F.lit("CRITICAL")).otherwise(F.col("base_severity"))
    sev = F.when(F.col("is_current") & (sev == "LOW"), F.lit("MEDIUM")).otherwise(sev)
    lp = F.lower(F.coalesce(F.col("path"), F.lit("")))
    sensitive = F.lit(False)
    for w in fixed.SENSITIVE_PATH_WORDS:
        sensitive = sensitive | lp.contains(w)
    r = r.withColumn("_sev1", sev)
    s1 = F.col("_sev1")
    return r.withColumn("assessed_severity", F.when(sensitive & (s1 == "INFORMATIONAL"), F.lit("LOW"))
                        .when(sensitive & (s1 == "LOW"), F.lit("MEDIUM")).otherwise(s1)).drop("_sev1")


def title(rtype: Column, secret_count: Column) -> Column:
    base = F.coalesce(F.element_at(_map(fixed.FINDING_TITLES), rtype), F.lit(fixed.FINDING_TITLE_DEFAULT))
    suffix = F.concat(F.lit(" (Contains "), secret_count.cast("string"), F.lit(" Potential Secret"),
                      F.when(secret_count > 1, F.lit("s")).otherwise(F.lit("")), F.lit(")"))
    return F.when(secret_count > 0, F.concat(base, suffix)).otherwise(base)


def description(rtype: Column, is_current: Column, accessible: Column) -> Column:
    base = F.coalesce(F.element_at(_map(fixed.FINDING_DESCRIPTIONS), rtype),
                      F.lit(fixed.FINDING_DESCRIPTION_DEFAULT))
    status = (F.when(~is_current, F.lit(fixed.STATUS_HISTORICAL))
              .when(accessible, F.lit(fixed.STATUS_ACCESSIBLE))
              .otherwise(F.lit(fixed.STATUS_NOT_ACCESSIBLE)))
    return F.concat(base, status)


def remediation(rtype: Column) -> Column:
    return F.coalesce(F.element_at(_map(fixed.FINDING_REMEDIATIONS), rtype),
                      F.lit(fixed.FINDING_REMEDIATION_DEFAULT))


def evidence() -> Column:
    """Evidence text (R6) from resource columns: URL, source, response facts, secrets, listing
    note and the redacted snippet of accessible samples; absent parts are skipped."""
    c = F.col
    has = c("has_response")
    snippet = F.coalesce(c("snippet"), F.lit(""))
    show_snippet = c("is_accessible") & has & c("has_sample")
    parts = [
        F.concat(F.lit("URL: "), c("url")),
        F.concat(F.lit("Discovery Source: "), c("source")),
        F.when(has, F.concat(F.lit("HTTP Status: "), c("status_code").cast("string"))),
        F.when(has & c("content_type").isNotNull() & (c("content_type") != ""),
               F.concat(F.lit("Content-Type: "), c("content_type"))),
        F.when(has & c("server").isNotNull() & (c("server") != ""), F.concat(F.lit("Server: "), c("server"))),
        F.when(c("secret_count") > 0, F.concat(F.lit("\nSecrets Detected:\n"), c("secret_lines"))),
        F.when(has & c("is_directory_listing"), F.lit("Directory listing is ENABLED on this resource")),
        F.when(show_snippet & (snippet != ""), F.concat(F.lit("\nVerified Content (redacted):\n"), snippet)),
    ]
    return F.concat_ws("\n", *parts)


def findings(assessed: DataFrame) -> DataFrame:
    """Findings (R3): resources whose analysed severity is not INFORMATIONAL, graded by the
    assessment, with title, description, evidence and remediation."""
    f = assessed.where(F.col("severity") != "INFORMATIONAL")
    return f.withColumns({
        "finding_severity": F.col("assessed_severity"),
        "title": title(F.col("resource_type"), F.col("secret_count")),
        "finding_description": description(F.col("resource_type"), F.col("is_current"), F.col("is_accessible")),
        "evidence": evidence(),
        "remediation": remediation(F.col("resource_type")),
    })
