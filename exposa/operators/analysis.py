"""Resource analysis: captures keyed by dedup URL, catch-all hosts (J8), the per-resource
verdict (C6), path exposure (C7) and the secret scan of accessible text responses (F7, X1, J6).

Joins are on ``normalized_url`` (unique after dedup) and on host for the catch-all flag (one
row per host; AQE broadcasts it when its measured size is small and otherwise shuffles both
sides, splitting a hot host with its skew-join handling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.functions import classify as C
from exposa.functions import content as T
from exposa.functions import fixed
from exposa.functions import secrets as X
from exposa.functions import urls as U
from exposa.session import materialize


def _tagger(name: str, i: int):
    """(value, position) -> struct(name=i, pos, v), for ``transform`` over extracted matches."""
    return lambda v, j: F.struct(F.lit(i).alias(name), j.alias("pos"), v.alias("v"))


FEATURE_COLUMNS = (["url", "final_url", "status_code", "content_type", "content_length", "server",
                    "location", "captured_at", "is_current", "is_directory_listing", "has_sample"] + T.HEAD_FLAGS + ["snippet"])


def capture_features(captures: DataFrame, sample_chars: int | None = None,
                     sniff_chars: int | None = None) -> DataFrame:
    """Per capture, everything later steps need from the body, computed where the body is read
    (a narrow projection, no shuffle): the directory-listing flag, whether a sample exists, the
    booleans the soft-404 rules read from the head, and the redacted evidence snippet. Bodies
    never reach a shuffle.

    The snippet is only kept when the resource can become a finding: a listing, or a path whose
    category or document test fires. A resource sharing this capture's dedup key has this path
    with or without one trailing '/', so both are tested (an exact superset of the findings).
    """
    c = U.with_normalized(captures, "url", "normalized_url", keep_parts=True, prefix="cf_")
    c = c.withColumn("sample", T.response_sample(F.col("body"), F.col("status_code"),
                                                 F.col("content_type"), sample_chars))
    has_sample = F.col("sample").isNotNull() & (F.col("sample") != "")
    listing = F.coalesce((F.col("status_code") == 200) & T.is_directory_listing(F.col("sample"), F.col("content_type")),
                         F.lit(False))
    c = c.withColumns({"is_directory_listing": listing, "has_sample": has_sample,
                       "_p": F.lower(F.regexp_replace(F.col("cf_path"), r"(?s)(.)/$", "$1"))})
    fn = C.filename_of(F.col("_p"))
    doc = C.ends_with_any(fn, fixed.SENSITIVE_DOC_EXTENSIONS)
    may_find = (F.col("is_directory_listing") | C.path_category(F.col("_p")).isNotNull()
                | C.path_category(F.concat(F.col("_p"), F.lit("/"))).isNotNull() | doc)
    flags = T.head_flags(F.col("sample"), sniff_chars)
    return c.select(
        "normalized_url", F.coalesce("etag", "last_modified").alias("validator"), "url", "final_url", "status_code", "content_type", "content_length", "server",
        "location", "captured_at", "is_current", "is_directory_listing", "has_sample", *[v.alias(k) for k, v in flags.items()],
        F.when(F.col("has_sample") & may_find, X.redacted_snippet(F.col("sample"))).alias("snippet"))


def capture_order() -> list[F.Column]:
    """Which capture of a URL counts: status 200 first, then the newest."""
    return [(F.coalesce(F.col("status_code"), F.lit(0)) != 200).alias("o1"),
            (-F.coalesce(F.col("captured_at"), F.lit(0))).alias("o2")]


#: Statuses of a capture that shows a version of a URL: 304 says that an earlier response still holds.
SHOWING = [200, 304]


def versions(captures: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """(keys, o1, o2, c): of each version of a URL the capture that counts (``payload`` in ``c``), to be compared by
    (o1, o2). A version is what its validator names: ETag, else Last-Modified, else none. A 304 stands for the
    responses of its version before it: they count as seen then, and are as current as it is. Copies are reduced
    map-side (``min`` and ``max`` over structs), so a URL captured any number of times is one row per map task."""
    shown = F.when(F.col("status_code").isin(SHOWING), F.struct(F.coalesce("captured_at", F.lit(0)).alias("at"),
                                                                 F.coalesce("is_current", F.lit(True)).alias("current")))
    v = captures.groupBy(*keys, "validator").agg(F.min(F.struct(*capture_order(), *payload)).alias("c"), F.max(shown).alias("shown"))
    fetched = ~F.col("c.o1")
    v = v.withColumn("o2", F.when(fetched, -F.col("shown.at")).otherwise(F.col("c.o2")))
    if "is_current" in payload:
        v = v.withColumn("c", F.when(fetched, F.col("c").withField("is_current", F.col("shown.current"))).otherwise(F.col("c")))
    return v.select(*keys, "c.o1", "o2", "c")


def with_captures(urls: DataFrame, features: DataFrame) -> DataFrame:
    """Each URL (one row per normalized_url) with one capture of its dedup key, if there is any: of its
    own spelling first, then status 200, then the version seen last. Copies of a URL are reduced before the join
    (rows carry features, not bodies)."""
    rest = [c for c in FEATURE_COLUMNS if c != "url"]
    copies = versions(features.withColumnRenamed("url", "capture_url"), ["normalized_url", "capture_url"], rest)
    both = urls.join(copies, "normalized_url", "left")
    best = F.min(F.struct((~F.coalesce(F.col("capture_url") == F.col("url"), F.lit(False))).alias("o0"),
                          "o1", "o2", "capture_url", "c"))
    one = both.groupBy(*urls.columns).agg(best.alias("b"))
    return one.select(*urls.columns, F.col("b.capture_url").alias("capture_url"),
                      *[F.col(f"b.c.{k}").alias(k) for k in rest])


def keyed_status(captures: DataFrame) -> DataFrame:
    """(normalized_url, status_code, content_type) of the capture that counts per dedup key."""
    c = captures.select("url", "status_code", "content_type", "captured_at", "is_current", F.coalesce("etag", "last_modified").alias("validator"))
    c = versions(U.with_normalized(c, "url", "normalized_url"), ["normalized_url", "url"], ["status_code", "content_type"])
    return c.groupBy("normalized_url").agg(F.min(F.struct("o1", "o2", "url", "c")).alias("b")).select(
        "normalized_url", F.col("b.c.status_code").alias("status_code"), F.col("b.c.content_type").alias("content_type"))


def catch_all_hosts(captures: DataFrame) -> DataFrame:
    """Hosts whose calibration path (a file that cannot exist) answered 200."""
    c = U.with_parts(captures.select("url", "status_code"), "url", "p_")
    c = c.where(F.col("p_path").rlike(fixed.CALIBRATION_PATTERN))
    c = c.select(U.site("p_scheme", "p_netloc").alias("hostname"),
                 (F.col("status_code") == 200).alias("ok"))
    return c.groupBy("hostname").agg(F.max("ok").alias("catch_all"))


def with_verdict(r: DataFrame) -> DataFrame:
    """Soft-404, accessibility, resource type and severity of classified responses (C5, C6) from their
    features; shared by the batch scan and the stream."""
    flags = {k: F.coalesce(F.col(k), F.lit(False)) for k in T.HEAD_FLAGS}
    r = r.withColumn("soft_404", F.coalesce((F.col("status_code") == 200) & T.soft_404_from_flags(
        flags, F.col("content_type"), F.col("ext"), F.col("filename"), F.col("catch_all")),
        F.lit(False)))
    r = r.withColumn("is_accessible", F.coalesce((F.col("status_code") == 200) & ~F.col("soft_404"),
                                                 F.lit(False)))
    has, soft, listing = F.col("has_response"), F.col("soft_404"), F.col("is_directory_listing")
    ctype, csev = F.col("class_type"), F.col("class_severity")
    upgrade = (has & ctype.isin("SOURCE_CONTROL_EXPOSURE", "DATABASE_EXPOSURE") & F.col("is_accessible")
               & (csev != "CRITICAL"))
    return r.withColumns({
        "resource_type": F.when(has & soft, F.lit("FALSE_POSITIVE"))
        .when(has & listing, F.lit("DIRECTORY_LISTING")).otherwise(ctype),
        "severity": F.when(has & soft, F.lit("INFORMATIONAL")).when(upgrade, F.lit("CRITICAL"))
        .when(has & listing, F.lit("MEDIUM")).otherwise(csev),
    })


def analyze(urls: DataFrame, captures: DataFrame, sample_chars: int | None = None,
            use_calibration: bool = True, sniff_chars: int | None = None) -> DataFrame:
    """Classify every discovered URL and grade its response.

    ``urls`` has (normalized_url, hostname, url, source, context). Adds the capture (if any),
    path, extension, file name, classification, soft-404 verdict, accessibility, final resource
    type and severity, the fixed description/evidence notes, and ``is_current`` (false where the
    response that counts is from an earlier crawl).
    """
    r = with_captures(urls.select("normalized_url", "hostname", "url", "source", "context"),
                      capture_features(captures, sample_chars, sniff_chars))
    r = U.with_parts(r, "url", "u_")
    r = r.withColumn("path", F.col("u_path")).drop(*[f"u_{k}" for k in U.PART_NAMES])
    r = C.with_classification(r, "path")
    r = r.withColumns({
        "ext": U.extension("path"),
        "filename": F.lower(C.filename_of(F.col("path"))),
        "has_response": F.col("status_code").isNotNull(),
        "is_directory_listing": F.coalesce(F.col("is_directory_listing"), F.lit(False)),
        "has_sample": F.coalesce(F.col("has_sample"), F.lit(False)),
    })
    if use_calibration:
        r = r.join(catch_all_hosts(captures), "hostname", "left")
    else:
        r = r.withColumn("catch_all", F.lit(False))
    r = with_verdict(r)
    has, soft, listing = F.col("has_response"), F.col("soft_404"), F.col("is_directory_listing")
    return r.withColumns({
        "description": F.when(has & soft, F.lit(fixed.SOFT_404_DESCRIPTION))
        .when(has & listing, F.lit(fixed.LISTING_DESCRIPTION)),
        "analysis_note": F.when(has & soft, F.concat(
            F.lit("Soft-404 detected at "), F.col("url"), F.lit(": status 200 with content-type "),
            F.coalesce(F.col("content_type"), F.lit("None"))))
        .when(has & listing, F.concat(F.lit("Directory listing detected at "), F.col("url"))),
        "is_current": F.coalesce(F.col("is_current"), F.lit(True)),
    })


def path_exposure(candidates: DataFrame, captures: DataFrame) -> DataFrame:
    """Each candidate URL of each target analysed without calibration; rows whose type is not
    PUBLIC_EXPECTED are kept (C7)."""
    c = candidates.select("normalized_url", "hostname", "url", F.lit("COMMON_PATHS").alias("source"),
                          F.col("path").alias("context"))
    return materialize(analyze(c, captures, use_calibration=False)).where(
        F.col("resource_type") != "PUBLIC_EXPECTED")


def secret_matches(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per secret match: keys, line_number, match_pos, secret_type, redacted_value,
    confidence (percent). Texts without any candidate match are dropped before the per-line
    explode; the raw value never leaves this function."""
    d = df.where(X.may_contain_secret(F.col(text_col)))
    lines = d.select(*keys, F.posexplode(X.split_lines(F.col(text_col))).alias("line_idx", "line"))
    lines = lines.where(X.may_contain_secret(F.col("line")))
    arrays = [F.transform(F.regexp_extract_all("line", F.lit(pat), 1),
                          _tagger("type_rank", i))
              for i, (_, pat, _) in enumerate(X.SECRET_PATTERNS)]
    m = lines.select(*keys, (F.col("line_idx") + 1).alias("line_number"),
                     F.explode(F.concat(*arrays)).alias("m"))
    m = m.where(F.col("m.v") != "")
    stype = None
    conf = None
    for i, (name, _, pct) in enumerate(X.SECRET_PATTERNS):
        cond = F.col("m.type_rank") == i
        stype = F.when(cond, F.lit(name)) if stype is None else stype.when(cond, F.lit(name))
        conf = F.when(cond, F.lit(pct)) if conf is None else conf.when(cond, F.lit(pct))
    m = m.withColumns({"secret_type": stype, "confidence": conf})
    return m.select(*keys, "line_number", (F.col("m.type_rank")).alias("type_rank"),
                    (F.col("m.pos") + 1).alias("match_pos"), "secret_type",
                    X.redact(F.col("secret_type"), F.col("m.v")).alias("redacted_value"), "confidence")


def capture_secrets(captures: DataFrame, sample_chars: int | None = None,
                    max_bytes: int | None = None) -> DataFrame:
    """Secret matches of every capture that passes the response part of the scan gate (F7:
    textual type, non-empty sample), scanned where the body is read. Keyed by ``CAPTURE_KEY``."""
    c = U.with_normalized(captures, "url", "normalized_url")
    sample = T.response_sample(F.col("body"), F.col("status_code"), F.col("content_type"), sample_chars)
    c = c.select("normalized_url", F.col("url").alias("capture_url"), "status_code", "content_type",
                 "content_length", F.coalesce("captured_at", F.lit(0)).alias("captured_at"), sample.alias("sample"))
    c = c.where(T.secret_scan_gate(F.col("status_code") == 200, F.col("content_type"), F.col("content_length"), max_bytes)
                & F.col("sample").isNotNull() & (F.col("sample") != ""))
    return secret_matches(c, CAPTURE_KEY, "sample")


#: What tells a capture from others of its URL.
CAPTURE_KEY = ["normalized_url", "capture_url", "captured_at"]


def resource_secrets(resources: DataFrame, cap_secrets: DataFrame) -> DataFrame:
    """Secret matches of the resources that are accessible (the rest of the scan gate, F7)."""
    ok = resources.where(F.col("is_accessible")).select(
        "normalized_url", "capture_url", F.coalesce("captured_at", F.lit(0)).alias("captured_at"))
    return cap_secrets.join(ok, CAPTURE_KEY, "left_semi").drop("capture_url", "captured_at")


def secret_rollup(secrets: DataFrame) -> DataFrame:
    """Per resource: secret count, critical-type flag and the ordered evidence lines."""
    line = F.concat(F.lit("  - "), F.col("secret_type"), F.lit(": "), F.col("redacted_value"),
                    F.lit(" (confidence: "), F.col("confidence").cast("string"), F.lit("%)"))
    s = secrets.withColumn("ord", F.struct("line_number", "match_pos", "type_rank", line.alias("text")))
    return s.groupBy("normalized_url").agg(
        F.count("*").cast("long").alias("secret_count"),
        F.max(F.col("secret_type").isin(fixed.CRITICAL_SECRET_TYPES)).alias("has_critical_secret"),
        F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda o: o["text"]), "\n")
        .alias("secret_lines"))


def with_secrets(resources: DataFrame, secrets: DataFrame) -> DataFrame:
    """Attach the secret rollup to resources."""
    r = resources.join(secret_rollup(secrets), "normalized_url", "left")
    return r.withColumns({
        "secret_count": F.coalesce(F.col("secret_count"), F.lit(0).cast("long")),
        "has_critical_secret": F.coalesce(F.col("has_critical_secret"), F.lit(False)),
    })
