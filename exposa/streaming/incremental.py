"""Incremental analysis of captures as they land (Structured Streaming).

Capture files (parquet with the capture columns) arriving in a folder are classified and graded
with the same column builders as the batch scan: path category, type and severity, the sample
gate, directory listing and the soft-404 verdict. The catch-all flag is a stream-static join with
a host table (one row per host), refreshed by the batch job. Output is appended to a parquet
folder with a checkpoint location, so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from exposa.functions import classify as C
from exposa.functions import content as T
from exposa.functions import urls as U
from exposa.operators import analysis as A
from exposa.operators import report as R
from exposa.sources.captures import CAPTURE_COLUMNS

CAPTURE_SCHEMA = ", ".join(f"{c} {t}" for c, t in CAPTURE_COLUMNS.items())


def analyze_captures(captures: DataFrame, catch_all: DataFrame | None = None,
                     sample_chars: int | None = None) -> DataFrame:
    """Row-local analysis of captures (no dedup, no discovery): works on a stream or a batch."""
    c = U.with_normalized(captures, "url", "normalized_url", keep_parts=True, prefix="u_")
    c = c.withColumns({"path": F.col("u_path"), "hostname": U.site("u_scheme", "u_netloc")})
    c = c.drop(*[f"u_{k}" for k in U.PART_NAMES])
    c = C.with_classification(c, "path")
    c = c.withColumns({
        "ext": U.extension("path"),
        "filename": F.lower(C.filename_of(F.col("path"))),
        "sample": T.response_sample(F.col("body"), F.col("status_code"), F.col("content_type"), sample_chars),
    }).drop("body")
    if catch_all is not None:
        # one row per host: grows with the number of hosts, so no broadcast hint; the planner
        # broadcasts it only when its measured size is under the threshold
        c = c.join(catch_all.select("hostname", "catch_all"), "hostname", "left")
    else:
        c = c.withColumn("catch_all", F.lit(False))
    c = c.withColumns({
        "is_directory_listing": F.coalesce((F.col("status_code") == 200) & T.is_directory_listing(
            F.col("sample"), F.col("content_type")), F.lit(False)),
        "has_response": F.col("status_code").isNotNull(), **T.head_flags(F.col("sample"))})
    return A.with_verdict(c).select("hostname", "normalized_url", "url", "status_code", "category", "resource_type",
                                    "severity", "is_accessible", "soft_404", "is_directory_listing")


def start(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_location: str,
          catch_all: DataFrame | None = None, trigger_seconds: int | None = 30) -> StreamingQuery:
    """Start the streaming analysis: parquet files in ``source_dir`` -> parquet in ``sink_dir``.
    ``trigger_seconds=None`` processes what is available and stops (backfills, tests)."""
    stream = spark.readStream.schema(CAPTURE_SCHEMA).option("maxFilesPerTrigger", 1000).parquet(source_dir)
    out = R.bucketed(analyze_captures(stream, catch_all))
    w = (out.writeStream.outputMode("append").format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_location).partitionBy("host_bucket"))
    w = w.trigger(availableNow=True) if trigger_seconds is None else w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
