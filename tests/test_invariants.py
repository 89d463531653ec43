"""Invariants of the scan: unique resources, findings = graded resources, and the same results
whatever the shuffle partitioning."""

from pyspark.sql import functions as F

from exposa.plans.scan import DataScan, Scan

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_invariants_and_partitioning(spark):
    results = {}
    for parts in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        s = DataScan(spark, SF)
        res = s.resources
        assert res.count() == res.select("normalized_url").distinct().count()
        assert s.findings.count() == res.where(F.col("severity") != "INFORMATIONAL").count()
        results[parts] = (
            _rows(s.findings.select("normalized_url", "finding_severity", "title", "evidence")),
            _rows(s.urls.select("normalized_url", "url", "source")),
        )
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[1] == results[8]


def test_findings_come_from_the_captures(spark):
    """Nothing is found on a host whose captures show nothing, and hosts differ."""
    s = Scan(spark.createDataFrame([("https://quiet.example.com/", "text/html", "<html><body>hi</body></html>")],
                                   "url string, content_type string, body string"))
    assert s.resources.where("is_accessible and severity <> 'INFORMATIONAL'").count() == 0
    data = DataScan(spark, SF)
    per_host = {r["n"] for r in data.findings.where("is_accessible").groupBy("hostname").agg(F.count("*").alias("n")).collect()}
    assert len(per_host) > 1
    flags = {r["catch_all"] for r in data.analyzed.select("catch_all").distinct().collect()}
    assert flags == {True, False, None}
    assert data.resources.where("not is_current").count() > 0


FILES = [("https://ex.com/files", 301, "text/html", 30, "", False), ("https://ex.com/files/", 200, "text/html", 20, "<h1>Index of /files</h1>", True),
         ("https://ex.com/files/", 404, "text/html", 99, "gone", True), ("https://ex.com/files/", 200, "text/html", 10, "older", False),
         ("https://ex.com/", 200, "text/html", 1, '<a href="/files/">f</a>', True)]


def test_the_capture_that_counts(spark):
    """Its own spelling first, then status 200, then the newest."""
    caps = spark.createDataFrame(FILES, "url string, status_code int, content_type string, captured_at long, body string, is_current boolean")
    r = Scan(caps, paths=[]).resources.where("normalized_url = 'https://ex.com/files'").collect()
    assert [(x.url, x.resource_type, x.captured_at, x.is_current) for x in r] == [("https://ex.com/files/", "DIRECTORY_LISTING", 20, True)]


def test_new_files_are_a_new_scan(spark, tmp_path):
    from exposa.plans.scan import scan_for
    for table in ("pages", "documents"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(5).write.parquet(f"{tmp_path}/{table}.parquet")
    first = scan_for(spark, str(tmp_path))
    assert scan_for(spark, str(tmp_path)) is first
    spark.read.parquet(f"{SF}/pages.parquet").limit(9).write.mode("append").parquet(f"{tmp_path}/pages.parquet")
    assert scan_for(spark, str(tmp_path)) is not first


def test_limits_are_options(spark):
    caps = spark.createDataFrame([("https://ex.com/.env", "text/plain", "A=1\n" + "y" * 200_000 + "\ntoken = abcdefghijklmnop1234"),
                                  ("https://ex.com/b.env", "text/html", "x" * 3000 + "\nKEY=1\n")], "url string, content_type string, body string")
    s = Scan(caps, paths=[])
    assert s.secrets.count() == 1 and Scan(caps, paths=[], max_secret_bytes=100_000).secrets.count() == 0
    soft = lambda x: x.analyzed.where("url like '%b.env'").first().soft_404
    assert not soft(s) and soft(Scan(caps, paths=[], sniff_chars=2000))
