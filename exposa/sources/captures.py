"""Capture sources (S1) and the tables derived from them.

The engine works on responses that were already captured; it sends no request. A capture row is one
response: ``CAPTURE_COLUMNS``. ``as_captures`` takes any table with a ``url`` and fills the columns it
lacks, so that a crawl's export can be scanned as it is. ``targets`` gives one authorised target per
site of a URL column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposa.functions import content as T
from exposa.functions import fixed
from exposa.functions import scope as S
from exposa.functions import urls as U

#: column -> type, and what a table without the column gets (None: null)
CAPTURE_COLUMNS = {
    "url": "string", "final_url": "string", "status_code": "int", "content_type": "string",
    "content_length": "bigint", "server": "string", "location": "string", "body": "string",
    "captured_at": "bigint", "is_current": "boolean", "headers": "map<string,string>", "etag": "string",
    "last_modified": "string", "title": "string", "redirect_chain": "array<string>", "error": "string",
}
#: columns that a response header gives where the column is absent or null
FROM_HEADERS = {"content_type": "content-type", "content_length": "content-length", "server": "server",
                "location": "location", "etag": "etag", "last_modified": "last-modified"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_names(headers: Column) -> Column:
    """A header map with lower-case names. Names that differ in letter case only are one header, its values
    joined by a comma in the map's order."""
    names = F.array_distinct(F.transform(F.map_keys(headers), lambda k: F.lower(F.trim(k))))

    def entry(name):
        own = F.filter(F.map_entries(headers), lambda e: F.lower(F.trim(e["key"])) == name)
        return F.struct(name, F.array_join(F.transform(own, lambda e: e["value"]), ", "))

    return F.map_from_entries(F.transform(names, entry))


def as_captures(df: DataFrame) -> DataFrame:
    """``df`` as captures: further columns dropped, missing ones filled (final URL: the URL; status 200; current:
    true; title: the body's; those of ``FROM_HEADERS`` from the headers; length: else the body's bytes; else
    null). Header names come out in lower case."""
    have = set(df.columns)
    headers = lower_names(F.col("headers")) if "headers" in have else F.lit(None).cast("map<string,string>")
    df = df.withColumn("headers", headers)
    given = {c: F.col(c) if c in have else F.lit(None) for c in CAPTURE_COLUMNS}
    body = given["body"].cast("string")
    out = {c: given[c].cast(t) for c, t in CAPTURE_COLUMNS.items()} | {"headers": F.col("headers")}
    out["final_url"] = F.coalesce(out["final_url"], F.col("url").cast("string"))
    out["is_current"] = F.coalesce(out["is_current"], F.lit(True))
    if "status_code" not in have:
        out["status_code"] = F.lit(200)
    for column, name in FROM_HEADERS.items() if "headers" in have else ():
        value = F.nullif(F.try_element_at(F.col("headers"), F.lit(name)), F.lit(""))
        out[column] = F.coalesce(out[column], value.try_cast(CAPTURE_COLUMNS[column]))
    if "content_length" not in have:
        out["content_length"] = F.coalesce(out["content_length"], F.octet_length(body).cast("bigint"))
    sample = T.response_sample(body, out["status_code"], out["content_type"], None)
    out["title"] = F.coalesce(out["title"], T.page_title(sample, out["content_type"]))
    return df.select(*[v.alias(c) for c, v in out.items()])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", "html")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a 200 HTML capture, in the order of the page ids."""
    return as_captures(read(spark, sf_dir, "pages").select(
        "url", F.lit("text/html; charset=utf-8").alias("content_type"), F.col("html").alias("body"),
        F.col("page_id").alias("captured_at")))


def hosts(urls: DataFrame) -> DataFrame:
    """Distinct lower-case hosts of a ``url`` column (partial aggregation before the shuffle)."""
    p = U.with_parts(urls.select("url"), "url", "p_")
    return (p.select(U.hostname_of_netloc("p_netloc").alias("host"))
            .where(F.col("host").isNotNull()).distinct())


def origins(urls: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """(site, scheme, named, away, ok, n): how the sites of a ``url`` column are reached. ``named``: a URL of the
    column has it; ``ok``: captures with status 200; ``away``: the root redirects to the site's other scheme,
    which then is an origin too. One row per site and scheme, added up before the shuffle."""
    none = {"status_code": F.lit(None).cast("int"), "location": F.lit(None).cast("string")}
    rows = urls.select("url", F.lit(True).alias("named"), *[c.alias(k) for k, c in none.items()])
    if captures is not None:
        rows = rows.unionByName(captures.select("url", F.lit(False).alias("named"), "status_code", "location"))
    rows = U.with_parts(U.with_parts(rows, "url", "p_"), "location", "l_")
    rows = rows.select("named", "status_code", F.col("p_scheme").alias("scheme"), F.col("l_scheme").alias("to"),
                       U.site("p_scheme", "p_netloc").alias("site"),
                       (F.col("status_code").isin(fixed.REDIRECT_STATUSES) & F.col("p_path").isin("", "/")
                        & (F.col("p_query") == "") & F.col("l_scheme").isin("http", "https")
                        & (F.col("l_scheme") != F.col("p_scheme")) & F.col("l_path").isin("", "/")
                        & (U.site("l_scheme", "l_netloc") == U.site("p_scheme", "p_netloc"))).alias("away"))
    rows = rows.where(F.col("site").isNotNull() & F.col("scheme").isin("http", "https"))
    away = F.coalesce("away", F.lit(False))
    ends = F.array(F.struct("scheme", away.alias("away"), (F.col("status_code") == 200).cast("int").alias("ok")),
                   F.when(away, F.struct(F.col("to").alias("scheme"), F.lit(False).alias("away"), F.lit(0).alias("ok"))))
    return (rows.select("site", "named", F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("e"))
            .groupBy("site", "e.scheme").agg(F.max("named").alias("named"), F.max("e.away").alias("away"),
                                             F.sum("e.ok").alias("ok"), F.count("*").alias("n")))


def targets(urls: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """One target per site of a ``url`` column, normalised like a user-supplied target (U5-U7). Its scheme is
    voted for: not one that redirects away, then the one with most captures of status 200, most rows, https.

    ``hostname`` names the site: the host, with a port that is not the scheme's own. Sites are reduced first
    (partial aggregation) and written as a small table, so the target expressions run once per site.
    """
    from exposa.session import materialize
    vote = F.struct(~F.col("away"), "ok", "n", F.col("scheme"))  # 'https' sorts after 'http'
    found = materialize(origins(urls, captures).groupBy("site").agg(F.max("named").alias("named"), F.max(vote).alias("v"))
                        .where("named").select("site", F.concat("v.scheme", F.lit("://"), "site").alias("original_url")))
    t = S.with_target(found, "original_url", "t_")
    return t.where(F.col("t_error").isNull()).select(
        "original_url", F.col("t_scheme").alias("scheme"), F.col("site").alias("hostname"),
        F.col("t_port").alias("port"), F.col("t_base_domain").alias("base_domain"),
        F.col("t_normalized").alias("normalized_target"), F.concat("t_scheme", F.lit("://"), "site", F.lit("/")).alias("base_url"))
