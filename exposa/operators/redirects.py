"""Redirect chains over captured responses (S1, F5): where each redirecting URL ends, after how many hops, and
which hop leaves the authorised scope.

The redirects form a graph in which every URL has at most one way out. Chains are followed by pointer doubling:
a row says where its URL leads after some hops, and a join of the table with itself on that place makes it twice as
many, so a chain of n hops takes log2(n) joins instead of n. The table's keys are unique, so a place to which
millions of URLs lead is one row of one side (AQE splits the other).

A row whose way has no end leads into a loop. When a way is longer than there are redirects, it has been all
around: its place lies on the loop, and the least key seen on the way from there is the loop's name.

Whether a hop is in scope depends on its host and on where the chain began. So a row carries each different host
of its way with the first hop to it; all hops to one host are judged alike. A way through few hosts stays small
however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.functions import fixed
from exposa.functions import scope as S
from exposa.functions import urls as U
from exposa.operators import analysis as A
from exposa.session import materialize


def redirects(captures: DataFrame) -> DataFrame:
    """(key, url, location, to_url, to_key, host): the redirect of each dedup key whose capture that counts is one.
    ``host``: that of the Location, null in a relative one."""
    c = U.with_normalized(captures.select("url", "status_code", "location", "captured_at"), "url", "key")
    c = c.groupBy("key").agg(F.min(F.struct(*A.capture_order(), "url", "status_code", "location")).alias("c"))
    c = c.select("key", "c.url", "c.status_code", "c.location").where(
        F.col("status_code").isin(fixed.REDIRECT_STATUSES) & (F.col("location") != ""))
    c = U.with_parts(materialize(c), "location", "l_")
    c = c.withColumn("host", U.hostname_of_netloc("l_netloc"))
    c = U.with_normalized(U.with_resolved(c, "url", "location", "to_url"), "to_url", "to_key")
    return materialize(c.select("key", "url", "location", "to_url", "to_key", "host"))


def _later(hosts, hops):
    return F.transform(hosts, lambda h: F.struct(h["host"].alias("host"), (h["hop"] + hops).alias("hop")))


def _first(hosts):
    """Each host once, with its first hop."""
    return F.transform(F.array_distinct(F.transform(hosts, lambda h: h["host"])), lambda name: F.struct(
        name.alias("host"), F.array_min(F.transform(F.filter(hosts, lambda h: h["host"] == name), lambda h: h["hop"])).alias("hop")))


def ways(edges: DataFrame) -> DataFrame:
    """(key, to_key, to_url, hops, loop, hosts) of each key: where its way ends, or the loop it leads into (then
    hops is null and the place one on the loop). ``hosts``: array of (host, first hop)."""
    one = F.when(F.col("host").isNotNull(), F.array(F.struct("host", F.lit(1).cast("bigint").alias("hop"))))
    none = F.array().cast("array<struct<host:string,hop:bigint>>")
    start = edges.select("key", "to_key", "to_url", F.lit(1).cast("bigint").alias("hops"), F.col("to_key").alias("least"),
                         F.coalesce(one, none).alias("hosts"))
    ends = edges.select(F.col("key").alias("to_key"), F.lit(False).alias("ended"))
    table = materialize(start.join(ends, "to_key", "left").withColumn("ended", F.coalesce("ended", F.lit(True))))
    total, length = table.count(), 1
    while (open_ways := table.where("NOT ended").count()) and length <= total:
        further = table.select(F.col("key").alias("to_key"), *[F.col(c).alias(f"n_{c}") for c in table.columns if c != "key"])
        both = table.where("NOT ended").join(further, "to_key")
        # in two steps: a name given in the same select would stand for the new value inside the lambdas
        both = both.withColumn("all_hosts", _first(F.concat("hosts", _later(F.col("n_hosts"), F.col("hops")))))
        longer = both.select(
            "key", F.col("n_to_key").alias("to_key"), F.col("n_to_url").alias("to_url"), (F.col("hops") + F.col("n_hops")).alias("hops"),
            F.least("least", "n_least").alias("least"), F.col("all_hosts").alias("hosts"), F.col("n_ended").alias("ended"))
        table = materialize(table.where("ended").unionByName(longer))
        length *= 2
    if not open_ways:
        return table.select("key", "to_key", "to_url", "hops", F.lit(None).cast("string").alias("loop"), "hosts")
    on_loop = table.where("NOT ended").select(F.col("key").alias("to_key"), F.col("least").alias("loop"))
    return table.join(on_loop, "to_key", "left").select(
        "key", "to_key", "to_url", F.when(F.col("ended"), F.col("hops")).alias("hops"), "loop", "hosts")


def _judged(edges: DataFrame, found: DataFrame) -> DataFrame:
    """The ways with their first URL's site, and a verdict for each of their hosts."""
    w = U.with_parts(edges.select("key", "url").join(found, "key"), "url", "s_")
    w = w.withColumns({"hostname": U.site("s_scheme", "s_netloc"), "s_host": U.hostname_of_netloc("s_netloc")})
    w = w.withColumn("s_domain", U.base_domain("s_host"))
    return w.withColumn("judged", F.transform("hosts", lambda h: F.struct(
        h["hop"].alias("hop"), h["host"].alias("host"),
        S.redirect_verdict(h["host"], S.is_private_ip(h["host"]), "s_host", "s_domain").alias("verdict"))))


def redirect_chains(captures: DataFrame) -> DataFrame:
    """(hostname, url, hops, final_url, outcome, final_status, loop, verdict, blocked_hop): one row per redirecting
    URL. ``outcome``: 'final' (a response was captured there), 'unseen' or 'loop'. ``verdict``: that of the first
    blocked hop, else 'allowed', or 'relative' if no hop names a host."""
    edges = redirects(captures)
    c = _judged(edges, ways(edges))
    c = c.withColumn("blocked", F.array_min(F.filter("judged", lambda h: h["verdict"].startswith("blocked"))))
    status = A.keyed_status(captures).select(F.col("normalized_url").alias("to_key"), F.col("status_code").alias("final_status"))
    c = c.join(status, "to_key", "left")
    looping = F.col("loop").isNotNull()
    return c.select(
        "hostname", "url", "hops", F.when(~looping, F.col("to_url")).alias("final_url"),
        F.when(looping, F.lit("loop")).when(F.col("final_status").isNotNull(), F.lit("final")).otherwise(F.lit("unseen")).alias("outcome"),
        F.when(~looping, F.col("final_status")).alias("final_status"), "loop",
        F.coalesce("blocked.verdict", F.when(F.size("hosts") > 0, F.lit("allowed")), F.lit("relative")).alias("verdict"),
        F.col("blocked.hop").alias("blocked_hop"))


def redirect_hops(captures: DataFrame) -> DataFrame:
    """(hostname, url, host, first_hop, verdict): each host that a chain visits, judged from its first URL."""
    edges = redirects(captures)
    return _judged(edges, ways(edges)).select("hostname", "url", F.explode("judged").alias("h")).select(
        "hostname", "url", "h.host", F.col("h.hop").alias("first_hop"), "h.verdict")
