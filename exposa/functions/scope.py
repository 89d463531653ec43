"""Scope columns: targets (U5-U7), in-scope (F1), valid links (F2), private and unsafe hosts
(F3, F4), redirect verdicts (F5) and candidate path safety (F6).

Address checks are two regexes each: the shape of an IPv4/IPv6 literal, then the private ranges
written as dotted prefixes (IPv4) or leading hextets (IPv6). Every builder reads its input
column once or twice, because the optimizer inlines derived columns into pushed-down filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.functions import fixed
from exposa.functions import urls as U

IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
# Shape of an IPv6 literal (hex groups and colons, at least two colons, optional dotted tail).
IPV6 = r"^[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,7}(:(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3})?$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Private IPv4 ranges as dotted prefixes (valid only together with the IPv4 shape test):
# 127/8, 10/8, 172.16/12, 192.168/16, 169.254/16.
PRIVATE_V4 = r"^(?:127\.|10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|169\.254\.)"
# ::1, fc00::/7 (fd00::/8 included), fe80::/10 on the lower-cased literal.
PRIVATE_V6 = r"^(?:[0:]*:0{0,3}1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$"


def is_private_ip(host) -> Column:
    """Literal address in one of the private ranges."""
    h = _c(host)
    v4 = h.rlike(IPV4) & h.rlike(PRIVATE_V4)
    lh = F.lower(h)
    v6 = lh.rlike(IPV6) & lh.rlike(PRIVATE_V6)
    return F.coalesce(v4 | v6, F.lit(False))


def private_reason(host) -> Column:
    """Why a target host is refused: 'metadata_host', 'private_address' or null."""
    h = _c(host)
    return (F.when(h == fixed.METADATA_HOST, F.lit("metadata_host"))
            .when(is_private_ip(h), F.lit("private_address")))


def is_unsafe_host(host) -> Column:
    """No host, a localhost name, a private address or a metadata host."""
    h = _c(host)
    return (h.isNull() | F.lower(h).isin(fixed.LOCALHOST_NAMES) | is_private_ip(h)
            | h.isin(fixed.METADATA_IP, fixed.METADATA_HOST))


def with_target(df: DataFrame, raw: str, prefix: str = "t_") -> DataFrame:
    """Normalise a target (U5-U7): prepend ``https://`` unless the text starts with
    ``http://``/``https://``, then scheme, hostname, port (default 443/80), base domain,
    ``scheme://host`` and the base URL. Invalid rows keep nulls and an ``{prefix}error``."""
    r = F.col(raw)
    df = df.withColumn(f"{prefix}_full", F.when(r.startswith("http://") | r.startswith("https://"), r)
                       .otherwise(F.concat(F.lit("https://"), r)))
    df = U.with_parts(df, f"{prefix}_full", f"{prefix}_p_")
    net = F.col(f"{prefix}_p_netloc")
    df = df.withColumns({
        f"{prefix}_host": U.hostname_of_netloc(net),
        f"{prefix}_port_text": U.port_text_of_netloc(net),
    })
    sch = F.col(f"{prefix}_p_scheme")
    host = F.col(f"{prefix}_host")
    ptxt = F.col(f"{prefix}_port_text")
    error = F.coalesce(
        F.when(F.coalesce(r, F.lit("")) == "", F.lit("empty")),
        F.when(U.netloc_has_bad_brackets(net), F.lit("invalid_url")),
        F.when(~sch.isin("http", "https"), F.lit("unsupported_scheme")),
        F.when(host.isNull(), F.lit("no_hostname")),
        private_reason(host),
        F.when(~ptxt.rlike(r"^(?:|[0-9]{1,5})$") | (ptxt.try_cast("int") > 65535), F.lit("invalid_port")))
    df = df.withColumn(f"{prefix}error", error)
    ok = F.col(f"{prefix}error").isNull()
    port = F.when(ptxt != "", ptxt.try_cast("int")).when(sch == "https", F.lit(443)).otherwise(F.lit(80))
    df = df.withColumns({
        f"{prefix}scheme": F.when(ok, sch),
        f"{prefix}hostname": F.when(ok, host),
        f"{prefix}port": F.when(ok, port),
        f"{prefix}base_domain": F.when(ok, U.base_domain(host)),
        f"{prefix}normalized": F.when(ok, F.concat(sch, F.lit("://"), host)),
    })
    default = F.when(F.col(f"{prefix}scheme") == "https", F.lit(443)).otherwise(F.lit(80))
    pport = F.col(f"{prefix}port")
    df = df.withColumn(f"{prefix}base_url", F.when(ok, F.concat(
        F.col(f"{prefix}scheme"), F.lit("://"), F.col(f"{prefix}hostname"),
        F.when(pport.isNotNull() & (pport != 0) & (pport != default),
               F.concat(F.lit(":"), pport.cast("string"))).otherwise(F.lit("")),
        F.lit("/"))))
    drop = [f"{prefix}_full", f"{prefix}_host", f"{prefix}_port_text"] + [
        f"{prefix}_p_{k}" for k in U.PART_NAMES]
    return df.drop(*drop)


def in_scope(netloc, target_host, base_domain, include_subdomains) -> Column:
    """Netloc equals the target host, or (with subdomains) ends with '.' + base domain (F1)."""
    n = _c(netloc)
    inc = include_subdomains if isinstance(include_subdomains, Column) else F.lit(bool(include_subdomains))
    return F.coalesce((n != "") & ((n == _c(target_host))
                                   | (inc & n.endswith(F.concat(F.lit("."), _c(base_domain))))),
                      F.lit(False))


INVALID_LINK = (r"^(?:[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
                r"\x{202f}\x{205f}\x{3000}]*$|mailto:|tel:|javascript:|data:|ftp:|file:|#)")


def is_valid_link(link) -> Column:
    """Not blank and not a mailto/tel/javascript/data/ftp/file or '#' link (F2)."""
    return F.coalesce(~_c(link).rlike(INVALID_LINK), F.lit(False))


def redirect_verdict(location_host, location_is_ip_private, target_host, base_domain) -> Column:
    """Verdict for a redirect Location (F5): relative, blocked_private, allowed, blocked_domain."""
    h = _c(location_host)
    return (F.when(h.isNull(), F.lit("relative"))
            .when(location_is_ip_private, F.lit("blocked_private"))
            .when(h == _c(target_host), F.lit("allowed"))
            .when(h.endswith(F.concat(F.lit("."), _c(base_domain))), F.lit("allowed"))
            .otherwise(F.lit("blocked_domain")))


def is_safe_path(path) -> Column:
    """Candidate path safety (F6): no traversal, not absolute, no drive, no system file."""
    p = _c(path)
    lp = F.lower(p)
    bad = (p.contains("../") | p.contains("..\\") | p.startswith("/") | p.startswith("\\")
           | ((F.length(p) > 1) & (F.substring(p, 2, 1) == ":")))
    for s in fixed.UNSAFE_PATH_SUBSTRINGS:
        bad = bad | lp.contains(s)
    return ~bad
