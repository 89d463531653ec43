"""URL builders (splitting, extension, dedup normalisation, relative resolution, base domain).

Everything is built from ``pyspark.sql.functions`` only, so the expressions stay inside
whole-stage codegen; no Python runs per row. Parsing is staged through columns (``with_parts``)
so a regex is evaluated once per row and never copied into later expressions. The split follows the
generic URI grammar (RFC 3986, appendix B) with the scheme restricted to letters, digits and
``+.-`` so that ``a_b:x`` is a path, as in the standard library's parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.functions import fixed

URL_REGEX = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_LEADING_JUNK = r"^[\x00-\x20]+"
# Schemes whose last path segment may carry ";params", which the parser splits off the path.
PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
                 "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel"]
# Schemes for which relative references are resolved.
RELATIVE_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
                    "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh",
                    "ws", "wss"]
NETLOC_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
                  "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn",
                  "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it: inside conditions Spark would
    compute it again for every reading."""
    return F.transform(F.array(value), use)[0]


def clean(url) -> Column:
    """Drop tab/CR/LF anywhere and control characters or spaces at the start."""
    return F.regexp_replace(F.translate(_c(url), "\t\r\n", ""), _LEADING_JUNK, "")


def with_parts(df: DataFrame, url: str, prefix: str) -> DataFrame:
    """Add ``{prefix}scheme`` (lower), ``netloc``, ``path`` (``;params`` removed), ``params``,
    ``query`` and ``fragment`` columns for the URL column ``url``.

    Staged projections: the first evaluates the split regex, the next ones only read its output,
    so no regex expression is copied into later expressions.
    """
    for stage in _cached_stages(("parts", url, prefix), lambda: _parts_stages(url, prefix)):
        df = df.withColumns(stage)
    return df.drop(f"{prefix}_clean", f"{prefix}_rawpath")


def _parts_stages(url: str, prefix: str) -> list[dict]:
    u = f"{prefix}_clean"
    raw = f"{prefix}_rawpath"
    takes_params = F.col(f"{prefix}scheme").isin(PARAM_SCHEMES)
    return [
        {u: clean(url)},
        {f"{prefix}scheme": F.lower(F.regexp_extract(u, URL_REGEX, 1)),
         f"{prefix}netloc": F.regexp_extract(u, URL_REGEX, 2),
         raw: F.regexp_extract(u, URL_REGEX, 3),
         f"{prefix}query": F.regexp_extract(u, URL_REGEX, 4),
         f"{prefix}fragment": F.regexp_extract(u, URL_REGEX, 5)},
        {f"{prefix}path": F.when(takes_params, F.regexp_replace(raw, r";[^/]*$", "")).otherwise(F.col(raw)),
         f"{prefix}params": F.when(takes_params, F.regexp_extract(raw, r";([^/]*)$", 1)).otherwise(F.lit(""))},
    ]


def netloc_has_bad_brackets(net) -> Column:
    """The parser rejects a netloc with an unbalanced ``[``/``]``."""
    net = _c(net)
    return net.contains("[") != net.contains("]")


def hostname_of_netloc(net) -> Column:
    """Host of a netloc: after the last ``@``, the bracket content or the text before ``:``,
    lower case; null when empty, like the parser's ``hostname``. One regex, one input reference."""
    host = F.regexp_replace(_c(net), r"(?s)^(?:.*@)?(?:[^\[]*\[([^\]]*).*|([^:]*).*)$", "$1$2")
    return F.nullif(F.lower(host), F.lit(""))


def port_text_of_netloc(net) -> Column:
    """Port text after the host, '' when absent."""
    return F.regexp_replace(_c(net), r"(?s)^(?:.*@)?(?:[^\[]*\[[^\]]*\]?[^:]*:?(.*)|[^:]*:?(.*))$", "$1$2")


def site(scheme, net) -> Column:
    """Name of the site a URL belongs to: the host, with the port unless it is the scheme's own. So letter
    case, a port that is spelled out, and http or https make no difference; null without a host."""
    scheme = _c(scheme)

    def named(parts):
        host, port = parts["host"], parts["port"]
        own = ((scheme == "https") & (port.try_cast("int") == 443)) | ((scheme == "http") & (port.try_cast("int") == 80))
        name = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
        return F.when(port.rlike("^[0-9]{1,5}$") & ~F.coalesce(own, F.lit(False)),
                      F.concat(name, F.lit(":"), port.try_cast("int").cast("string"))).otherwise(name)

    return once(F.struct(hostname_of_netloc(net).alias("host"), port_text_of_netloc(net).alias("port")), named)


def extension(path_col) -> Column:
    """'.' + text after the last '.' of the whole path, lower-cased; '' without a dot."""
    return F.lower(F.regexp_extract(_c(path_col), r"(?s)(\.[^.]*)$", 1))


def normalize(prefix: str) -> Column:
    """Dedup key (U3) from parts columns: lower scheme and netloc, no fragment, one trailing '/'
    removed unless the path is '/', query kept; the lower-cased input when the netloc cannot be
    parsed (caller passes the raw URL through ``raw``)."""
    pth2 = F.regexp_replace(F.col(f"{prefix}path"), r"(?s)(.)/$", "$1")
    query = F.regexp_replace(F.col(f"{prefix}query"), r"(?s)^(.)", "?$1")
    return F.concat(F.col(f"{prefix}scheme"), F.lit("://"), F.lower(F.col(f"{prefix}netloc")), pth2, query)


def with_normalized(df: DataFrame, url: str, out: str, keep_parts: bool = False,
                    prefix: str = "_n_") -> DataFrame:
    """Add the dedup key of ``url`` as ``out``."""
    df = with_parts(df, url, prefix)
    df = df.withColumn(out, F.when(netloc_has_bad_brackets(f"{prefix}netloc"), F.lower(F.col(url)))
                       .otherwise(normalize(prefix)))
    if not keep_parts:
        df = df.drop(*[f"{prefix}{k}" for k in PART_NAMES])
    return df


PART_NAMES = ["scheme", "netloc", "path", "params", "query", "fragment"]


def _unsplit(scheme_c, net, pth, params, query, fragment) -> Column:
    """Re-assemble a URL the way the standard library does for parsed parts (all Columns)."""
    pwp = F.when(params != "", F.concat(pth, F.lit(";"), params)).otherwise(pth)
    with_slash = F.when((pwp != "") & ~pwp.startswith("/"), F.concat(F.lit("/"), pwp)).otherwise(pwp)
    needs_net = (net != "") | ((scheme_c != "") & scheme_c.isin(NETLOC_SCHEMES) & ~pwp.startswith("//"))
    body = F.when(needs_net, F.concat(F.lit("//"), net, with_slash)).otherwise(pwp)
    out = F.when(scheme_c != "", F.concat(scheme_c, F.lit(":"), body)).otherwise(body)
    out = F.when(query != "", F.concat(out, F.lit("?"), query)).otherwise(out)
    return F.when(fragment != "", F.concat(out, F.lit("#"), fragment)).otherwise(out)


def _remove_dot_segments(segments: Column) -> Column:
    """Fold over path segments: '..' pops, '.' is skipped, other segments are appended."""
    return F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))))


_STAGE_CACHE: dict[tuple, list] = {}


def _cached_stages(key: tuple, build) -> list:
    """Column expressions depend only on column names, so each stage list is built once per
    Spark context (building them is hundreds of driver-to-JVM calls) and reused."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    full = (id(sc), sc.applicationId if sc else None) + key
    if full not in _STAGE_CACHE:
        _STAGE_CACHE[full] = build()
    return _STAGE_CACHE[full]


def with_resolved(df: DataFrame, base: str, href: str, out: str) -> DataFrame:
    """Add ``out`` = absolute URL of ``href`` relative to ``base`` (U4), following the standard
    library's join: same-scheme check, netloc takeover, empty-path handling, dot-segment removal,
    and for path-relative links dropping empty middle segments. Staged projections keep every
    regex evaluated once per row."""
    df = with_parts(df, base, "_rb_")
    df = with_parts(df, href, "_rh_")
    for stage in _cached_stages(("resolve", base, href, out), lambda: _resolve_stages(base, href, out)):
        df = df.withColumns(stage)
    drop = [f"_rb_{k}" for k in PART_NAMES] + [f"_rh_{k}" for k in PART_NAMES] + [
        "_r_scheme", "_r_kind", "_r_net", "_r_segs", "_r_segs2", "_r_joined"]
    return df.drop(*drop)


def _resolve_stages(base: str, href: str, out: str) -> list[dict]:
    b = {k: F.col(f"_rb_{k}") for k in PART_NAMES}
    r = {k: F.col(f"_rh_{k}") for k in PART_NAMES}
    stages = [{"_r_scheme": F.when(r["scheme"] == "", b["scheme"]).otherwise(r["scheme"])}]
    sch = F.col("_r_scheme")
    uses_net = sch.isin(NETLOC_SCHEMES)
    stages.append({
        "_r_kind": (F.when(F.col(href).isNull() | (F.col(href) == ""), F.lit("base"))
                    .when(F.col(base).isNull() | (F.col(base) == ""), F.lit("href"))
                    .when((sch != b["scheme"]) | ~sch.isin(RELATIVE_SCHEMES), F.lit("href"))
                    .when(uses_net & (r["netloc"] != ""), F.lit("own_net"))
                    .when((r["path"] == "") & (r["params"] == ""), F.lit("base_path"))
                    .when(r["path"].startswith("/"), F.lit("root"))
                    .otherwise(F.lit("relative"))),
        "_r_net": F.when(uses_net, b["netloc"]).otherwise(r["netloc"]),
    })
    base_dirs = F.split(b["path"], "/", -1)
    base_dirs = F.when(F.element_at(base_dirs, -1) != "",
                       F.slice(base_dirs, 1, F.size(base_dirs) - 1)).otherwise(base_dirs)
    stages.append({"_r_segs": F.when(F.col("_r_kind") == "root", F.split(r["path"], "/", -1))
                   .when(F.col("_r_kind") == "relative", F.concat(base_dirs, F.split(r["path"], "/", -1)))})
    segs = F.col("_r_segs")
    n = F.size(segs)
    stages.append({"_r_segs2": F.when((F.col("_r_kind") == "relative") & (n > 2), F.concat(
        F.slice(segs, 1, 1), F.filter(F.slice(segs, 2, F.greatest(n - 2, F.lit(1))), lambda x: x != ""),
        F.slice(segs, -1, 1))).otherwise(segs)})
    segs2 = F.col("_r_segs2")
    folded = _remove_dot_segments(segs2)
    folded = F.when(F.element_at(segs2, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    stages.append({"_r_joined": F.array_join(folded, "/")})
    joined = F.when(F.col("_r_joined") == "", F.lit("/")).otherwise(F.col("_r_joined"))
    net = F.col("_r_net")
    kind = F.col("_r_kind")
    stages.append({out: F.when(kind == "base", F.col(base))
                   .when(kind == "href", F.col(href))
                   .when(kind == "own_net", _unsplit(sch, r["netloc"], r["path"], r["params"], r["query"], r["fragment"]))
                   .when(kind == "base_path", _unsplit(sch, net, b["path"], b["params"],
                         F.when(r["query"] == "", b["query"]).otherwise(r["query"]), r["fragment"]))
                   .otherwise(_unsplit(sch, net, joined, r["params"], r["query"], r["fragment"]))})
    return stages


def base_domain(host) -> Column:
    """Registrable-looking domain (U6): the host itself for <= 2 labels, the last three labels
    when the last two form a known multi-part suffix, else the last two labels."""
    h = _c(host)
    labels = F.split(h, r"\.", -1)
    last2 = F.array_join(F.slice(labels, -2, 2), ".")
    last3 = F.array_join(F.slice(labels, -3, 3), ".")
    return (F.when(F.size(labels) <= 2, h)
            .when(last2.isin(fixed.MULTI_PART_TLDS), last3)
            .otherwise(last2))


def file_category(path_col) -> Column:
    """Extension family of the lower-cased path (U8), null when none applies."""
    ext = extension(F.lower(_c(path_col)))
    expr = None
    for name, exts in fixed.FILE_CATEGORY_EXTENSIONS:
        cond = ext.isin(exts)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(None).cast("string"))


def should_crawl(path_col) -> Column:
    """Crawlable page test (U9) on the path."""
    p = F.lower(_c(path_col))
    skip = F.lit(False)
    for e in fixed.CRAWL_SKIP_EXTENSIONS:
        skip = skip | p.endswith(e)
    page = F.lit(False)
    for e in fixed.CRAWL_PAGE_EXTENSIONS:
        page = page | p.endswith(e)
    last_dot = F.locate(".", F.reverse(p))
    last_slash = F.locate("/", F.reverse(p))
    no_ext = (last_dot == 0) | ((last_slash > 0) & (last_dot > last_slash))
    return F.when(skip, F.lit(False)).when(page, F.lit(True)).otherwise(no_ext)
