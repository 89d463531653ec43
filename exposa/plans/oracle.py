"""DuckDB SQL oracles: for each registered query, an independent statement of the same result in
ANSI SQL over the pre-registered views (``pages``, ``documents``, ...).

The SQL is written separately from the Spark plans (RE2 regexes, DuckDB list functions); the fixed
values and the statement of the queries' input (``responses``) are shared. The crawl is a recursive
query. Lists that both sides share are held against expected rows of their own in the tests.
"""

from __future__ import annotations

from html.entities import html5

from exposa.functions import fixed
from exposa.functions.references import windows_1252
from exposa.functions.secrets import KEY_BLOCK, LINE_MASKS, SECRET_PATTERNS
from exposa.plans import responses


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps",
                 "rtspu", "sip", "sips", "mms", "sftp", "tel"]


def clean(x: str) -> str:
    return f"regexp_replace(replace(replace(replace({x}, chr(9), ''), chr(13), ''), chr(10), ''), '^[\\x00-\\x20]+', '')"


def part(x: str, i: int) -> str:
    return f"regexp_extract({clean(x)}, '(?s){URL_RE}', {i})"


def scheme(x):
    return f"lower({part(x, 1)})"


def netloc(x):
    return part(x, 2)


def path(x):
    raw = part(x, 3)
    return (f"(CASE WHEN {scheme(x)} IN {in_list(PARAM_SCHEMES)} "
            f"THEN regexp_replace({raw}, ';[^/]*$', '') ELSE {raw} END)")


def query(x):
    return part(x, 4)


def host_of_netloc(n: str) -> str:
    """Host after the last '@': bracket content, else text before ':'; lower; NULL if empty."""
    hostinfo = f"regexp_extract({n}, '([^@]*)$', 1)"
    return (f"nullif(lower(CASE WHEN strpos({hostinfo}, '[') > 0 "
            f"THEN regexp_extract({hostinfo}, '\\[([^\\]]*)', 1) "
            f"ELSE split_part({hostinfo}, ':', 1) END), '')")


def host(x):
    return host_of_netloc(netloc(x))


def site(x: str) -> str:
    """Host of a URL, with its port unless that is the scheme's own."""
    info, h = f"regexp_extract({netloc(x)}, '([^@]*)$', 1)", host(x)
    port = (f"(CASE WHEN strpos({info}, '[') > 0 THEN regexp_extract({info}, '\\][^:]*:(.*)$', 1) "
            f"ELSE regexp_extract({info}, ':(.*)$', 1) END)")
    name = f"(CASE WHEN strpos({h}, ':') > 0 THEN '[' || {h} || ']' ELSE {h} END)"
    return (f"(CASE WHEN regexp_matches({port}, '^[0-9]{{1,5}}$') AND NOT ({scheme(x)} || TRY_CAST({port} AS INT) IN ('https443', 'http80')) "
            f"THEN {name} || ':' || TRY_CAST({port} AS INT) ELSE {name} END)")


def normalized(x: str) -> str:
    p = path(x)
    qy = query(x)
    n = netloc(x)
    body = (f"{scheme(x)} || '://' || lower({n}) || "
            f"(CASE WHEN {p} <> '/' AND ends_with({p}, '/') THEN left({p}, length({p}) - 1) ELSE {p} END) || "
            f"(CASE WHEN {qy} <> '' THEN '?' || {qy} ELSE '' END)")
    bad = f"((strpos({n}, '[') > 0) <> (strpos({n}, ']') > 0))"
    return f"(CASE WHEN {bad} THEN lower({x}) ELSE {body} END)"


def extension(p: str) -> str:
    return f"(CASE WHEN strpos({p}, '.') > 0 THEN '.' || lower(regexp_extract({p}, '\\.([^.]*)$', 1)) ELSE '' END)"


def base_domain(h: str) -> str:
    labels = f"string_split({h}, '.')"
    last2 = f"array_to_string({labels}[-2:], '.')"
    last3 = f"array_to_string({labels}[-3:], '.')"
    return (f"(CASE WHEN len({labels}) <= 2 THEN {h} WHEN {last2} IN {in_list(fixed.MULTI_PART_TLDS)} "
            f"THEN {last3} ELSE {last2} END)")


IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
IPV6 = r"^[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,7}(:(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3})?$"


def is_private(h: str) -> str:
    """IPv4 by octet arithmetic and range compare; IPv6 by first hextet."""
    o = [f"TRY_CAST(split_part({h}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    v4 = f"({o[0]} * 16777216 + {o[1]} * 65536 + {o[2]} * 256 + {o[3]})"
    ranges = [(127 << 24, (128 << 24) - 1), (10 << 24, (11 << 24) - 1),
              ((172 << 24) + (16 << 16), (172 << 24) + (32 << 16) - 1),
              ((192 << 24) + (168 << 16), (192 << 24) + (169 << 16) - 1),
              ((169 << 24) + (254 << 16), (169 << 24) + (255 << 16) - 1)]
    in_v4 = " OR ".join(f"{v4} BETWEEN {lo} AND {hi}" for lo, hi in ranges)
    lh = f"lower({h})"
    v6 = (f"(regexp_matches({lh}, '^[0:]*:0{{0,3}}1$') OR regexp_matches({lh}, '^f[cd][0-9a-f]{{2}}:') "
          f"OR regexp_matches({lh}, '^fe[89ab][0-9a-f]:'))")
    return (f"coalesce(CASE WHEN regexp_matches({h}, '{IPV4}') THEN ({in_v4}) "
            f"WHEN regexp_matches({lh}, '{IPV6}') THEN {v6} ELSE false END, false)")


_REFERENCE = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&"
#: The named references, as a map that queries join as one row.
ENTS = ("ents AS (SELECT MAP {" + ", ".join(f"{q(n)}: {q(c)}" for n, c in html5.items()) + "} AS named, MAP {"
        + ", ".join(f"{c}: {q(t)}" for c, t in windows_1252().items()) + "} AS old)")



# ------------------------------------------------------------------ shared CTEs
def captures_cte() -> str:
    """Targets from page hosts; pages and documents as captures."""
    h = host("url")
    return f"""
{ENTS},
{responses.captures_sql(h)},
shown AS (SELECT *, max(CASE WHEN status_code IN (200, 304) THEN captured_at END) OVER v AS shown_at,
                 arg_max(is_current, captured_at) FILTER (status_code IN (200, 304)) OVER v AS shown_current
          FROM captures WINDOW v AS (PARTITION BY url, coalesce(etag, last_modified))),
hosts AS (SELECT DISTINCT {h} AS hostname FROM pages WHERE {h} IS NOT NULL),
reached AS (SELECT site, sch, away, ok FROM (
    SELECT {site('url')} AS site, {scheme('url')} AS sch, false AS away, (status_code = 200)::INT AS ok FROM captures
    UNION ALL SELECT {site('url')}, {scheme("url")}, false, 0 FROM captures
    UNION ALL SELECT site, unnest([f, t]), unnest([true, false]), 0 FROM (
      SELECT {site('url')} AS site, {scheme('url')} AS f, {scheme('location')} AS t FROM captures
      WHERE status_code IN (301, 302, 303, 307, 308) AND {path('url')} IN ('', '/') AND {query('url')} = '' AND {path('location')} IN ('', '/')
            AND {scheme('location')} IN ('http', 'https') AND {scheme('location')} <> {scheme('url')} AND {site('location')} = {site('url')}))
  WHERE site IS NOT NULL AND sch IN ('http', 'https')),
votes AS (SELECT site, sch, row_number() OVER (PARTITION BY site ORDER BY away, ok DESC, n DESC, sch DESC) AS rn FROM (
  SELECT site, sch, bool_or(away) AS away, sum(ok) AS ok, count(*) FILTER (NOT away) AS n FROM reached GROUP BY 1, 2)),
targets AS (
  SELECT site AS hostname, sch AS scheme, CASE WHEN strpos(site, ':') > 0 THEN CAST(split_part(site, ':', 2) AS INT)
              WHEN sch = 'https' THEN 443 ELSE 80 END AS port,
         {base_domain("split_part(site, ':', 1)")} AS base_domain, sch || '://' || split_part(site, ':', 1) AS normalized_target,
         sch || '://' || site || '/' AS base_url
  FROM votes WHERE rn = 1 AND split_part(site, ':', 1) <> 'metadata.google.internal' AND NOT {is_private("split_part(site, ':', 1)")})"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


TEXTUAL = " OR ".join(f"strpos(lower(coalesce(content_type, '')), {q(t)}) > 0" for t in fixed.TEXTUAL_CONTENT_TYPES)
SAMPLE = f"(CASE WHEN status_code = 200 AND (({TEXTUAL}) OR coalesce(content_type, '') = '') THEN coalesce(body, '') END)"


def title_expr(sample: str) -> str:
    raw = f"regexp_extract(coalesce({sample}, ''), '(?is)<title>(.*?)</title>', 1)"
    ws = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    return (f"(CASE WHEN strpos(lower(coalesce(content_type, '')), 'text/html') > 0 AND {raw} <> '' "
            f"THEN regexp_replace({raw}, '^{ws}+|{ws}+$', '', 'g') END)")


def listing_expr(sample: str) -> str:
    inds = " OR ".join(f"strpos(lower(coalesce({sample}, '')), {q(i)}) > 0" for i in fixed.LISTING_INDICATORS)
    return f"coalesce(status_code = 200 AND strpos(lower(coalesce(content_type, '')), 'text/html') > 0 AND ({inds}), false)"


ORACLES: dict[str, str] = {}

_HEADERS = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {q(n)} END" for n, c in [
    ("etag", "etag"), ("last-modified", "last_modified"), ("location", "location"), ("server", "server")])
ORACLES["captures_load"] = with_ctes(captures_cte(), body=f"""
SELECT url, CAST(status_code AS BIGINT) AS status_code, content_type, content_length, server, location,
       captured_at, is_current, etag, last_modified, {title_expr(SAMPLE)} AS title, CAST(NULL AS VARCHAR) AS error,
       CASE WHEN url NOT IN (SELECT url FROM pages) THEN concat_ws(',', {_HEADERS}) END AS header_names,
       CAST(length(body) AS BIGINT) AS body_chars FROM captures""")

ORACLES["content_sample"] = with_ctes(captures_cte(), body=f"""
SELECT url, CAST(length({SAMPLE}) AS BIGINT) AS sample_chars FROM captures""")

ORACLES["page_title"] = with_ctes(captures_cte(), body=f"""
SELECT url, {title_expr(SAMPLE)} AS title FROM captures WHERE status_code = 200""")

ORACLES["directory_listing"] = with_ctes(captures_cte(), body=f"""
SELECT url, {listing_expr(SAMPLE)} AS is_directory_listing FROM captures""")

ORACLES["url_parts"] = f"""
SELECT page_id, {scheme('url')} AS scheme, {netloc('url')} AS netloc, {path('url')} AS path,
       {query('url')} AS query, {part('url', 5)} AS fragment FROM pages"""

ORACLES["base_domain"] = f"""
WITH hosts AS (SELECT DISTINCT {host('url')} AS host FROM pages WHERE {host('url')} IS NOT NULL)
SELECT host, {base_domain('host')} AS base_domain FROM hosts"""

ORACLES["normalize_target"] = f"""
WITH hosts AS (SELECT DISTINCT {host('url')} AS host FROM pages WHERE {host('url')} IS NOT NULL)
SELECT host AS original_url,
       CASE WHEN p THEN NULL ELSE 'https' END AS scheme, CASE WHEN p THEN NULL ELSE host END AS hostname,
       CAST(CASE WHEN p THEN NULL ELSE 443 END AS BIGINT) AS port,
       CASE WHEN p THEN NULL ELSE {base_domain('host')} END AS base_domain,
       CASE WHEN p THEN NULL ELSE 'https://' || host END AS normalized_target,
       CASE WHEN host = 'metadata.google.internal' THEN 'metadata_host'
            WHEN p THEN 'private_address' END AS error
FROM (SELECT host, host = 'metadata.google.internal' OR {is_private('host')} AS p FROM hosts)"""

ORACLES["target_base_url"] = with_ctes(captures_cte(), body="SELECT hostname, base_url FROM targets")

ORACLES["catch_all_hosts"] = with_ctes(captures_cte(), body=f"""
SELECT {site('url')} AS hostname, bool_or(status_code = 200) AS catch_all FROM captures
WHERE regexp_matches({path('url')}, '{fixed.CALIBRATION_PATTERN}') GROUP BY 1""")

_LOC_HOSTS = f"SELECT {host('location')} AS host FROM captures WHERE location IS NOT NULL AND {host('location')} IS NOT NULL"

ORACLES["private_hosts"] = with_ctes(captures_cte(), body=f"""
SELECT host, {is_private('host')} AS is_private,
       CASE WHEN host = 'metadata.google.internal' THEN 'metadata_host'
            WHEN {is_private('host')} THEN 'private_address' END AS reason
FROM (SELECT hostname AS host FROM hosts UNION {_LOC_HOSTS})""")

_RANGES = [(c, *c.partition("/")[::2]) for c in fixed.PRIVATE_RANGES + ["192.168.0.0/17", "192.168.128.0/20", "10.1.4.0/22", "10.1.7.2", "0.0.0.0/0"]
           if ":" not in c]
_V4_OF = "(" + " + ".join(f"TRY_CAST(split_part({{0}}, '.', {i + 1}) AS BIGINT) * {1 << 24 - 8 * i}" for i in range(4)) + ")"
ORACLES["address_ranges"] = with_ctes(captures_cte(), body=f"""
SELECT host, cidr FROM (SELECT host, {_V4_OF.format('host')} AS a FROM (SELECT hostname AS host FROM hosts UNION {_LOC_HOSTS})
                        WHERE regexp_matches(host, '{IPV4}')) JOIN
  (SELECT cidr, {_V4_OF.format('net')} AS low, 1::BIGINT << (32 - n) AS size FROM (VALUES {", ".join(f"({q(c)}, {q(net)}, {n or 32})" for c, net, n in _RANGES)}) v(cidr, net, n))
  ON a BETWEEN low AND low + size - 1""")

ORACLES["unsafe_urls"] = with_ctes(captures_cte(), body=f"""
SELECT url, (h IS NULL OR lower(h) IN {in_list(fixed.LOCALHOST_NAMES)} OR {is_private('h')}
             OR h IN ('169.254.169.254', 'metadata.google.internal')) AS is_unsafe
FROM (SELECT url, {host('url')} AS h FROM (SELECT url FROM captures UNION SELECT location FROM captures WHERE location IS NOT NULL))""")

_REDIRECTS = f"""redirects AS (
  SELECT url, status_code, location, {site('url')} AS ts, {host('url')} AS th, {host('location')} AS lh FROM captures
  WHERE status_code IN (301, 302, 303, 307, 308) AND location IS NOT NULL AND location <> ''),
verdicts AS (
  SELECT *, CASE WHEN lh IS NULL THEN 'relative' WHEN {is_private('lh')} THEN 'blocked_private'
                 WHEN lh = th THEN 'allowed' WHEN ends_with(lh, '.' || {base_domain('th')}) THEN 'allowed'
                 ELSE 'blocked_domain' END AS verdict FROM redirects)"""

ORACLES["redirect_verdict"] = with_ctes(captures_cte(), _REDIRECTS, body="""
SELECT url, CAST(status_code AS BIGINT) AS status_code, location, verdict FROM verdicts""")

ORACLES["redirects_blocked"] = with_ctes(captures_cte(), _REDIRECTS, body="""
SELECT ts AS hostname, CAST(count(*) FILTER (WHERE starts_with(verdict, 'blocked')) AS BIGINT) AS redirects_blocked
FROM verdicts GROUP BY ts""")


# ------------------------------------------------------------------ links and resolution
NETLOC_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
                  "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn",
                  "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services"]
RELATIVE_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp",
                    "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]


def parts_select(col: str, p: str) -> str:
    raw = part(col, 3)
    sch = scheme(col)
    return (f"{sch} AS {p}scheme, {netloc(col)} AS {p}netloc, "
            f"CASE WHEN {sch} IN {in_list(PARAM_SCHEMES)} THEN regexp_replace({raw}, ';[^/]*$', '') ELSE {raw} END AS {p}path, "
            f"CASE WHEN {sch} IN {in_list(PARAM_SCHEMES)} THEN regexp_extract({raw}, ';([^/]*)$', 1) ELSE '' END AS {p}params, "
            f"{query(col)} AS {p}query, {part(col, 5)} AS {p}fragment")


def unsplit(s, n, pth, params, qy, frag) -> str:
    pwp = f"(CASE WHEN {params} <> '' THEN {pth} || ';' || {params} ELSE {pth} END)"
    with_slash = f"(CASE WHEN {pwp} <> '' AND NOT starts_with({pwp}, '/') THEN '/' || {pwp} ELSE {pwp} END)"
    needs = f"({n} <> '' OR ({s} <> '' AND {s} IN {in_list(NETLOC_SCHEMES)} AND NOT starts_with({pwp}, '//')))"
    body = f"(CASE WHEN {needs} THEN '//' || {n} || {with_slash} ELSE {pwp} END)"
    out = f"(CASE WHEN {s} <> '' THEN {s} || ':' || {body} ELSE {body} END)"
    out = f"(CASE WHEN {qy} <> '' THEN {out} || '?' || {qy} ELSE {out} END)"
    return f"(CASE WHEN {frag} <> '' THEN {out} || '#' || {frag} ELSE {out} END)"


def resolved_select(rel: str, base: str, href: str, keep: str) -> str:
    """SELECT keep, url FROM rel, with url = href resolved against base (standard join rules,
    dot segments removed by folding over the segments)."""
    fold = ("list_reduce(segs, lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') "
            "WHEN s = '.' THEN acc ELSE acc || '/' || s END, '')")
    return f"""
SELECT {keep}, CASE
  WHEN {href} IS NULL OR {href} = '' THEN {base}
  WHEN {base} IS NULL OR {base} = '' THEN {href}
  WHEN hs <> b_scheme OR hs NOT IN {in_list(RELATIVE_SCHEMES)} THEN {href}
  WHEN hs IN {in_list(NETLOC_SCHEMES)} AND h_netloc <> '' THEN {unsplit('hs', 'h_netloc', 'h_path', 'h_params', 'h_query', 'h_fragment')}
  WHEN h_path = '' AND h_params = '' THEN {unsplit('hs', 'rn', 'b_path', 'b_params', "CASE WHEN h_query = '' THEN b_query ELSE h_query END", 'h_fragment')}
  ELSE {unsplit('hs', 'rn', "CASE WHEN joined = '' THEN '/' ELSE joined END", 'h_params', 'h_query', 'h_fragment')}
END AS url FROM (
  SELECT *, substr({fold}, 2) || CASE WHEN segs[-1] IN ('.', '..') THEN '/' ELSE '' END AS joined FROM (
    SELECT *, CASE WHEN starts_with(h_path, '/') THEN string_split(h_path, '/')
                   WHEN len(rel) <= 2 THEN rel
                   ELSE [rel[1]] || list_filter(rel[2:len(rel) - 1], lambda x: x <> '') || [rel[-1]] END AS segs
    FROM (
      SELECT *, (CASE WHEN string_split(b_path, '/')[-1] <> '' THEN string_split(b_path, '/')[:-2]
                      ELSE string_split(b_path, '/') END) || string_split(h_path, '/') AS rel,
             CASE WHEN h_scheme = '' THEN b_scheme ELSE h_scheme END AS hs,
             CASE WHEN (CASE WHEN h_scheme = '' THEN b_scheme ELSE h_scheme END) IN {in_list(NETLOC_SCHEMES)}
                  THEN b_netloc ELSE h_netloc END AS rn
      FROM (SELECT *, {parts_select(base, 'b_')}, {parts_select(href, 'h_')} FROM {rel}))))"""


TAG_RE = (r"(?i)<(?:" + "|".join(t for t, _ in fixed.LINK_TAG_ATTRS) + r""")[\s/](?:[\s/]+|[^\s/>][^\s/>=]*"""
          r"""(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?)*>""")
_INVALID = (r"^(?:[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
            r"\x{202f}\x{205f}\x{3000}]*$|mailto:|tel:|javascript:|data:|ftp:|file:|#)")


def decode(v: str) -> str:
    """Character references decoded piece by piece; ``ents`` must be in the FROM."""
    def character(code: str) -> str:
        return (f"CASE WHEN {code} BETWEEN 128 AND 159 THEN coalesce(old[CAST({code} AS INTEGER)], chr(CAST({code} AS INTEGER))) "
                f"WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr(CAST({code} AS INTEGER)) END")
    hexadecimal = "TRY_CAST('0x' || regexp_extract(p, '^&#[xX]0*([0-9a-fA-F]{1,6});?$', 1) AS BIGINT)"
    decimal = "TRY_CAST(regexp_extract(p, '^&#0*([0-9]{1,7});?$', 1) AS BIGINT)"
    longest = "list_max(list_filter(generate_series(2, length(p) - 2), lambda k: named[substr(p, 2, k)] IS NOT NULL))"
    piece = (f"CASE WHEN NOT starts_with(p, '&') OR p = '&' THEN p WHEN regexp_matches(p, '^&#[xX]') THEN coalesce({character(hexadecimal)}, p) "
             f"WHEN starts_with(p, '&#') THEN coalesce({character(decimal)}, p) "
             f"ELSE coalesce(named[substr(p, 2)], named[substr(p, 2, {longest})] || substr(p, {longest} + 2), p) END")
    return (f"(CASE WHEN strpos({v}, '&') > 0 THEN array_to_string(list_transform(regexp_extract_all({v}, {q(_REFERENCE)}), "
            f"lambda p: {piece}), '') ELSE {v} END)")


_ATTR = r"""[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?"""


def attribute(tag_html: str, name: str) -> str:
    own = (f"list_filter(regexp_extract_all(regexp_replace({tag_html}, '^<[A-Za-z0-9]+|>$', '', 'g'), {q(_ATTR)}), "
           f"lambda a: lower(regexp_extract(a, '^[^\\s=]+')) = {q(name)})[-1]")
    return (f"regexp_replace(regexp_extract(coalesce({own}, ''), '(?s)=\\s*(.*)$', 1), "
            f"{q(chr(40) + '?s)^' + chr(34) + '(.*)' + chr(34) + '$|^' + chr(39) + '(.*)' + chr(39) + '$')}, '\\1\\2')")


IS_HTML = "(coalesce(content_type, '') = '' OR strpos(lower(content_type), 'text/html') > 0)"


def links_ctes(include_subdomains: bool = False) -> list[str]:
    rank = " ".join(f"WHEN {q(t)} THEN {i}" for i, (t, _) in enumerate(fixed.LINK_TAG_ATTRS))
    ctx = " ".join(f"WHEN {q(t)} THEN {q(t + '.' + a)}" for t, a in fixed.LINK_TAG_ATTRS)
    val = " ".join(f"WHEN {q(t)} THEN {attribute('tag_html', a)}" for t, a in fixed.LINK_TAG_ATTRS)
    strip = ("regexp_replace(regexp_replace(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), "
             "'(?is)(<script\\b[^>]*>).*?</script\\s*>', '\\1', 'g'), '(?is)(<style\\b[^>]*>).*?</style\\s*>', '\\1', 'g')")
    own = f"strpos({netloc('url')}, '@') = 0 AND {site('url')} = {site('page_url')}"
    sub = f"strpos({netloc('url')}, '@') = 0 AND ends_with({site('url')}, '.' || {base_domain(host('page_url'))})"
    return [f"""
lk_pages AS (SELECT url AS page_url, {strip} AS h FROM captures WHERE status_code = 200 AND {IS_HTML}),
lk_tags AS (SELECT page_url, unnest(regexp_extract_all(h, {q(TAG_RE)})) AS tag_html,
                   unnest(generate_series(1, len(regexp_extract_all(h, {q(TAG_RE)})))) AS pos FROM lk_pages),
lk_vals AS (SELECT page_url, pos, lower(regexp_extract(tag_html, '^<([A-Za-z]+)', 1)) AS tag, tag_html FROM lk_tags),
lk_attr AS (SELECT page_url, pos, CASE tag {rank} END AS tag_rank, CASE tag {ctx} END AS context, CASE tag {val} END AS raw
            FROM lk_vals),
lk_raw AS (SELECT page_url, pos, tag_rank, context, {decode('raw')} AS href FROM lk_attr, ents),
lk_valid AS (SELECT * FROM lk_raw WHERE href <> '' AND NOT regexp_matches(href, {q(_INVALID)})),
lk_res AS ({resolved_select('lk_valid', 'page_url', 'href', 'page_url, pos, tag_rank, context, href')}),
links_all AS (SELECT page_url, CAST(tag_rank AS BIGINT) AS tag_rank, CAST(pos AS BIGINT) AS pos, context, href, url,
                     {normalized('url')} AS normalized_url, coalesce({own}, false) AS in_scope,
                     coalesce(({own}) OR ({sub}), false) AS in_scope_with_subdomains
              FROM lk_res),
links AS (SELECT * EXCLUDE (in_scope_with_subdomains) FROM links_all)"""]


def candidates_cte() -> str:
    vals = ", ".join(f"({i}, {q(p)})" for i, p in enumerate(fixed.candidate_paths()))
    return f"""
cand_defs(rank, path) AS (VALUES {vals}),
cand_in AS (SELECT t.hostname, t.base_url, c.rank, c.path FROM targets t CROSS JOIN cand_defs c),
cand_all AS ({resolved_select('cand_in', 'base_url', 'path', 'hostname, base_url, rank, path')})"""


LINK_URLS = "link_urls AS (SELECT url FROM links UNION SELECT url FROM cand_all UNION SELECT url FROM captures)"


def _with_links(body: str, extra: tuple = ()) -> str:
    return with_ctes(captures_cte(), *links_ctes(), *extra, body=body)


ORACLES["html_links"] = _with_links("SELECT * FROM links")
ORACLES["resolve_links"] = _with_links("SELECT page_url, pos, href, url FROM links")
ORACLES["normalize_url"] = _with_links(f"""
SELECT url, {normalized('url')} AS normalized_url FROM (SELECT url FROM pages UNION SELECT url FROM links)""")
_LU = (candidates_cte(), LINK_URLS)
ORACLES["url_extension"] = _with_links(f"SELECT url, {extension(path('url'))} AS extension FROM link_urls", _LU)


def file_category_expr(p: str) -> str:
    ext = extension(f"lower({p})")
    arms = " ".join(f"WHEN {ext} IN {in_list(exts)} THEN {q(name)}" for name, exts in fixed.FILE_CATEGORY_EXTENSIONS)
    return f"(CASE {arms} END)"


def should_crawl_expr(p: str) -> str:
    lp = f"lower({p})"
    skip = " OR ".join(f"ends_with({lp}, {q(e)})" for e in fixed.CRAWL_SKIP_EXTENSIONS)
    page = " OR ".join(f"ends_with({lp}, {q(e)})" for e in fixed.CRAWL_PAGE_EXTENSIONS)
    return (f"(CASE WHEN {skip} THEN false WHEN {page} THEN true "
            f"ELSE strpos({lp}, '.') = 0 OR (strpos({lp}, '/') > 0 AND "
            f"length({lp}) - strpos(reverse({lp}), '.') < length({lp}) - strpos(reverse({lp}), '/')) END)")


ORACLES["file_category"] = _with_links(f"SELECT url, {file_category_expr(path('url'))} AS file_category FROM link_urls", _LU)
ORACLES["should_crawl"] = _with_links(f"SELECT url, {should_crawl_expr(path('url'))} AS should_crawl FROM link_urls", _LU)


def category_expr(lp: str) -> str:
    def alt(pats):
        seen = []
        for p in pats:
            p = p.lower()
            if p not in seen:
                seen.append(p)
        return "|".join(f"(?:{p})" for p in seen)
    arms = []
    for cat in fixed.CATEGORY_ORDER:
        pats = fixed.framework_patterns() if cat == "laravel" else fixed.PATTERNS[cat]
        arms.append(f"WHEN regexp_matches({lp}, {q(alt(pats))}) THEN {q(cat)}")
    return "(CASE " + " ".join(arms) + " END)"


def classification_exprs(cat: str, fn: str) -> tuple[str, str]:
    t_arms = " ".join(f"WHEN {q(k)} THEN {q(v[0])}" for k, v in fixed.CATEGORY_MAP.items())
    s_arms = " ".join(f"WHEN {q(k)} THEN {q(v[1])}" for k, v in fixed.CATEGORY_MAP.items())
    is_doc = " OR ".join(f"ends_with({fn}, {q(e)})" for e in fixed.SENSITIVE_DOC_EXTENSIONS)
    is_img = " OR ".join(f"ends_with({fn}, {q(e)})" for e in fixed.CLASSIFIER_IMAGE_EXTENSIONS)
    kw = " OR ".join(f"strpos({fn}, {q(w)}) > 0" for w in fixed.SENSITIVE_KEYWORDS)
    rtype = (f"(CASE WHEN {cat} IS NOT NULL THEN coalesce(CASE {cat} {t_arms} END, 'PUBLIC_EXPECTED') "
             f"WHEN ({is_doc}) AND ({kw}) THEN 'POTENTIAL_SENSITIVE_DOCUMENT' WHEN {is_doc} THEN 'PUBLIC_DOCUMENT' "
             f"WHEN {is_img} THEN 'PUBLIC_IMAGE' ELSE 'PUBLIC_EXPECTED' END)")
    sev = (f"(CASE WHEN {cat} IS NOT NULL THEN coalesce(CASE {cat} {s_arms} END, 'LOW') "
           f"WHEN ({is_doc}) AND ({kw}) THEN 'MEDIUM' WHEN {is_doc} THEN 'LOW' ELSE 'INFORMATIONAL' END)")
    return rtype, sev


_CLS = (candidates_cte(), LINK_URLS, f"""
cls_in AS (SELECT url, lower({path('url')}) AS lp FROM link_urls),
cls AS (SELECT url, lp, {category_expr('lp')} AS category, split_part(lp, '/', -1) AS fn FROM cls_in)""")
_RT, _SV = classification_exprs("category", "fn")
ORACLES["path_category"] = _with_links("SELECT url, category FROM cls", _CLS)
ORACLES["path_index"] = _with_links("SELECT DISTINCT lp AS path, category FROM cls", _CLS)
ORACLES["classify_urls"] = _with_links(f"SELECT url, {_RT} AS resource_type, {_SV} AS severity FROM cls", _CLS)
_DOC = " OR ".join(f"ends_with(fn, {q(e)})" for e in fixed.SENSITIVE_DOC_EXTENSIONS)
_KW = " OR ".join(f"strpos(fn, {q(w)}) > 0" for w in fixed.SENSITIVE_KEYWORDS)
ORACLES["sensitive_documents"] = _with_links(f"SELECT url, ({_KW}) AS has_keyword FROM cls WHERE {_DOC}", _CLS)

ORACLES["scope_filter"] = _with_links("SELECT page_url, pos, url, in_scope, in_scope_with_subdomains FROM links_all")

ORACLES["path_safety"] = _with_links(f"""
SELECT path, NOT (strpos(path, '../') > 0 OR strpos(path, '..\\') > 0 OR starts_with(path, '/')
                  OR starts_with(path, '\\') OR (length(path) > 1 AND substr(path, 2, 1) = ':')
                  OR {" OR ".join(f"strpos(lower(path), {q(s)}) > 0" for s in fixed.UNSAFE_PATH_SUBSTRINGS)}) AS is_safe
FROM (SELECT href AS path FROM links UNION SELECT path FROM (VALUES {", ".join(f"({q(p)})" for p in fixed.candidate_paths())}) v(path))""")

# ------------------------------------------------------------------ secrets on documents
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"""
doc_lines0 AS (SELECT doc_id, regexp_split_to_array(text, {q(LINE_BREAK)}) AS parts,
                      regexp_matches(text, {q('(?:' + LINE_BREAK + ')$')}) AS ends_break, text FROM documents),
doc_lines AS (SELECT doc_id, CASE WHEN text = '' THEN [] WHEN ends_break THEN parts[:-2] ELSE parts END AS lines FROM doc_lines0)"""
_MATCH_ARMS = " UNION ALL ".join(
    f"SELECT doc_id, line_number, {i} AS type_rank, {q(name)} AS secret_type, {pct} AS confidence, "
    f"unnest(regexp_extract_all(line, {q(pat)}, 1)) AS v, "
    f"unnest(generate_series(1, len(regexp_extract_all(line, {q(pat)}, 1)))) AS match_pos FROM dl"
    for i, (name, pat, pct) in enumerate(SECRET_PATTERNS))
_SECRETS = with_ctes(_LINES, f"""
dl AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS line_number FROM doc_lines),
m AS ({_MATCH_ARMS})""", body="")

ORACLES["secret_matches"] = _SECRETS + """
SELECT doc_id, CAST(line_number AS BIGINT) AS line_number, CAST(match_pos AS BIGINT) AS match_pos, secret_type,
       CAST(confidence AS BIGINT) AS confidence FROM m WHERE v <> ''"""
ORACLES["secret_redaction"] = _SECRETS + """
SELECT doc_id, CAST(line_number AS BIGINT) AS line_number, CAST(match_pos AS BIGINT) AS match_pos, secret_type,
       CASE WHEN secret_type = 'PRIVATE_KEY' THEN '***' WHEN length(v) >= 12 THEN substr(v, 1, 4) || '****'
            ELSE '***' END AS redacted_value FROM m WHERE v <> ''"""

_WS = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# ------------------------------------------------------------------ the whole scan
PY_TRIM = (r"^[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+"
           r"|[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+$")


def in_scope_expr(url: str, h: str, bd: str) -> str:
    return f"coalesce(strpos({netloc(url)}, '@') = 0 AND {site(url)} = {h}, false)"


def any_contains(col: str, needles) -> str:
    return "(" + " OR ".join(f"strpos({col}, {q(n)}) > 0" for n in needles) + ")"


def soft404_expr() -> str:
    body = "coalesce(sample, '')"
    head = body
    html_like = any_contains(f"lower({head})", fixed.HTML_MARKERS)
    non_html = f"(ext IN {in_list(fixed.NON_HTML_EXTENSIONS)} OR {any_contains('filename', fixed.NON_HTML_FILENAME_MARKERS)})"
    html_type = "strpos(lower(coalesce(content_type, '')), 'text/html') > 0"
    ws = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    matches = (f"(CASE WHEN starts_with(filename, '.env') OR ext IN {in_list(fixed.ENV_LIKE_EXTENSIONS)} "
               f"THEN regexp_matches({head}, {q(fixed.ENV_LINE_PATTERN)}) "
               f"WHEN ext = '.json' OR ends_with(filename, '.json') THEN regexp_matches({head}, {q('^' + ws + '*[\\[{]')}) "
               f"WHEN ext = '.sql' THEN {any_contains(f'upper({head})', fixed.SQL_MARKERS)} "
               f"WHEN ext IN {in_list(fixed.KEY_EXTENSIONS)} THEN strpos({head}, {q(fixed.KEY_MARKER)}) > 0 "
               f"WHEN ext = '.log' THEN regexp_matches({head}, {q(fixed.LOG_LINE_PATTERN)}) ELSE false END)")
    return (f"(CASE WHEN {body} <> '' AND {html_like} AND {non_html} THEN true "
            f"WHEN {body} <> '' AND NOT {html_like} AND {matches} THEN false "
            f"WHEN NOT ({html_type}) THEN false WHEN {non_html} THEN true ELSE coalesce(catch_all, false) END)")


def lines_expr(text: str) -> str:
    parts = f"regexp_split_to_array({text}, {q(LINE_BREAK)})"
    return (f"(CASE WHEN {text} IS NULL OR {text} = '' THEN CAST([] AS VARCHAR[]) "
            f"WHEN regexp_matches({text}, {q('(?:' + LINE_BREAK + ')$')}) THEN {parts}[:-2] ELSE {parts} END)")


def snippet_expr(text: str) -> str:
    lines = lines_expr(f"regexp_replace({text}, {q(KEY_BLOCK)}, '[REDACTED PRIVATE KEY]', 'g')")
    n = fixed.SNIPPET_MAX_LINES
    line = "l"
    for pattern, _ in LINE_MASKS:
        line = f"regexp_replace({line}, {q(pattern)}, '\\1[REDACTED]', 'g')"
    line = f"regexp_replace({line}, {q(fixed.SNIPPET_SECRET_KEY_PATTERN)}, '\\1\\2[REDACTED]', 'g')"
    return (f"(regexp_replace(array_to_string(list_transform({lines}[1:{n}], lambda l: {line}), chr(10)), '^{_WS}+|{_WS}+$', '', 'g') "
            f"|| CASE WHEN len({lines}) > {n} THEN chr(10) || '... (' || CAST(len({lines}) - {n} AS VARCHAR) "
            f"|| ' more lines)' ELSE '' END)")


ORACLES["redacted_snippet"] = f"SELECT doc_id, {snippet_expr('text')} AS snippet FROM documents"


def case_map(col: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"coalesce(CASE {col} {arms} END, {q(default)})"


def analysis_ctes(src: str, p: str, calibration: bool) -> str:
    """Resource verdict CTEs over ``src`` (normalized_url, hostname, url, source, context), named
    with prefix ``p``; without calibration the catch-all flag is false."""
    rt, sv = classification_exprs("category", "filename_c")
    text = f"""pick AS (SELECT * EXCLUDE (rn) FROM (
  SELECT u.url AS r_url, u.normalized_url AS r_key, u.hostname AS r_host, u.context AS r_context, k.*,
         row_number() OVER (PARTITION BY u.url, u.normalized_url, u.hostname, u.context
           ORDER BY k.url <> u.url, coalesce(k.status_code, 0) <> 200, -coalesce(k.seen, 0), k.url, -k.captured_at) AS rn
  FROM urls u JOIN kc k ON k.key = u.normalized_url) WHERE rn = 1),
a0 AS (SELECT u.*, k.status_code, k.content_type, k.content_length, k.server, k.location, k.is_current AS k_current,
              {SAMPLE.replace('status_code', 'k.status_code').replace('content_type', 'k.content_type').replace('body', 'k.body')} AS sample,
              {path('u.url')} AS path FROM urls u LEFT JOIN pick k ON k.r_url = u.url AND k.r_key = u.normalized_url
              AND k.r_host = u.hostname AND k.r_context IS NOT DISTINCT FROM u.context),
a1 AS (SELECT a0.*, {category_expr('lower(path)')} AS category, split_part(lower(path), '/', -1) AS filename_c,
              {extension('path')} AS ext, lower(split_part(path, '/', -1)) AS filename, status_code IS NOT NULL AS has_response,
              c.catch_all FROM a0 LEFT JOIN catch c USING (hostname)),
a2 AS (SELECT *, {rt} AS class_type, {sv} AS class_severity,
              coalesce(status_code = 200 AND strpos(lower(coalesce(content_type, '')), 'text/html') > 0
                       AND {any_contains("lower(coalesce(sample, ''))", fixed.LISTING_INDICATORS)}, false) AS is_directory_listing,
              coalesce(status_code = 200 AND {soft404_expr()}, false) AS soft_404 FROM a1),
a3 AS (SELECT *, coalesce(status_code = 200 AND NOT soft_404, false) AS is_accessible FROM a2),
analyzed AS (SELECT *,
  CASE WHEN has_response AND soft_404 THEN 'FALSE_POSITIVE' WHEN has_response AND is_directory_listing THEN 'DIRECTORY_LISTING'
       ELSE class_type END AS resource_type,
  CASE WHEN has_response AND soft_404 THEN 'INFORMATIONAL'
       WHEN has_response AND class_type IN ('SOURCE_CONTROL_EXPOSURE', 'DATABASE_EXPOSURE') AND is_accessible
            AND class_severity <> 'CRITICAL' THEN 'CRITICAL'
       WHEN has_response AND is_directory_listing THEN 'MEDIUM' ELSE class_severity END AS severity,
  CASE WHEN has_response AND soft_404 THEN {q(fixed.SOFT_404_DESCRIPTION)}
       WHEN has_response AND is_directory_listing THEN {q(fixed.LISTING_DESCRIPTION)} END AS description,
  CASE WHEN has_response AND soft_404 THEN 'Soft-404 detected at ' || url || ': status 200 with content-type ' || coalesce(content_type, 'None')
       WHEN has_response AND is_directory_listing THEN 'Directory listing detected at ' || url END AS analysis_note,
  coalesce(k_current, true) AS is_current FROM a3),
"""
    text = text.replace("FROM urls u", f"FROM {src} u").replace("JOIN pick k", f"JOIN {p}pick k").replace("pick AS (", f"{p}pick AS (")
    if not calibration:
        text = text.replace("c.catch_all FROM a0 LEFT JOIN catch c USING (hostname)", "false AS catch_all FROM a0")
    for name in ["analyzed", "a0", "a1", "a2", "a3"]:
        text = text.replace(f"{name} AS (", f"{p}{name} AS (").replace(f"FROM {name}", f"FROM {p}{name}")
        text = text.replace(f"{name}.*", f"{p}{name}.*")
    return text


def scan_ctes() -> str:
    rt, sv = classification_exprs("category", "filename_c")
    matrix = " ".join(f"WHEN resource_type = {q(t)} AND has_secrets = {str(s).lower()} AND is_accessible = {str(a).lower()} "
                      f"THEN {q(sev)}" for t, s, a, sev in fixed.RISK_MATRIX)
    sens = any_contains("lower(coalesce(path, ''))", fixed.SENSITIVE_PATH_WORDS)
    gate_types = any_contains("lower(content_type)", fixed.SECRET_SCAN_TYPES)
    match_arms = " UNION ALL ".join(
        f"SELECT normalized_url, line_number, {i} AS type_rank, {q(name)} AS secret_type, {pct} AS confidence, "
        f"unnest(regexp_extract_all(line, {q(pat)}, 1)) AS v, "
        f"unnest(generate_series(1, len(regexp_extract_all(line, {q(pat)}, 1)))) AS match_pos FROM sl"
        for i, (name, pat, pct) in enumerate(SECRET_PATTERNS))
    title = case_map("resource_type", fixed.FINDING_TITLES, fixed.FINDING_TITLE_DEFAULT)
    desc = case_map("resource_type", fixed.FINDING_DESCRIPTIONS, fixed.FINDING_DESCRIPTION_DEFAULT)
    remed = case_map("resource_type", fixed.FINDING_REMEDIATIONS, fixed.FINDING_REMEDIATION_DEFAULT)
    return f"""
roots AS (SELECT {site('url')} AS hostname, {scheme('url')} AS sch, {path('url')} AS path, coalesce(body, '') AS body, captured_at,
                 shown_at FROM shown WHERE status_code = 200 AND {query('url')} = '' AND {path('url')} IN ('/robots.txt', '/sitemap.xml')),
newest AS (SELECT * FROM (
  SELECT t.*, r.path, r.body, row_number() OVER (PARTITION BY t.hostname, r.path ORDER BY r.sch <> t.scheme, r.shown_at DESC, r.captured_at DESC) AS rn
  FROM targets t JOIN roots r USING (hostname)) WHERE rn = 1),
rb AS (SELECT hostname, base_domain, base_url, body FROM newest WHERE path = '/robots.txt'),
rb_lines AS (SELECT hostname, base_url, unnest(string_split(coalesce(body, ''), chr(10))) AS line,
                    unnest(generate_series(1, len(string_split(coalesce(body, ''), chr(10))))) AS line_no FROM rb),
rb_t AS (SELECT hostname, base_url, line_no, regexp_replace(line, {q(PY_TRIM)}, '', 'g') AS l FROM rb_lines),
rb_v AS (SELECT hostname, base_url, line_no, regexp_replace(regexp_extract(l, '(?s)^[^:]*:(.*)$', 1), {q(PY_TRIM)}, '', 'g') AS value
         FROM rb_t WHERE starts_with(l, 'Disallow:') OR starts_with(l, 'Allow:') OR starts_with(l, 'Sitemap:')),
rb_ok AS (SELECT * FROM rb_v WHERE value <> '' AND value <> '/'),
rb_res AS ({resolved_select('rb_ok', 'base_url', 'value', 'hostname, line_no, value')}),
robots AS (SELECT hostname, CAST(line_no AS BIGINT) AS line_no, value, url, {normalized('url')} AS normalized_url,
                  {in_scope_expr('url', 'hostname', '')} AS in_scope FROM rb_res),
sm AS (SELECT hostname, body FROM newest WHERE path = '/sitemap.xml'),
sm_m AS (
  SELECT hostname, 0 AS kind, unnest(regexp_extract_all(body, '(?is)<loc\\b[^>]*>(.*?)</loc\\s*>', 1)) AS v,
         unnest(generate_series(1, len(regexp_extract_all(body, '(?is)<loc\\b[^>]*>(.*?)</loc\\s*>', 1)))) AS pos FROM sm
  UNION ALL
  SELECT hostname, 1 AS kind, unnest(regexp_extract_all(body, '(?is)<sitemap\\b[^>]*>.*?<loc\\b[^>]*>(.*?)</loc\\s*>', 1)) AS v,
         unnest(generate_series(1, len(regexp_extract_all(body, '(?is)<sitemap\\b[^>]*>.*?<loc\\b[^>]*>(.*?)</loc\\s*>', 1)))) AS pos FROM sm),
sm_u AS (SELECT hostname, kind, pos, regexp_replace({decode('v')}, {q(PY_TRIM)}, '', 'g') AS url FROM sm_m, ents),
sitemap AS (SELECT hostname, CAST(kind AS BIGINT) AS kind, CAST(pos AS BIGINT) AS pos, url, {normalized('url')} AS normalized_url,
                   CASE WHEN kind = 1 THEN 'sitemap_index' END AS context, {in_scope_expr('url', 'hostname', '')} AS in_scope
            FROM sm_u WHERE url <> ''),
known AS (
  SELECT {site('url')} AS hostname, 'HTML' AS source, CAST(NULL AS VARCHAR) AS context, 0 AS k1, url AS parent, -1 AS k2, 0 AS k3,
         url, {normalized('url')} AS normalized_url FROM captures WHERE status_code = 200
  UNION ALL SELECT {site('page_url')}, 'HTML', context, 0, page_url, tag_rank, pos, url, normalized_url FROM links WHERE in_scope
  UNION ALL SELECT hostname, 'ROBOTS', NULL, 1, '', 0, line_no, url, normalized_url FROM robots WHERE in_scope
  UNION ALL SELECT hostname, 'SITEMAP', context, 2, '', kind, pos, url, normalized_url FROM sitemap WHERE in_scope),
cand_k AS (SELECT hostname, rank, path, url, {normalized('url')} AS normalized_url FROM cand_all),
every AS (
  SELECT * FROM known UNION ALL SELECT hostname, 'COMMON_PATHS', path, 3, '', 0, rank, url, normalized_url FROM cand_k),
firsts AS (SELECT normalized_url, hostname, url, source, context, k3 FROM (
  SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY k1, parent, k2, k3, url, source,
                                 context NULLS FIRST, hostname) AS rn FROM every) WHERE rn = 1),
urls AS (SELECT normalized_url, hostname, url, source, context FROM firsts),
discovered AS (SELECT hostname, source, context, k3, url, normalized_url FROM known
               UNION ALL SELECT hostname, source, context, k3, url, normalized_url FROM firsts WHERE source = 'COMMON_PATHS'),
kc AS (SELECT * EXCLUDE (is_current, shown_at, shown_current), {normalized('url')} AS key,
              CASE WHEN status_code = 200 THEN shown_at ELSE captured_at END AS seen,
              CASE WHEN status_code = 200 THEN shown_current ELSE is_current END AS is_current FROM shown),
catch AS (SELECT {site('url')} AS hostname, bool_or(status_code = 200) AS catch_all FROM captures
          WHERE regexp_matches({path('url')}, {q(fixed.CALIBRATION_PATTERN)}) GROUP BY 1),
{analysis_ctes('urls', '', True)}gated AS (SELECT normalized_url, sample FROM analyzed
          WHERE is_accessible AND content_type IS NOT NULL AND {gate_types} AND coalesce(content_length, 1) <> 0
                AND sample IS NOT NULL AND sample <> ''),
sl0 AS (SELECT normalized_url, {lines_expr('sample')} AS lines FROM gated),
sl AS (SELECT normalized_url, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS line_number FROM sl0),
sm_all AS ({match_arms}),
secrets AS (SELECT normalized_url, line_number, match_pos, type_rank, secret_type, confidence,
                   CASE WHEN secret_type = 'PRIVATE_KEY' THEN '***' WHEN length(v) >= 12 THEN substr(v, 1, 4) || '****'
                        ELSE '***' END AS redacted_value FROM sm_all WHERE v <> ''),
rollup AS (SELECT normalized_url, CAST(count(*) AS BIGINT) AS secret_count,
                  bool_or(secret_type IN {in_list(fixed.CRITICAL_SECRET_TYPES)}) AS has_critical_secret,
                  string_agg('  - ' || secret_type || ': ' || redacted_value || ' (confidence: ' || CAST(confidence AS VARCHAR) || '%)',
                             chr(10) ORDER BY line_number, match_pos, type_rank) AS secret_lines
           FROM secrets GROUP BY normalized_url),
r0 AS (SELECT a.*, coalesce(r.secret_count, 0) AS secret_count, coalesce(r.has_critical_secret, false) AS has_critical_secret,
              r.secret_lines FROM analyzed a LEFT JOIN rollup r USING (normalized_url)),
r1 AS (SELECT *, coalesce(CASE {matrix} END, 'INFORMATIONAL') AS base_severity
       FROM (SELECT *, secret_count > 0 AS has_secrets FROM r0)),
r2 AS (SELECT *, CASE WHEN is_current AND s0 = 'LOW' THEN 'MEDIUM' ELSE s0 END AS s1
       FROM (SELECT *, CASE WHEN has_critical_secret THEN 'CRITICAL' ELSE base_severity END AS s0 FROM r1)),
resources AS (SELECT *, CASE WHEN {sens} AND s1 = 'INFORMATIONAL' THEN 'LOW' WHEN {sens} AND s1 = 'LOW' THEN 'MEDIUM'
                              ELSE s1 END AS assessed_severity FROM r2),
findings AS (SELECT *, assessed_severity AS finding_severity,
  {title} || CASE WHEN secret_count > 0 THEN ' (Contains ' || CAST(secret_count AS VARCHAR) || ' Potential Secret'
                  || CASE WHEN secret_count > 1 THEN 's' ELSE '' END || ')' ELSE '' END AS title,
  {desc} || CASE WHEN NOT is_current THEN {q(fixed.STATUS_HISTORICAL)} WHEN is_accessible THEN {q(fixed.STATUS_ACCESSIBLE)}
                 ELSE {q(fixed.STATUS_NOT_ACCESSIBLE)} END AS finding_description,
  {remed} AS remediation,
  concat_ws(chr(10), 'URL: ' || url, 'Discovery Source: ' || source,
    CASE WHEN has_response THEN 'HTTP Status: ' || CAST(status_code AS VARCHAR) END,
    CASE WHEN has_response AND content_type IS NOT NULL AND content_type <> '' THEN 'Content-Type: ' || content_type END,
    CASE WHEN has_response AND server IS NOT NULL AND server <> '' THEN 'Server: ' || server END,
    CASE WHEN secret_count > 0 THEN chr(10) || 'Secrets Detected:' || chr(10) || secret_lines END,
    CASE WHEN has_response AND is_directory_listing THEN 'Directory listing is ENABLED on this resource' END,
    CASE WHEN is_accessible AND has_response AND sample IS NOT NULL AND sample <> '' AND {snippet_expr('sample')} <> ''
         THEN chr(10) || 'Verified Content (redacted):' || chr(10) || {snippet_expr('sample')} END) AS evidence
  FROM resources WHERE severity <> 'INFORMATIONAL'),
grp AS (SELECT hostname, normalized_url, url, g AS group_name FROM (
  SELECT hostname, normalized_url, url, unnest([CASE {" ".join(f"WHEN resource_type IN {in_list(t)} THEN {q(n)}" for n, t in fixed.RESOURCE_GROUPS)} END,
                                               CASE WHEN NOT is_current THEN 'historical' END,
                                               CASE WHEN NOT is_accessible THEN 'not_accessible' END]) AS g FROM resources) WHERE g IS NOT NULL)"""


def _scan_sql(body: str) -> str:
    return with_ctes(captures_cte(), *links_ctes(), candidates_cte(), scan_ctes(), body=body)


ORACLES["robots_urls"] = _scan_sql("SELECT * FROM robots")
ORACLES["sitemap_urls"] = _scan_sql("SELECT * FROM sitemap")
ORACLES["dedup_urls"] = _scan_sql("SELECT * FROM urls")
ORACLES["union_sources"] = _scan_sql("""SELECT hostname, source, CAST(count(*) AS BIGINT) AS rows,
  CAST(count(DISTINCT normalized_url) AS BIGINT) AS distinct_urls FROM discovered GROUP BY hostname, source""")
ORACLES["candidate_urls"] = _scan_sql("""SELECT hostname, CAST(k3 AS BIGINT) AS rank, context AS path, url, normalized_url
  FROM discovered WHERE source = 'COMMON_PATHS'""")
_GATE = any_contains("lower(content_type)", fixed.SECRET_SCAN_TYPES)
ORACLES["secret_scan_gate"] = _scan_sql(f"""SELECT normalized_url, coalesce(is_accessible AND content_type IS NOT NULL AND
  {_GATE} AND coalesce(content_length, 1) <> 0, false) AS scan
  FROM analyzed WHERE has_response""")
ORACLES["soft_404"] = _scan_sql("SELECT normalized_url, ext, filename, catch_all, soft_404 FROM analyzed WHERE status_code = 200")
ORACLES["analyze_resources"] = _scan_sql("""SELECT normalized_url, hostname, source, CAST(status_code AS BIGINT) AS status_code,
  category, resource_type, severity, is_accessible, is_directory_listing, description, analysis_note FROM analyzed""")
ORACLES["resource_secrets"] = _scan_sql("SELECT normalized_url, secret_count, has_critical_secret FROM resources WHERE secret_count > 0")
ORACLES["risk_lookup"] = _scan_sql("SELECT normalized_url, resource_type, has_secrets, is_accessible, base_severity FROM resources")
ORACLES["secret_severity"] = _scan_sql("""SELECT normalized_url, has_critical_secret, base_severity, assessed_severity
  FROM resources WHERE secret_count > 0""")
ORACLES["assess_risk"] = _scan_sql("SELECT normalized_url, assessed_severity FROM resources")
ORACLES["risk_modifiers"] = _scan_sql("SELECT normalized_url, is_current, base_severity, assessed_severity FROM resources")
ORACLES["findings"] = _scan_sql("SELECT normalized_url, hostname, resource_type, severity, finding_severity FROM findings")
ORACLES["finding_text"] = _scan_sql("SELECT normalized_url, title, finding_description AS description, remediation FROM findings")
ORACLES["finding_evidence"] = _scan_sql("SELECT normalized_url, evidence FROM findings")
ORACLES["resource_groups"] = _scan_sql("SELECT normalized_url, hostname, group_name FROM grp")
ORACLES["group_counts"] = _scan_sql("SELECT hostname, group_name, CAST(count(*) AS BIGINT) AS resources FROM grp GROUP BY 1, 2")
ORACLES["report_url_list"] = _scan_sql("""SELECT hostname, CASE WHEN status_code IS NOT NULL THEN '[' || CAST(status_code AS VARCHAR) || '] '
  ELSE '[UNKNOWN] ' END || url AS line FROM resources""")
ORACLES["secret_summary"] = _scan_sql("""SELECT hostname, CAST(sum(secret_count) AS BIGINT) AS total_secrets_found,
  CAST(count(*) FILTER (WHERE secret_count > 0) AS BIGINT) AS resources_with_secrets FROM resources GROUP BY hostname""")
ORACLES["sensitive_file_count"] = _scan_sql(f"""SELECT hostname, CAST(count(*) FILTER (WHERE resource_type IN {in_list(fixed.SENSITIVE_FILE_TYPES)}) AS BIGINT)
  AS potential_sensitive_files FROM resources GROUP BY hostname""")
_FC = file_category_expr("path")
ORACLES["scan_statistics"] = _scan_sql(f"""
SELECT coalesce(d.hostname, r.hostname) AS hostname, coalesce(d.n, 0) AS urls_discovered,
       coalesce(r.urls_checked, 0) AS urls_checked, coalesce(r.currently_accessible, 0) AS currently_accessible,
       coalesce(r.documents, 0) AS documents, coalesce(r.images, 0) AS images, coalesce(r.data_files, 0) AS data_files
FROM (SELECT hostname, CAST(count(*) AS BIGINT) AS n FROM discovered GROUP BY hostname) d
FULL JOIN (SELECT hostname, CAST(count(*) AS BIGINT) AS urls_checked,
                  CAST(count(*) FILTER (WHERE status_code = 200) AS BIGINT) AS currently_accessible,
                  CAST(count(*) FILTER (WHERE status_code = 200 AND {_FC} = 'document') AS BIGINT) AS documents,
                  CAST(count(*) FILTER (WHERE status_code = 200 AND {_FC} = 'image') AS BIGINT) AS images,
                  CAST(count(*) FILTER (WHERE status_code = 200 AND {_FC} = 'data') AS BIGINT) AS data_files
           FROM resources GROUP BY hostname) r ON d.hostname = r.hostname""")
ORACLES["severity_counts"] = _scan_sql("""
SELECT r.hostname, coalesce(f.critical_count, 0) AS critical_count, coalesce(f.high_count, 0) AS high_count,
       coalesce(f.medium_count, 0) AS medium_count, coalesce(f.low_count, 0) AS low_count,
       coalesce(f.info_findings, 0) + r.info_resources AS info_count
FROM (SELECT hostname, CAST(count(*) FILTER (WHERE severity = 'INFORMATIONAL') AS BIGINT) AS info_resources
      FROM resources GROUP BY hostname) r
LEFT JOIN (SELECT hostname,
             CAST(count(*) FILTER (WHERE finding_severity = 'CRITICAL') AS BIGINT) AS critical_count,
             CAST(count(*) FILTER (WHERE finding_severity = 'HIGH') AS BIGINT) AS high_count,
             CAST(count(*) FILTER (WHERE finding_severity = 'MEDIUM') AS BIGINT) AS medium_count,
             CAST(count(*) FILTER (WHERE finding_severity = 'LOW') AS BIGINT) AS low_count,
             CAST(count(*) FILTER (WHERE finding_severity = 'INFORMATIONAL') AS BIGINT) AS info_findings
           FROM findings GROUP BY hostname) f ON r.hostname = f.hostname""")
ORACLES["top_findings"] = _scan_sql(f"""
SELECT hostname, finding_severity, CAST(rank AS BIGINT) AS rank, url, title, CAST(greatest(total - {fixed.TOP_FINDINGS}, 0) AS BIGINT) AS more
FROM (SELECT hostname, finding_severity, url, title,
             row_number() OVER (PARTITION BY hostname, finding_severity ORDER BY normalized_url) AS rank,
             count(*) OVER (PARTITION BY hostname, finding_severity) AS total
      FROM findings WHERE finding_severity IN ('CRITICAL', 'HIGH')) WHERE rank <= {fixed.TOP_FINDINGS}""")
ORACLES["top_resources"] = _scan_sql(f"""
SELECT hostname, group_name, CAST(rank AS BIGINT) AS rank, url, CAST(greatest(total - {fixed.TOP_RESOURCES}, 0) AS BIGINT) AS more
FROM (SELECT hostname, group_name, url,
             row_number() OVER (PARTITION BY hostname, group_name ORDER BY normalized_url) AS rank,
             count(*) OVER (PARTITION BY hostname, group_name) AS total
      FROM grp WHERE group_name IN ('documents', 'images')) WHERE rank <= {fixed.TOP_RESOURCES}""")
ORACLES["historical_urls"] = _scan_sql(f"""
SELECT hostname, CAST(rank AS BIGINT) AS rank, url, CAST(total AS BIGINT) AS total
FROM (SELECT hostname, url, row_number() OVER (PARTITION BY hostname ORDER BY normalized_url) AS rank,
             count(*) OVER (PARTITION BY hostname) AS total FROM resources WHERE NOT is_current) WHERE rank <= {fixed.TOP_RESOURCES}""")
_SEV_RANK = " ".join(f"WHEN {q(s)} THEN {i}" for i, s in enumerate(fixed.SEVERITIES))
ORACLES["findings_by_severity"] = _scan_sql(f"""
SELECT hostname, finding_severity, CAST(CASE finding_severity {_SEV_RANK} END AS BIGINT) AS severity_rank, url, title
FROM findings WHERE finding_severity <> 'INFORMATIONAL'""")

ORACLES["path_exposure"] = with_ctes(
    captures_cte(), *links_ctes(), candidates_cte(), scan_ctes(),
    "pe_src AS (SELECT cand_k.normalized_url, hostname, url, 'COMMON_PATHS' AS source, path AS context FROM cand_k)",
    analysis_ctes("pe_src", "pe_", False),
    body="""SELECT normalized_url, hostname, resource_type, severity, is_accessible FROM pe_analyzed
            WHERE resource_type <> 'PUBLIC_EXPECTED'""")

_STRIP_ALL = ("regexp_replace(regexp_replace(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), "
              "'(?is)(<script\\b[^>]*>).*?</script\\s*>', '\\1', 'g'), '(?is)(<style\\b[^>]*>).*?</style\\s*>', '\\1', 'g')")
_A_TAG = TAG_RE
ORACLES["valid_links"] = with_ctes(captures_cte(), f"""
raw AS (SELECT unnest(regexp_extract_all({_STRIP_ALL}, {q(_A_TAG)})) AS tag FROM captures WHERE status_code = 200),
vals AS (SELECT {attribute('tag', 'href')} AS v FROM raw WHERE regexp_matches(tag, '^<[aA][\\s/]')),
hrefs AS (SELECT {decode('v')} AS href FROM vals, ents)""", body=f"""
SELECT href, CAST(count(*) AS BIGINT) AS occurrences, coalesce(NOT regexp_matches(href, {q(_INVALID)}), false) AS is_valid
FROM hrefs GROUP BY href""")


def _block_links(tag: str, media: str, patterns: list, groups: list, valid_filter: bool) -> str:
    arms = " UNION ALL ".join(
        f"SELECT page_url, block, {i} AS pattern, unnest(regexp_extract_all(text, {q(pat)}, {g})) AS v, "
        f"unnest(generate_series(1, len(regexp_extract_all(text, {q(pat)}, {g})))) AS pos FROM blk"
        for i, (pat, g) in enumerate(zip(patterns, groups)))
    blk_re = f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>"
    href = "regexp_replace(v, '^[''\"()]+|[''\"()]+$', '', 'g')" if tag == "script" else "v"
    cond = (f"NOT regexp_matches(href, {q(_INVALID)})" if valid_filter
            else "href <> '' AND NOT starts_with(href, 'data:')")
    return with_ctes(captures_cte(), f"""
bodies AS (SELECT url AS page_url, CASE WHEN strpos(lower(coalesce(content_type, '')), '{media}') > 0 THEN [coalesce(body, '')]
             ELSE regexp_extract_all(regexp_replace(coalesce(body, ''), '(?s)<!--.*?-->', '', 'g'), '{blk_re}', 1) END AS b
           FROM captures WHERE status_code = 200),
blk AS (SELECT page_url, unnest(b) AS text, unnest(generate_series(0, len(b) - 1)) AS block FROM bodies),
m AS ({arms}),
hv AS (SELECT page_url, block, pattern, pos, {href} AS href FROM m WHERE {cond}),
res AS ({resolved_select('hv', 'page_url', 'href', 'page_url, block, pattern, pos, href')})""", body=f"""
SELECT page_url, CAST(block AS BIGINT) AS block, CAST(pattern AS BIGINT) AS pattern, CAST(pos AS BIGINT) AS pos, href, url,
       {in_scope_expr('url', site('page_url'), '')} AS in_scope FROM res""")


ORACLES["js_links"] = _block_links("script", "javascript", fixed.JS_PATTERNS, [0, 0, 1], True)
ORACLES["css_links"] = _block_links("style", "css", fixed.CSS_PATTERNS, [1, 1], False)


# ------------------------------------------------------------------ crawl
#: Deeper than any chain of the test data; the recursion needs an end because its rows carry the depth.
CRAWL_LEVELS = 60


def _crawl_sql(seeded: bool, body: str) -> str:
    """Reachability as a recursive query: (host, key, depth) by UNION, then the least depth."""
    ok = f"k.status_code = 200 AND {IS_HTML.replace('content_type', 'k.content_type')}"
    seeds = (f"UNION ALL SELECT {site('url')}, url FROM captures WHERE status_code = 200 AND {IS_HTML}" if seeded else "")
    ctes = f"""
ks AS (SELECT nk, status_code, content_type FROM (
  SELECT *, {normalized('url')} AS nk, row_number() OVER (PARTITION BY {normalized('url')}
         ORDER BY coalesce(status_code, 0) <> 200, -(CASE WHEN status_code = 200 THEN shown_at ELSE coalesce(captured_at, 0) END), url,
                  -captured_at, content_type NULLS FIRST) AS rn
  FROM shown) WHERE rn = 1),
edges AS (SELECT {normalized('page_url')} AS page_key, url AS link_url, normalized_url AS link_key,
                 {should_crawl_expr(path("url"))} AS crawlable, tag_rank, pos FROM links WHERE in_scope),
steps AS (SELECT DISTINCT page_key, link_key FROM edges JOIN ks k ON k.nk = page_key WHERE crawlable AND {ok}),
start AS (SELECT hostname, url, {normalized('url')} AS key FROM (SELECT hostname, base_url AS url FROM targets {seeds})),
reach(hostname, key, depth) AS (
  SELECT DISTINCT hostname, key, 0 FROM start
  UNION SELECT r.hostname, s.link_key, r.depth + 1 FROM reach r JOIN steps s ON s.page_key = r.key WHERE r.depth < {CRAWL_LEVELS}),
level AS (SELECT hostname, key, min(depth) AS depth FROM reach GROUP BY 1, 2),
page AS (SELECT l.*, {IS_HTML.replace('content_type', 'k.content_type')} AS html FROM level l JOIN ks k ON k.nk = l.key AND k.status_code = 200),
found AS (SELECT p.hostname, e.link_key AS key, p.depth + 1 AS depth, min(e.link_url) AS url
          FROM page p JOIN edges e ON e.page_key = p.key WHERE p.html GROUP BY 1, 2, 3),
link AS (SELECT hostname, key, depth, url FROM (
  SELECT *, row_number() OVER (PARTITION BY hostname, key ORDER BY depth) AS rn FROM found) WHERE rn = 1),
degree AS (SELECT page_key, count(*) AS n FROM edges GROUP BY 1),
named AS (SELECT p.hostname, p.key, p.depth, p.html, CASE WHEN p.html THEN coalesce(d.n, 0) ELSE 0 END AS links,
                 coalesce(f.url, s.url) AS url
          FROM page p LEFT JOIN degree d ON d.page_key = p.key
          LEFT JOIN (SELECT hostname, key, min(url) AS url FROM start GROUP BY 1, 2) s ON s.hostname = p.hostname AND s.key = p.key AND p.depth = 0
          LEFT JOIN found f ON f.hostname = p.hostname AND f.key = p.key AND f.depth = p.depth),
crawl AS (SELECT hostname, url, key, depth, 'page' AS kind, links FROM named
          UNION ALL SELECT hostname, url, key, depth, 'file', 0 FROM named WHERE NOT html
          UNION ALL SELECT hostname, url, key, depth, 'link', 0 FROM link)"""
    return with_ctes(captures_cte(), *links_ctes(), ctes, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


_REACH = "SELECT hostname, url, key AS normalized_url, CAST(depth AS BIGINT) AS depth, kind FROM crawl"
ORACLES["crawl_reachability"] = _crawl_sql(False, _REACH)
ORACLES["seed_reachability"] = _crawl_sql(True, _REACH)
ORACLES["crawl_statistics"] = _crawl_sql(True, """
SELECT hostname, CAST(count(*) FILTER (WHERE kind = 'page') AS BIGINT) AS pages_crawled, CAST(sum(links) AS BIGINT) AS total_urls_found,
       CAST(count(*) FILTER (WHERE kind = 'link') AS BIGINT) AS unique_urls_found FROM crawl GROUP BY hostname""")


def _budget_sql(max_pages: int, max_depth: int) -> str:
    """The seeded crawl with a page budget, its levels written out: each level's URLs in the order of the queue."""
    full = _crawl_sql(True, "")
    head = full[:full.index("start AS (")]
    ok = IS_HTML.replace('content_type', 'k.content_type')
    ctes = [f"""start AS (SELECT hostname, url, {normalized('url')} AS key, pr FROM (SELECT hostname, base_url AS url, 0 AS pr FROM targets
      UNION ALL SELECT {site('url')}, url, 1 FROM captures WHERE status_code = 200 AND {IS_HTML})),
found0 AS (SELECT hostname, url, key, pr, 0 AS tr, 0 AS ps, true AS crawlable FROM start)"""]
    for d in range(max_depth + 1):
        seen = "".join(f" AND (hostname, key) NOT IN (SELECT (hostname, key) FROM level{e})" for e in range(d))
        taken = " + ".join(["0"] + [f"(SELECT count(*) FROM page{e} WHERE page{e}.hostname = ok{d}.hostname)" for e in range(d)])
        ctes.append(f"""
level{d} AS (SELECT hostname, key, min(url) AS url, min({{'a': pr, 'b': tr, 'c': ps, 'd': url}}) AS o FROM found{d} WHERE crawlable{seen} GROUP BY 1, 2),
ok{d} AS (SELECT l.*, {ok} AS html, row_number() OVER (PARTITION BY hostname ORDER BY o) AS rank FROM level{d} l
          JOIN ks k ON k.nk = l.key AND k.status_code = 200),
page{d} AS (SELECT * FROM ok{d} WHERE rank <= {max_pages} - ({taken})),
found{d + 1} AS (SELECT p.hostname, e.link_url AS url, e.link_key AS key, p.rank AS pr, e.tag_rank AS tr, e.pos AS ps, e.crawlable
                 FROM page{d} p JOIN edges e ON e.page_key = p.key WHERE p.html)""")
    levels = range(max_depth + 1)
    pages = " UNION ALL ".join(f"SELECT hostname, url, key AS normalized_url, {d} AS depth, html FROM page{d}" for d in levels)
    links = " UNION ALL ".join(f"SELECT hostname, url, key, {d + 1} AS depth FROM found{d + 1}" for d in levels)
    return head + ",".join(ctes) + f""", pages_all AS ({pages}), links_all_levels AS ({links}),
links_first AS (SELECT hostname, key, min({{'a': depth, 'b': url}}) AS f FROM links_all_levels GROUP BY 1, 2)
SELECT hostname, url, normalized_url, CAST(depth AS BIGINT) AS depth, 'page' AS kind FROM pages_all
UNION ALL SELECT hostname, url, normalized_url, depth, 'file' FROM pages_all WHERE NOT html
UNION ALL SELECT hostname, f.b, key, f.a, 'link' FROM links_first"""


ORACLES["crawl_budget"] = _budget_sql(3, 3)


# ------------------------------------------------------------------ redirect chains
def _chain_sql(body: str) -> str:
    """Every chain walked hop by hop until it ends or comes back to a key of its way."""
    ctes = f"""
counted AS (SELECT * FROM (
  SELECT *, {normalized('url')} AS key, row_number() OVER (PARTITION BY {normalized('url')}
         ORDER BY coalesce(status_code, 0) <> 200, -coalesce(captured_at, 0), url, status_code NULLS FIRST, location NULLS FIRST) AS rn
  FROM captures) WHERE rn = 1),
rd_in AS (SELECT key, url AS r_url, location FROM counted WHERE status_code IN (301, 302, 303, 307, 308) AND location <> ''),
rd_res AS ({resolved_select('rd_in', 'r_url', 'location', 'key, r_url, location')}),
rd AS (SELECT key, r_url, {host('location')} AS host, url AS to_url, {normalized('url')} AS to_key FROM rd_res),
walk(key, r_url, n, host, to_url, to_key, way) AS (
  SELECT key, r_url, 1, host, to_url, to_key, [key] FROM rd
  UNION ALL SELECT w.key, w.r_url, n + 1, rd.host, rd.to_url, rd.to_key, list_append(way, rd.key)
  FROM walk w JOIN rd ON rd.key = w.to_key WHERE NOT list_contains(way, w.to_key)),
hop AS (SELECT key, r_url, host, min(n) AS first_hop FROM walk WHERE host IS NOT NULL GROUP BY 1, 2, 3),
judged AS (SELECT *, CASE WHEN {is_private('host')} THEN 'blocked_private' WHEN host = {host('r_url')} THEN 'allowed'
                          WHEN ends_with(host, '.' || {base_domain(host('r_url'))}) THEN 'allowed' ELSE 'blocked_domain' END AS verdict FROM hop),
firsts AS (SELECT key, min(first_hop) FILTER (starts_with(verdict, 'blocked')) AS blocked_hop,
                  arg_min(verdict, first_hop) FILTER (starts_with(verdict, 'blocked')) AS blocked FROM judged GROUP BY 1),
ends AS (SELECT *, CASE WHEN list_contains(way, to_key) THEN list_min(way[list_position(way, to_key):]) END AS loop FROM walk
         WHERE list_contains(way, to_key) OR to_key NOT IN (SELECT key FROM rd)),
chains AS (SELECT {site('r_url')} AS hostname, r_url AS url, CASE WHEN loop IS NULL THEN CAST(n AS BIGINT) END AS hops,
                  CASE WHEN loop IS NULL THEN to_url END AS final_url,
                  CASE WHEN loop IS NOT NULL THEN 'loop' WHEN c.status_code IS NOT NULL THEN 'final' ELSE 'unseen' END AS outcome,
                  CASE WHEN loop IS NULL THEN CAST(c.status_code AS BIGINT) END AS final_status, loop,
                  coalesce(f.blocked, CASE WHEN f.key IS NOT NULL THEN 'allowed' ELSE 'relative' END) AS verdict,
                  CAST(f.blocked_hop AS BIGINT) AS blocked_hop
           FROM ends e LEFT JOIN counted c ON c.key = e.to_key LEFT JOIN firsts f ON f.key = e.key)"""
    return with_ctes(captures_cte(), ctes, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES["redirect_chains"] = _chain_sql("SELECT * FROM chains")
ORACLES["redirect_hops"] = _chain_sql(f"""
SELECT {site('r_url')} AS hostname, r_url AS url, host, CAST(first_hop AS BIGINT) AS first_hop, verdict FROM judged""")


# ------------------------------------------------------------------ report
ORACLES["report_json"] = _scan_sql("""
SELECT f.hostname, f.normalized_url, f.finding_severity AS severity, f.title, f.finding_description AS description, f.evidence,
       f.remediation, f.url, f.resource_type, f.is_accessible, CAST(s.pos AS BIGINT) AS secret_pos, s.secret_type,
       s.redacted_value, s.confidence / 100.0 AS confidence
FROM findings f LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY line_number, match_pos, secret_type, redacted_value) - 1 AS pos
  FROM secrets) s ON s.normalized_url = f.normalized_url""")


def _body(name: str) -> str:
    """The final SELECT of a whole-scan oracle, to be joined with others."""
    return ORACLES[name][len(_scan_sql("")):]


ORACLES["report_header"] = _scan_sql(f"""
SELECT t.hostname, t.base_url, t.base_domain, t.scheme, CAST(t.port AS BIGINT) AS port, false AS include_subdomains, c.start_time,
       c.end_time, {", ".join(f"coalesce({x}, 0) AS {x}" for x in (
           "urls_discovered", "urls_checked", "currently_accessible", "historical_urls", "documents", "images", "data_files",
           "potential_sensitive_files", "critical_count", "high_count", "medium_count", "low_count", "info_count",
           "total_secrets_found"))}
FROM targets t
LEFT JOIN ({_body('scan_statistics')}) USING (hostname) LEFT JOIN ({_body('severity_counts')}) USING (hostname)
LEFT JOIN ({_body('sensitive_file_count')}) USING (hostname) LEFT JOIN ({_body('secret_summary')}) USING (hostname)
LEFT JOIN (SELECT hostname, CAST(count(*) FILTER (WHERE NOT is_current) AS BIGINT) AS historical_urls FROM resources GROUP BY 1) USING (hostname)
LEFT JOIN (SELECT {site('url')} AS hostname, min(captured_at) AS start_time, max(captured_at) AS end_time FROM captures GROUP BY 1) c USING (hostname)""")

_STATS = ["urls_discovered", "urls_checked", "currently_accessible", "historical_urls", "documents", "images", "data_files",
          "potential_sensitive_files", "critical_count", "high_count", "medium_count", "low_count", "info_count", "total_secrets_found"]
ORACLES["report_sections"] = _scan_sql(f"""
SELECT hostname, 'statistics' AS section, unnest(generate_series(1, {len(_STATS)})) AS pos, unnest([{", ".join(q(x) for x in _STATS)}]) AS label,
       CAST(NULL AS VARCHAR) AS url, unnest([{", ".join(_STATS)}]) AS value FROM ({_body('report_header')})
UNION ALL SELECT hostname, 'groups', 0, group_name, NULL, resources FROM ({_body('group_counts')})
UNION ALL SELECT hostname, 'top_' || lower(finding_severity), rank, title, url, more FROM ({_body('top_findings')})
UNION ALL SELECT hostname, 'top_' || group_name, rank, NULL, url, more FROM ({_body('top_resources')})
UNION ALL SELECT hostname, 'historical', rank, NULL, url, total FROM ({_body('historical_urls')})""")
