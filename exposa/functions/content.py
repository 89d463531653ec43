"""Response-content columns: sample gate (S2), title (S3), directory listing (F8), secret-scan
gate (F7) and the soft-404 verdict (C5).

All built-in expressions over the whole sample. ``sniff_chars`` and ``max_bytes`` bring back the
scanner's own limits (a head of the body, small responses only); both are off by default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposa.functions import fixed
from exposa.functions.urls import once

# Python's str.strip()/lstrip() whitespace, as a regex class usable by the JVM engine.
PY_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _contains_any(col: Column, needles: list[str]) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | col.contains(n)
    return cond


def py_strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def lower_ct(content_type: Column) -> Column:
    """Lower-cased content type, '' when the header is absent."""
    return F.lower(F.coalesce(content_type, F.lit("")))


def is_textual(content_type: Column) -> Column:
    ct = lower_ct(content_type)
    return _contains_any(ct, fixed.TEXTUAL_CONTENT_TYPES) | (ct == "")


def response_sample(body: Column, status: Column, content_type: Column,
                    sample_chars: int | None) -> Column:
    """Body kept for analysis: status 200 and a textual type; optionally its first
    ``sample_chars`` characters. Null otherwise."""
    kept = body if sample_chars is None else F.substring(body, 1, sample_chars)
    return F.when((status == 200) & is_textual(content_type), F.coalesce(kept, F.lit("")))


def page_title(sample: Column, content_type: Column) -> Column:
    """Text between the first ``<title>`` and the next ``</title>`` (any case) of an HTML
    sample, stripped; null when absent, unclosed or empty."""
    raw = F.regexp_extract(F.coalesce(sample, F.lit("")), r"(?is)<title>(.*?)</title>", 1)
    html = lower_ct(content_type).contains("text/html")
    return F.when(html & (raw != ""), py_strip(raw))


def is_directory_listing(sample: Column, content_type: Column) -> Column:
    html = lower_ct(content_type).contains("text/html")
    return html & once(F.lower(F.coalesce(sample, F.lit(""))), lambda low: _contains_any(low, fixed.LISTING_INDICATORS))


def secret_scan_gate(accessible: Column, content_type: Column, content_length: Column,
                     max_bytes: int | None = None) -> Column:
    """Accessible, of a textual type and not known to be empty."""
    gate = (accessible & content_type.isNotNull() & _contains_any(F.lower(content_type), fixed.SECRET_SCAN_TYPES)
            & (F.coalesce(content_length, F.lit(1)) != 0))
    return gate if max_bytes is None else gate & content_length.isNotNull() & (content_length < max_bytes)


def looks_like_html(head: Column) -> Column:
    return once(F.lower(head), lambda low: _contains_any(low, fixed.HTML_MARKERS))


def implies_non_html(ext: Column, filename: Column) -> Column:
    return ext.isin(fixed.NON_HTML_EXTENSIONS) | _contains_any(filename, fixed.NON_HTML_FILENAME_MARKERS)


HEAD_FLAGS = ["head_nonempty", "head_html", "head_env", "head_json", "head_sql", "head_key", "head_log"]


def head_flags(sample: Column, sniff_chars: int | None = None) -> dict[str, Column]:
    """Everything the soft-404 rules read from a response body, as booleans. Computed where the body
    is read; only these flags travel."""
    head = F.coalesce(sample, F.lit(""))
    if sniff_chars is not None:
        head = F.substring(head, 1, sniff_chars)
    # (?d): only '\n' ends a line, as for the scanner's multi-line anchors.
    return {
        "head_nonempty": head != "",
        "head_html": looks_like_html(head),
        "head_env": head.rlike("(?d)" + fixed.ENV_LINE_PATTERN),
        "head_json": head.rlike(r"^" + PY_SPACE + r"*[\[{]"),
        "head_sql": once(F.upper(head), lambda up: _contains_any(up, fixed.SQL_MARKERS)),
        "head_key": head.contains(fixed.KEY_MARKER),
        "head_log": head.rlike("(?d)" + fixed.LOG_LINE_PATTERN),
    }


def matches_claimed_type(filename: Column, ext: Column, flags: dict[str, Column]) -> Column:
    """The head positively matches the type the file name claims (first rule that applies)."""
    env_like = filename.startswith(".env") | ext.isin(fixed.ENV_LIKE_EXTENSIONS)
    is_json = (ext == ".json") | filename.endswith(".json")
    is_key = ext.isin(fixed.KEY_EXTENSIONS)
    return (F.when(env_like, flags["head_env"])
            .when(is_json, flags["head_json"])
            .when(ext == ".sql", flags["head_sql"])
            .when(is_key, flags["head_key"])
            .when(ext == ".log", flags["head_log"])
            .otherwise(F.lit(False)))


def soft_404_from_flags(flags: dict[str, Column], content_type: Column, ext: Column, filename: Column,
                        catch_all: Column) -> Column:
    """Soft-404 verdict for a 200 response (C5) from the head flags; ``ext`` from the URL path,
    ``filename`` its lower-cased last segment."""
    body = flags["head_nonempty"]
    html_like = flags["head_html"]
    non_html = implies_non_html(ext, filename)
    html_type = lower_ct(content_type).contains("text/html")
    return (F.when(body & html_like & non_html, F.lit(True))
            .when(body & ~html_like & matches_claimed_type(filename, ext, flags), F.lit(False))
            .when(~html_type, F.lit(False))
            .when(non_html, F.lit(True))
            .otherwise(F.coalesce(catch_all, F.lit(False))))


def soft_404(sample: Column, content_type: Column, ext: Column, filename: Column,
             catch_all: Column) -> Column:
    """Soft-404 verdict computed directly from the sample (row-local use, e.g. streaming)."""
    return soft_404_from_flags(head_flags(sample), content_type, ext, filename, catch_all)
