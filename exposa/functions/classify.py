"""Path classification (C1-C4) as one CASE over regex predicates.

Categories are tried in the fixed order, first match wins; ``CASE WHEN`` short-circuits, so a
path classified early never evaluates the framework category. Matching is a case-insensitive
unanchored search on the lower-cased path: the patterns are lower-cased once here, which avoids
the slower case-insensitive mode of the JVM regex engine and gives the same answers for the
ASCII paths these patterns describe.

The framework category (hundreds of patterns) is evaluated as three regexes: the
``NAME.yml|yaml`` names behind a cheap suffix guard, the ``.NAME/`` directories, and the
remaining patterns as one alternation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposa.functions import fixed


def _alt(patterns: list[str]) -> str:
    seen = []
    for p in patterns:
        p = p.lower()
        if p not in seen:
            seen.append(p)
    return "|".join(f"(?:{p})" for p in seen)


def category_regexes() -> dict[str, str]:
    """One lower-case alternation per generic category."""
    return {c: _alt(fixed.PATTERNS[c]) for c in fixed.CATEGORY_ORDER if c != "laravel"}


def _names_alt(names: list[str]) -> str:
    out = []
    for n in names:
        n = n.lower().replace(".", r"\.")
        if n not in out:
            out.append(n)
    return "|".join(out)


def framework_regexes() -> tuple[str, str, str]:
    """(names.yml/.yaml regex, dotted-directory regex, other-pattern regex), lower case."""
    names = _names_alt(fixed.FRAMEWORK_CONFIG_NAMES)
    dirs = _names_alt([n for n in fixed.FRAMEWORK_CONFIG_NAMES
                       if n not in fixed.FRAMEWORK_NAMES_WITHOUT_DIRECTORY])
    return (rf"(?:{names})\.ya?ml$", rf"\.(?:{dirs})/", _alt(fixed.FRAMEWORK_OTHER_PATTERNS))


def framework_match(lpath: Column) -> Column:
    yml, dirs, other = framework_regexes()
    yml_guard = lpath.endswith(".yml") | lpath.endswith(".yaml")
    return (yml_guard & lpath.rlike(yml)) | lpath.rlike(dirs) | lpath.rlike(other)


def path_category(lpath: Column) -> Column:
    """First matching category of a lower-cased path, or null."""
    regs = category_regexes()
    expr = None
    for cat in fixed.CATEGORY_ORDER:
        cond = framework_match(lpath) if cat == "laravel" else lpath.rlike(regs[cat])
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr.otherwise(F.lit(None).cast("string"))


def _case(key: Column, mapping: dict[str, str], default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(default)


def has_sensitive_keyword(filename: Column) -> Column:
    """Substring test of the sensitive words on the lower-cased file name (C4). One pattern, as a chain
    of tests would grow the generated code beyond what the JVM compiles."""
    return filename.rlike("|".join(map(re.escape, fixed.SENSITIVE_KEYWORDS)))


def ends_with_any(col: Column, exts: list[str]) -> Column:
    return col.rlike("(?:" + "|".join(map(re.escape, exts)) + r")\z")


def classification(category: Column, filename: Column) -> tuple[Column, Column]:
    """(resource_type, severity) from the category and the lower-cased file name."""
    cat_type = _case(category, {k: v[0] for k, v in fixed.CATEGORY_MAP.items()},
                     F.lit(fixed.CATEGORY_DEFAULT[0]))
    cat_sev = _case(category, {k: v[1] for k, v in fixed.CATEGORY_MAP.items()},
                    F.lit(fixed.CATEGORY_DEFAULT[1]))
    is_doc = ends_with_any(filename, fixed.SENSITIVE_DOC_EXTENSIONS)
    is_img = ends_with_any(filename, fixed.CLASSIFIER_IMAGE_EXTENSIONS)
    sensitive = has_sensitive_keyword(filename)
    rtype = (F.when(category.isNotNull(), cat_type)
             .when(is_doc & sensitive, F.lit("POTENTIAL_SENSITIVE_DOCUMENT"))
             .when(is_doc, F.lit("PUBLIC_DOCUMENT"))
             .when(is_img, F.lit("PUBLIC_IMAGE"))
             .otherwise(F.lit("PUBLIC_EXPECTED")))
    sev = (F.when(category.isNotNull(), cat_sev)
           .when(is_doc & sensitive, F.lit("MEDIUM"))
           .when(is_doc, F.lit("LOW"))
           .otherwise(F.lit("INFORMATIONAL")))
    return rtype, sev


def filename_of(lpath: Column) -> Column:
    """Last path segment (the whole path when it has no '/')."""
    return F.substring_index(lpath, "/", -1)


def with_classification(df, path_col: str, prefix: str = "") -> "DataFrame":  # noqa: F821
    """Add ``{prefix}category``, ``{prefix}class_type`` and ``{prefix}class_severity`` for the
    URL path column ``path_col`` (as parsed, not yet lower-cased)."""
    lp = f"{prefix}_lpath"
    df = df.withColumn(lp, F.lower(F.col(path_col)))
    df = df.withColumn(f"{prefix}category", path_category(F.col(lp)))
    rtype, sev = classification(F.col(f"{prefix}category"), filename_of(F.col(lp)))
    return df.withColumns({f"{prefix}class_type": rtype, f"{prefix}class_severity": sev}).drop(lp)


def severity_rank(sev: Column) -> Column:
    """0 for CRITICAL ... 4 for INFORMATIONAL."""
    return _case(sev, {s: i for i, s in enumerate(fixed.SEVERITIES)}, F.lit(None)).cast("int")
