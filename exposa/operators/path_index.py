"""Path categories (C1) through an inverted index of the patterns, for pattern lists of any length.

``functions.classify.path_category`` tries every category's alternation on every path. Here each pattern is filed under
a gram, three characters that any path it matches must hold, taken from its literal text; an alternation is filed
under one gram for each of its branches. Distinct paths are cut into grams and looked up; only the patterns fetched are
run, and the first category wins as before. Patterns without so much literal text are run on every path.

Of a pattern's grams the one in fewest paths is taken, counted over all distinct paths. The index has a row or a few for
each pattern, so its size is that of the pattern list, which the driver holds anyway.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.functions import fixed
from exposa.session import materialize

GRAM = 3


def all_rules() -> list[tuple[str, str]]:
    """(category, pattern) of the fixed lists, in the order of the categories."""
    return [(c, p) for c in fixed.CATEGORY_ORDER for p in (fixed.framework_patterns() if c == "laravel" else fixed.PATTERNS[c])]


def _runs(tree) -> Iterator[str]:
    """Literal runs that every match of a parsed pattern holds."""
    run = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        yield run
        run = ""
        if name == "SUBPATTERN":
            yield from _runs(arg[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            yield from _runs(arg[-1])
    yield run


def _branches(tree) -> list:
    """The branches of a pattern that is one alternation, else the pattern itself."""
    if len(tree) == 1:
        op, arg = tree[0]
        if str(op) == "SUBPATTERN":
            return _branches(arg[-1])
        if str(op) == "BRANCH":
            return [b for branch in arg[1] for b in _branches(branch)]
    return [tree]


def grams(pattern: str) -> list[list[str]]:
    """For each branch of a lower-case pattern the grams that all its matches hold; an empty list where there is none."""
    out = []
    for branch in _branches(re._parser.parse(pattern)):
        out.append(sorted({run[k:k + GRAM] for run in _runs(branch) for k in range(len(run) - GRAM + 1)}))
    return out


def _cut(path):
    n = F.length(path) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda k: F.substr(path, k, F.lit(GRAM)))))


def categories(paths: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(path, category, evaluated) of each distinct lower-cased ``path``: the category of the first rule, in their order,
    that is found in it, null without one, and how many patterns were run."""
    rules = all_rules() if rules is None else rules
    spark = paths.sparkSession
    rank = {c: i for i, c in enumerate(dict.fromkeys(c for c, _ in rules))}
    patterns = dict.fromkeys((rank[c], p.lower()) for c, p in rules)
    filed = {(r, p): grams(p) for r, p in patterns}
    distinct = materialize(paths.select(F.lower("path").alias("path")).where("path IS NOT NULL").distinct())
    cut = distinct.select("path", F.explode(_cut(F.col("path"))).alias("gram"))
    wanted = sorted({g for branches in filed.values() for b in branches for g in b})
    asked = spark.createDataFrame([(g,) for g in wanted], "gram string")
    found = dict(cut.join(F.broadcast(asked), "gram").groupBy("gram").count().collect())  # at most the patterns' own grams
    index, always = set(), []
    for (r, p), branches in filed.items():
        if all(branches):
            index |= {(min(b, key=lambda g: (found.get(g, 0), g)), r, p) for b in branches}
        else:
            always.append((r, p))
    filed_rows = spark.createDataFrame(sorted(index), "gram string, rank int, pattern string")
    # a row for each pattern: the list is the driver's own, so its size is known
    fetched = cut.join(F.broadcast(filed_rows), "gram").select("path", "rank", "pattern").distinct()
    hit = F.when(F.regexp_like("path", F.col("pattern")), F.col("rank"))
    some = fetched.groupBy("path").agg(F.min(hit).alias("rank"), F.count("*").alias("evaluated"))
    for_all = F.lit(None).cast("int")
    for r in sorted({r for r, _ in always}, reverse=True):
        alternation = "|".join(f"(?:{p})" for q, p in always if q == r)
        for_all = F.when(F.col("path").rlike(alternation), F.lit(r)).otherwise(for_all)
    names = F.array(*[F.lit(c) for c in rank]).cast("array<string>")
    out = distinct.join(some, "path", "left").withColumn("first", F.least("rank", for_all))
    return out.select("path", F.try_element_at(names, F.col("first") + 1).alias("category"),
                      (F.coalesce("evaluated", F.lit(0)) + len(always)).cast("bigint").alias("evaluated"))
