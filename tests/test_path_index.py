"""The pattern index gives what trying all patterns gives."""

import random
import re

from pyspark.sql import functions as F

from exposa.functions import classify as C
from exposa.functions import fixed
from exposa.operators import path_index as I


def random_paths(n, seed=5):
    r = random.Random(seed)
    words = [p.strip("/") for p in fixed.candidate_paths()] + fixed.FRAMEWORK_CONFIG_NAMES + ["x", "index", "page-1", "contests", "infrared", "aliases", "é"]
    ends = ["", "/", ".yml", ".yaml", ".php", ".bak", ".sql", ".tar.gz", ".log.1", ".json", "~", ".old", ".PDF", ".7z"]
    return ["/" + "/".join(r.choice(words) for _ in range(r.randrange(1, 4))) + r.choice(ends) for _ in range(n)] + ["", "/", "a", "ab", ".7z"]


def test_equals_the_case_expression(spark):
    paths = random_paths(2500)
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r for r in I.categories(df).collect()}
    want = dict(df.select(F.lower("path").alias("p")).distinct().select("p", C.path_category(F.col("p"))).collect())
    assert {p: r.category for p, r in got.items()} == want
    assert len({c for c in want.values()}) > 10
    # a path runs few of the patterns
    assert sum(r.evaluated for r in got.values()) / len(got) < len(I.all_rules()) / 15


def test_ten_thousand_rules(spark):
    r = random.Random(9)
    syllables = [a + b for a in "bcdfgklmnprst" for b in "aeiou"]
    word = lambda k=3: "".join(r.choice(syllables) for _ in range(k))
    kinds = [lambda: re.escape(word()), lambda: rf"\.{word(2)}$", lambda: f"(?:{word()}|{word()})/", lambda: f"{word(2)}[0-9]+{word(2)}?",
             lambda: f"{word(2)}.*{word(2)}", lambda: f"^/{word()}", lambda: r"\d\d\d\d$", lambda: f"(?:{word()})?x{word(2)}", lambda: f"({word(2)}-)+z"]
    rules = [(f"c{r.randrange(40)}", r.choice(kinds[:6] + kinds[7:])()) for _ in range(10_000)] + [("c3", kinds[6]())]
    texts = [w for _, p in rules for w in re.findall(r"[a-z]{4,}", p)]
    paths = ["/" + "/".join(r.choice([word(), r.choice(texts), f"{r.choice(texts)}-z", str(r.randrange(5000))]) for _ in range(3)) for _ in range(400)]
    got = {x.path: x.category for x in I.categories(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    order = list(dict.fromkeys(c for c, _ in rules))
    compiled = [(order.index(c), re.compile(p)) for c, p in rules]
    for p in paths:
        hits = [k for k, rx in compiled if rx.search(p)]
        assert got[p] == (order[min(hits)] if hits else None), p
    assert sum(c is not None for c in got.values()) > 50


def test_grams():
    assert I.grams(r"\.env$") == [[".en", "env"]]
    assert I.grams("abc|de|fgh/") == [["abc"], [], ["fgh", "gh/"]]
    assert I.grams("(?:abc|xyz)+q") == [[]]  # an alternation within a sequence gives nothing certain
    assert I.grams("(abcd)?x") == [[]] and I.grams("(?:abcd)+x") == [["abc", "bcd"]]


def test_no_paths_and_no_rules(spark):
    empty = spark.createDataFrame([], "path string")
    assert I.categories(empty).collect() == []
    some = spark.createDataFrame([("/A",), (None,)], "path string")
    assert [tuple(r) for r in I.categories(some, []).collect()] == [("/a", None, 0)]
