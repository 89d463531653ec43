import random
import re

from exposa.llm import url_filter as U


def brute(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url[url.index("://") + 3:]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in U.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.host + r.path))
        return host, path, best.host + best.path, best.verdict
    verdicts = {r.verdict for r in U.PATTERN_RULES if re.search(r.pattern, url)}
    return host, path, None, "allow" if "allow" in verdicts or not verdicts else "block"


def urls():
    r = random.Random(4)
    out = [None, "", "no-scheme.org/x", "http://", "://org", "HTTP://A.ORG/", "http://a.org", "http://a.org?x=/", "x://y://example.org/es/",
           "http://example.org/es/", "http://xexample.org/es/", "http://sub.EXAMPLE.org/en/1", "http://example.org/en/2",
           "http://com/de/", "http://a.b.com/fr/x#/de/", "http://spam-farm.net/", "http://x.adult-x.net/a", "http://y.net/?sessionid=1",
           "http://y.net/porn/a", "http://mycasino.net/", "http://casino-x.net/", "http://y.net:80/wp-admin/", "http://u@y.net/WP-LOGIN.php"]
    for _ in range(1500):
        out.append(r.choice(["http://", "https://", "", "ftp://"]) + r.choice(["a.", "www.", "", "spam-farm.", "x.casino."])
                   + r.choice(["example.org", "example.com", "b.net", "org", "com", "EXAMPLE.ORG", "adult-x.net"])
                   + r.choice(["", "/", "/es/", "/en/1", "/en/12/", "/fr/3", "/de/4.html", "/porn/", "/cart/add", "/wp-login.php"])
                   + r.choice(["", "?page=2", "#top", "?PHPSESSID=4", "?a=xxx&b", "/x?y#z"]))
    return out


def test_against_brute_force(spark):
    pages = list(enumerate(urls())) + [(0, None), (None, "http://a.org/")]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in pages], "page_id long, url string, host string, rule string")
    rows = U.filter_urls(df).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows), key=key) == sorted(
        ((i, *brute(u)) for i, u in pages), key=key)


def test_needed_tokens():
    want = {r"://spam-farm\.": [{"spam", "farm"}], r"spam": [set()], r"/(porn|xxx)[/?]": [{"porn"}, {"xxx"}],
            r"\bfoo\b": [{"foo"}], r"(?a)\bfoo\b": [set()], r"^foo$": [{"foo"}], r"/a+b/": [set(), {"ab"}], r"/(foo-)*bar/": [{"bar"}, {"foo", "bar"}],
            r"/foo[-_]?bar/": [{"foo", "bar"}, {"foobar"}], r"/foo.bar/": [set()], r"/FOO(?=x)/": [{"foo"}], r"/x{3}/": [set()],
            r"[^a-z]foo\W": [set()], r"\Wfoo[^\w]": [{"foo"}], r"(?i:/foo/)": [{"foo"}], r"/(a|bb)(c|dd)(e|ff)(g|hh)(i|jj)(k|ll)(m|nn)/": [set()]}
    for pattern, alternatives in want.items():
        assert sorted(U.needed(pattern), key=sorted) == sorted(map(frozenset, alternatives), key=sorted), pattern


def random_pattern(r, depth=0):
    def part():
        kind = r.randrange(9 if depth < 2 else 6)
        if kind < 2:
            return r.choice(["a", "b", "sk", "i", "K", "a", "\u017f"])
        if kind < 4:
            return r.choice(["/", "-", r"\.", "[/.]", r"\W", "[^a-z]", "="])
        if kind < 6:
            return r.choice(["[a-z]", ".", r"\b", "^", "$", r"\d", "[ab]", "(?=a)"])
        inner = random_pattern(r, depth + 1)
        return f"(?:{inner})" + r.choice(["", "", "?", "*", "+", "{2}", "{0,3}", "+?"])
    return "|".join("".join(part() for _ in range(r.randint(1, 5))) for _ in range(r.choice([1, 1, 2])))


def test_needed_tokens_stand_in_every_match():
    r = random.Random(8)
    matches = indexed = 0
    for _ in range(6000):
        body = random_pattern(r)
        if r.random() < 0.6:  # a token that may stand whole
            edge = lambda: r.choice(["/", r"\b", "[-.=]", r"\W", "(?:^|/)", "(?:/|$)", "-?"])
            body = edge() + f"(?:{r.choice(['a', 's', 'k', 'i', 'ab', 'a(?:b|k)?', 'S(?=K)'])})" + edge() + f"(?:{body})?"
        pattern = r.choice(["", "(?i)", "(?a)", "(?im)"]) + body
        alternatives = U.needed(pattern)
        compiled = re.compile(pattern)
        for _ in range(12):
            text = "".join(r.choice("aabsSkKi/-.=\n1\u0130\u0131\u017f\u212aé") for _ in range(r.randint(0, 9)))
            if compiled.search(text):
                matches += 1
                indexed += all(alternatives)
                assert any(a <= U.tokens(text) for a in alternatives), (pattern, text)
    assert matches > 5000 and indexed > 100


def test_rules_sit_under_their_rarest_token(spark):
    df = spark.createDataFrame([(i, f"http://spam.net/{i}") for i in range(9)] + [(10, "http://FARM.net")], "page_id long, url string")
    counts = U.token_counts(df, ["spam", "farm", "x"])
    assert counts == {"spam": 9, "farm": 1}
    index = U.RuleIndex((), U.PATTERN_RULES, counts)
    assert 0 in index.by_token["farm"] and "spam" not in index.by_token


def test_only_candidates_run():
    index = U.RuleIndex(U.HOST_RULES, U.PATTERN_RULES, {})
    assert not index.always
    assert index.judge("http://plain.net/page")[4] == 0
    assert index.judge("http://spam-farm.net/page")[4] == 1
    assert index.judge("http://plain.net/xxx/sessionid")[4] == 2


def test_ten_thousand_rules(spark):
    r = random.Random(6)
    words = [f"{a}{b}{i}" for i, (a, b) in enumerate((a, b) for a in ("alpha", "beta", "site", "shop") for b in ("x", "yy", "zed") * 40)]
    rules = []
    for _ in range(10_000):
        a, b, c = r.sample(words, 3)
        rules.append(U.PatternRule(r.choice(["block", "block", "allow"]), r.choice(
            [rf"(?i)://([a-z0-9-]+\.)*{a}-{b}\.", rf"/({a}|{b})/.*\b{c}\b", rf"[?&]{a}={b}(&|$)", rf"(?i)/{a}/{b}(\.html?|/|$)"])))
    urls = [r.choice([f"http://w.{r.choice(words)}-{r.choice(words)}.net/", f"http://n.net/{r.choice(words)}/{r.choice(words)}.html",
                      f"http://n.net/{r.choice(words)}/x?{r.choice(words).upper()}", f"http://n.net/?{r.choice(words)}={r.choice(words)}"])
            for _ in range(150)]
    for rule in rules[:100]:  # some that fit for sure
        if rule.pattern.startswith("[?&]"):
            urls.append("http://n.net/?" + rule.pattern[4:].partition("(")[0])
    compiled = [(rule.verdict, re.compile(rule.pattern)) for rule in rules]
    want = []
    for url in urls:
        verdicts = {v for v, p in compiled if p.search(url)}
        want.append("allow" if "allow" in verdicts or not verdicts else "block")
    rows = U.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), (), rules).orderBy("page_id").collect()
    assert [x["verdict"] for x in rows] == want and "block" in want
    assert max(x["n_candidates"] for x in rows) < 500  # of 10,000


def test_very_long_urls(spark):
    urls = ["http://n.net/" + "a/" * 100_000 + "xxx/", "http://n.net/" + "x" * 300_000, "http://" + "casino-" * 20_000 + "b.net/"]
    rows = U.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r["verdict"] for r in rows] == ["block", "allow", "block"]


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
