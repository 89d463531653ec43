"""Classifier cases from the scanner's own tests, plus the category-order traps."""

import pytest
from pyspark.sql import functions as F

from exposa.functions import classify as C
from exposa.functions import urls as U

CASES = [
    ("https://example.com/.env", "CONFIGURATION_EXPOSURE", "HIGH"),
    ("https://example.com/.git/config", "SOURCE_CONTROL_EXPOSURE", "CRITICAL"),
    ("https://example.com/backup.sql", "DATABASE_EXPOSURE", "CRITICAL"),
    ("https://example.com/config.php.bak", "BACKUP_EXPOSURE", "HIGH"),
    ("https://example.com/error.log", "LOG_EXPOSURE", "MEDIUM"),
    ("https://example.com/document.pdf", "PUBLIC_DOCUMENT", "LOW"),
    ("https://example.com/internal-document.pdf", "POTENTIAL_SENSITIVE_DOCUMENT", "MEDIUM"),
    ("https://example.com/image.jpg", "PUBLIC_IMAGE", "INFORMATIONAL"),
    ("https://example.com/page.html", "PUBLIC_EXPECTED", "INFORMATIONAL"),
    # order traps
    ("https://example.com/Thumbs.db", "DATABASE_EXPOSURE", "CRITICAL"),
    ("https://example.com/desktop.ini", "CONFIGURATION_EXPOSURE", "HIGH"),
    ("https://example.com/.htaccess", "CONFIGURATION_EXPOSURE", "CRITICAL"),
    ("https://example.com/package-lock.json", "PUBLIC_EXPECTED", "LOW"),
    ("https://example.com/package.json", "CONFIGURATION_EXPOSURE", "HIGH"),
    ("https://example.com/backup.tar.gz", "BACKUP_EXPOSURE", "HIGH"),
    ("https://example.com/x.tar.gz", "BACKUP_EXPOSURE", "MEDIUM"),
    ("https://example.com/xdebug/", "CONFIGURATION_EXPOSURE", "MEDIUM"),
    ("https://example.com/contests/", "CONFIGURATION_EXPOSURE", "HIGH"),
    ("https://example.com/infrared.yml", "CONFIGURATION_EXPOSURE", "HIGH"),
    ("https://example.com/latest.pdf", "POTENTIAL_SENSITIVE_DOCUMENT", "MEDIUM"),
    ("https://example.com/app/Models/", "CONFIGURATION_EXPOSURE", "HIGH"),
    ("https://example.com/x/.Homestead/y", "CONFIGURATION_EXPOSURE", "HIGH"),
    # directories and files of tools
    ("https://example.com/.svn/entries", "SOURCE_CONTROL_EXPOSURE", "CRITICAL"),
    ("https://example.com/.svn/wc.db", "SOURCE_CONTROL_EXPOSURE", "CRITICAL"),
    ("https://example.com/.hg/", "SOURCE_CONTROL_EXPOSURE", "CRITICAL"),
    ("https://example.com/.git/objects/ab", "SOURCE_CONTROL_EXPOSURE", "CRITICAL"),
    ("https://example.com/.gitignore", "SOURCE_CONTROL_EXPOSURE", "CRITICAL"),
    ("https://example.com/.gitattributes", "SOURCE_CONTROL_EXPOSURE", "CRITICAL"),
]

#: path -> category, read off the scanner's documentation of its categories, not off our own lists
CATEGORIES = {
    "/.svn/entries": "source_control", "/.hg/store/": "source_control", "/a/.gitignore": "source_control",
    "/.gitattributes": "source_control", "/.idea/workspace.xml": "development", "/.vscode/x": "development",
    "/.aws/x": "cloud", "/aws/credentials": "cloud", "/aws/config": "cloud", "/.github/workflows/x": "cicd",
    "/.gitlab-ci.yml": "cicd", "/.travis.yml": "cicd", "/.env": "config", "/db.sqlite3": "database",
    "/x.bak": "backup", "/x.7z": "archive", "/error.log": "logs", "/id_rsa": "credentials",
    "/jenkinsfile": "cicd", "/xdebug/": "debug", "/index.html": None, "/about/": None,
}


def test_expected_categories(spark):
    df = spark.createDataFrame([(p,) for p in CATEGORIES], "path string")
    got = {r.path: r.category for r in df.select("path", C.path_category(F.lower("path")).alias("category")).collect()}
    assert got == CATEGORIES


def test_reference_cases(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in CASES], "url string")
    df = C.with_classification(U.with_parts(df, "url", "p_"), "p_path")
    got = {r.url: (r.class_type, r.class_severity) for r in df.collect()}
    for url, t, s in CASES:
        assert got[url] == (t, s), url


def test_framework_rule_size():
    from exposa.functions import fixed
    # 143 names x (.yml, .yaml) + 142 dotted directories + 156 other patterns; the scanner's
    # "\.name/.*" twins of the directory patterns match exactly the same paths.
    assert len(fixed.framework_patterns()) == 143 * 2 + 142 + 156


def test_candidate_paths():
    from exposa.functions import fixed
    paths = fixed.candidate_paths()
    assert len(paths) == len(set(paths)) == 249
    assert {".env", "app/Models/", ".svn/wc.db", "wp-admin/", "blackfire/", "CODE_OF_CONDUCT.md"} <= set(paths)


def test_random_paths_match_direct_search(spark):
    """Spark's CASE over lower-cased alternations equals a first-match search of every pattern
    (case-insensitive) on random paths built from pattern fragments."""
    import random
    import re

    from exposa.functions import fixed

    rnd = random.Random(11)
    atoms = ["config", ".env", ".env.local", "storage/", "logs/", ".yml", ".yaml", "tests/", "app/Models/",
             ".git/", "HEAD", "~", ".tar.gz", "Thumbs.db", "x", "/", ".", "debug/", "backup", ".sql",
             "red", "Homestead", ".homestead/", "composer.", "json", "lock", "vendor/", "k8s/", ".php",
             ".bak", "settings.", "id_rsa", ".pem", "package", "-lock", "docker-compose", "Dockerfile",
             "nova", "public/", "index.php", "routes/", "web", "error.log", "credentials", ".aws/"]

    def rand_case(s):
        return "".join(c.upper() if rnd.random() < 0.2 else c for c in s)

    paths = ["/" + "".join(rand_case(rnd.choice(atoms)) for _ in range(rnd.randint(1, 5))) for _ in range(1500)]
    compiled = {c: [re.compile(p, re.IGNORECASE) for p in
                    (fixed.framework_patterns() + [p + ".*" for p in fixed.framework_patterns()
                                                   if p.endswith("/")]
                     if c == "laravel" else fixed.PATTERNS[c])]
                for c in fixed.CATEGORY_ORDER}

    def direct(path):
        lp = path.lower()
        fn = lp.rsplit("/", 1)[-1]
        for c in fixed.CATEGORY_ORDER:
            if any(p.search(fn) or p.search(lp) for p in compiled[c]):
                return c
        return None

    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: r.category for r in df.select("path", C.path_category(F.lower("path")).alias("category")).collect()}
    for p in paths:
        assert got[p] == direct(p), p
