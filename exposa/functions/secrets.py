"""Secret patterns, redaction (X2) and the redacted evidence snippet.

The per-type secret patterns are this engine's own (the scanner's detector module is not
published); they follow public token formats and avoid lookaround so the JVM engine and RE2 read
them the same way. Scanning is per line, which gives the line number of each match.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposa.functions import fixed
from exposa.functions.content import PY_SPACE
from exposa.functions.urls import once

# (secret_type, what stands before the value, the value, what stands after it, confidence percent)
SECRET_PARTS = [
    ("AWS_CREDENTIALS", r"\b", r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"\b", 95),
    ("PRIVATE_KEY", "", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", "", 95),
    ("JWT", r"\b", r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}", "", 90),
    ("DATABASE_CONNECTION", r"\b",
     r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:@/]+:[^\s@]+@[^\s\"']+", "", 90),
    ("AUTHORIZATION_HEADER", r"(?i)\bauthorization\s*:\s*(?:bearer|basic)\s+", r"[\w.+/=-]{8,}", "", 85),
    ("API_KEY", r"(?i)\bapi[_-]?key[\"']?\s*[:=]\s*[\"']?", r"[\w-]{16,}", "", 80),
    ("ACCESS_TOKEN", r"(?i)\b(?:access[_-]?)?token[\"']?\s*[:=]\s*[\"']?", r"[\w.-]{16,}", "", 80),
    ("PASSWORD", r"(?i)\b(?:password|passwd|pwd)[\"']?\s*[:=]\s*[\"']?", r"[^\s\"']{4,}", "", 70),
    ("ENCRYPTION_KEY", r"(?i)\b(?:encryption[_-]?key|app_key)[\"']?\s*[:=]\s*[\"']?", r"[\w+/=:-]{16,}", "", 80),
]
# (secret_type, pattern with one capture group for the value, confidence percent)
SECRET_PATTERNS = [(name, f"{before}({value}){after}", pct) for name, before, value, after, pct in SECRET_PARTS]


def _masking(before: str, value: str, after: str) -> tuple[str, str]:
    """Pattern and replacement that keep what surrounds the value."""
    flags, before = ("(?i)", before[4:]) if before.startswith("(?i)") else ("", before)
    return f"{flags}({before}){value}{after}", "$1[REDACTED]"


#: Applied to each line in this order; a private key's whole block is masked before.
LINE_MASKS = [_masking(b, v, a) for name, b, v, a, _ in SECRET_PARTS if name != "PRIVATE_KEY"]
#: Of each of them, what its matches hold in the lower-cased line; and of the secret-looking assignments.
MASK_KEYWORDS = [["akia", "asia"], ["eyj"], ["://"], ["authorization"], ["api"], ["token"], ["pass", "pwd"], ["encryption", "app_key"]]
SNIPPET_KEYWORDS = ["pass", "secret", "token", "api", "private", "access", "auth", "credential", "pwd"]
KEY_BLOCK = r"(?s)-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----.*?(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----|\z)"

# Any-type prefilter: a document with no match skips the per-line explode entirely.
ANY_SECRET = "|".join(f"(?:{p.replace('(?i)', '')})" if "(?i)" not in p else f"(?i:{p[4:]})"
                      for _, p, _ in SECRET_PATTERNS)

# A keyword every pattern needs (compared on the lower-cased text, so it is a superset test):
# a text without any of them cannot match, and is dropped by cheap substring checks before the
# regexes run.
SECRET_KEYWORDS = ["akia", "asia", "-----begin", "eyj", "://", "authorization", "api", "token",
                   "pass", "pwd", "encryption", "app_key"]


def may_contain_secret(text: Column) -> Column:
    def keyword(low):
        cond = F.lit(False)
        for k in SECRET_KEYWORDS:
            cond = cond | low.contains(k)
        return cond

    return once(F.lower(text), keyword) & text.rlike(ANY_SECRET)


LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def redact(secret_type: Column, value: Column) -> Column:
    """Masked form of a secret value (X2): private keys always ``***``; values of 12 or more
    characters keep their first four characters, shorter ones become ``***``."""
    return (F.when(secret_type == "PRIVATE_KEY", F.lit("***"))
            .when(F.length(value) >= 12, F.concat(F.substring(value, 1, 4), F.lit("****")))
            .otherwise(F.lit("***")))


def split_lines(text: Column) -> Column:
    """Lines as the scanner splits them: every line-break kind, no trailing empty line."""
    def split(text):
        ends_with_break = text.rlike(f"(?:{LINE_BREAK})$")
        return (F.when((text == "") | text.isNull(), F.array().cast("array<string>"))
                .otherwise(once(F.split(text, LINE_BREAK, -1), lambda parts: F.when(
                    ends_with_break, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))))

    return once(text, split)


def mask_secrets(line: Column) -> Column:
    """A line with every secret value (X1) and every secret-looking assignment masked. A pattern runs on lines with
    one of its keywords; masking takes no keyword into a line."""
    masks = [*zip(MASK_KEYWORDS, LINE_MASKS), (SNIPPET_KEYWORDS, (fixed.SNIPPET_SECRET_KEY_PATTERN, "$1$2[REDACTED]"))]

    def masked(low):
        out = line
        for words, (pattern, replacement) in masks:
            may = functools.reduce(operator.or_, [low.contains(w) for w in words])
            out = once(out, lambda v: F.when(may, F.regexp_replace(v, pattern, replacement)).otherwise(v))
        return out

    return once(F.lower(line), masked)


def redacted_snippet(sample: Column, max_lines: int = fixed.SNIPPET_MAX_LINES) -> Column:
    """First ``max_lines`` lines, stripped, without secrets (private keys as whole blocks, X1 matches,
    secret-looking assignments), plus a ``... (N more lines)`` note (X4)."""
    def snippet(lines):
        masked = F.transform(F.slice(lines, 1, max_lines), mask_secrets)
        body = F.regexp_replace(F.array_join(masked, "\n"), f"^{PY_SPACE}+|{PY_SPACE}+$", "")
        n = F.size(lines)
        return F.when(n > max_lines, F.concat(body, F.lit("\n... ("), (n - max_lines).cast("string"),
                                              F.lit(" more lines)"))).otherwise(body)

    return once(split_lines(F.regexp_replace(sample, KEY_BLOCK, "[REDACTED PRIVATE KEY]")), snippet)
