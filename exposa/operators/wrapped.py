"""Secrets that run over line ends (X1): wrapped tokens, broken string literals, whole private-key blocks.

The scan by lines gives line numbers but sees a value only as far as its line goes. Here neighbouring lines are joined
where one goes on in the next:

* a backslash at the end;
* a string literal closed (and ``+`` or ``.``) at the end and another opened at the start of the next line;
* a hard wrap: a line of ``WRAP`` or more characters that ends in ``RUN`` characters of a token, the next line beginning
  with one (white space before it is dropped).

Joined lines are one row that carries its first line's number and the places of the joints, so a match has a first
and a last line. Matches within one line are the other scan's; of matches that overlap, the one that begins first, of
those the longest, stays. Private-key blocks are taken whole from BEGIN to END.

Everything is row-local and linear in the text; the raw value stays in this function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.functions import secrets as X

WRAP, RUN = 40, 16
#: Stands for a joint between two lines; taken out of texts first.
JOINT = "\ue000"
_TOKEN = r"[A-Za-z0-9+/=_.:@-]"
_CLOSED = r"[\"']\s*[+.]?\s*\\?\s*$"
_OPENED = r"^\s*[\"']"
_BACKSLASH = r"\\\s*$"
KEY_BLOCK = r"(?s)-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----.*?-----END (?:[A-Z]+ )?PRIVATE KEY-----"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _joint(line: Column, following: Column) -> Column:
    """How a line goes on in the next: 2 literal, 1 backslash, 4 hard wrap, 0 not at all. A line's end and the next
    one's start are looked at before any expression runs."""
    blank = F.lit(" \t")
    start = F.substring(F.ltrim(following, blank), 1, 1)
    return _let(F.substring(F.rtrim(line, blank), -1, 1), lambda end: (
        F.when(end.isin('"', "'", "+", ".", "\\") & start.isin('"', "'") & line.rlike(_CLOSED), F.lit(2)).when(end == "\\", F.lit(1))
        .when((F.length(line) >= WRAP) & start.rlike(_TOKEN) & F.substring(line, -RUN, RUN).rlike(f"^{_TOKEN}{{{RUN}}}$"), F.lit(4))
        .otherwise(F.lit(0))))


def _runs(text: Column) -> Column:
    """Joined lines: ``<number of the first line>:<piece><JOINT><piece>...``, in an array. Neighbours come from arrays
    zipped with themselves."""
    def piece(p, i):
        line, after, before = p["line"], p["after"], p["before"]
        body = F.when(before == 2, F.regexp_replace(line, _OPENED, "")).when(before > 0, F.regexp_replace(line, r"^\s+", "")).otherwise(line)
        body = F.when(after == 2, F.regexp_replace(body, _CLOSED, "")).when(after == 1, F.regexp_replace(body, _BACKSLASH, "")).otherwise(body)
        number = F.when(before == 0, F.concat((i + 1).cast("string"), F.lit(":"))).otherwise(F.lit(""))
        # of what is zipped, the last is longer by an entry that has no line
        return F.coalesce(F.concat(number, body, F.when(after > 0, F.lit(JOINT)).otherwise(F.lit("\n"))), F.lit(""))

    def joined(lines, joints):
        ends = F.zip_with(lines, joints, lambda line, after: F.struct(line.alias("line"), after.alias("after")))
        both = F.zip_with(ends, F.concat(F.array(F.lit(0)), joints), lambda e, before: F.struct(
            e["line"].alias("line"), e["after"].alias("after"), before.alias("before")))
        pieces = F.transform(both, piece)
        return F.filter(F.split(F.array_join(pieces, ""), "\n"), lambda r: r.contains(JOINT))

    def joints(lines):
        following = F.concat(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), F.array(F.lit(None).cast("string")))
        return F.zip_with(lines, following, lambda a, b: F.when(b.isNull(), F.lit(0)).otherwise(_joint(a, b)))

    def lines(parts):  # no empty line after the last break
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    none = F.array().cast("array<string>")
    return _let(F.split(F.translate(text, JOINT, ""), X.LINE_BREAK, -1), lambda parts: _let(lines(parts), lambda ls: _let(
        joints(ls), lambda js: F.when(F.exists(js, lambda j: j > 0), joined(ls, js)).otherwise(none))))


def _placed(text: Column, pattern: str, type_rank: int, group: int) -> Column:
    """Array of (start, stop, type_rank, value) of a pattern's matches: each begins after the text before it."""
    empty = F.array().cast("array<struct<start:int,stop:int,type_rank:int,value:string>>")
    parts = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), group))
    matches = F.filter(F.transform(parts, lambda m: F.struct(m["0"].alias("before"), m["1"].alias("w"), m["2"].alias("v"))),
                       lambda m: m["w"].isNotNull())  # what stands after the last match has none

    def step(acc, m):
        start = acc["stop"] + F.length(m["before"]) + 1
        stop = start + F.length(m["w"]) - 1
        found = F.struct(start.alias("start"), stop.alias("stop"), F.lit(type_rank).alias("type_rank"), m["v"].alias("value"))
        return F.struct(stop.alias("stop"), F.concat(acc["found"], F.array(found)).alias("found"))

    return F.aggregate(matches, F.struct(F.lit(0).alias("stop"), empty.alias("found")), step)["found"]


def _pieces_before(pieces: Column, at: Column) -> Column:
    """How many pieces end before the character ``at`` (from 1) of the joined text."""
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"))
    return F.aggregate(pieces, start, lambda acc, p: F.struct(
        (acc["chars"] + F.length(p)).alias("chars"),
        F.when(acc["chars"] + F.length(p) < at, acc["n"] + 1).otherwise(acc["n"]).alias("n")))["n"]


def _apart(found: Column) -> Column:
    """Of spans in order of (start, longest first) those that do not overlap one kept before."""
    empty = F.filter(found, lambda m: F.lit(False))
    return F.aggregate(found, F.struct(F.lit(0).alias("stop"), empty.alias("kept")), lambda acc, m: F.when(
        m["start"] > acc["stop"], F.struct(m["stop"].alias("stop"), F.concat(acc["kept"], F.array(m)).alias("kept"))).otherwise(acc))["kept"]


def _breaks(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(X.LINE_BREAK), 0))


def wrapped_secrets(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, line_number, end_line, secret_type, redacted_value, confidence of each secret that runs over a line end.
    A null or empty text has none; rows that repeat their keys are scanned each."""
    text = F.col(text_col)
    d = df.where(text.isNotNull()).select(*keys, text.alias("_text"))

    runs = d.select(*keys, F.explode(_runs(F.col("_text"))).alias("_run"))
    runs = runs.select(*keys, F.substring_index("_run", ":", 1).cast("int").alias("_first"),
                       F.split(F.regexp_replace("_run", "^[0-9]+:", ""), JOINT).alias("_pieces"))
    runs = runs.withColumn("_joined", F.array_join("_pieces", ""))
    joined, pieces = F.col("_joined"), F.col("_pieces")
    runs = runs.where(joined.rlike(X.ANY_SECRET))
    found = F.concat(*[_placed(joined, p, i, 1) for i, (name, p, _) in enumerate(X.SECRET_PATTERNS) if name != "PRIVATE_KEY"])
    lined = F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), (m["start"] - m["stop"]).alias("shorter"), m["type_rank"].alias("type_rank"), m["stop"].alias("stop"),
        _pieces_before(pieces, m["start"]).alias("from"), _pieces_before(pieces, m["stop"]).alias("to"), m["value"].alias("value")))
    runs = runs.withColumn("_m", F.array_sort(F.filter(lined, lambda m: m["from"] < m["to"])))
    tokens = runs.select(*keys, "_first", F.explode(_apart(F.col("_m"))).alias("_m")).select(
        *keys, (F.col("_first") + F.col("_m.from")).alias("line_number"), (F.col("_first") + F.col("_m.to")).alias("end_line"),
        F.col("_m.type_rank").alias("type_rank"), F.col("_m.value").alias("value"))

    key_rank = [name for name, _, _ in X.SECRET_PATTERNS].index("PRIVATE_KEY")
    block = d.where(F.col("_text").contains("PRIVATE KEY-----")).select(*keys, "_text", F.explode(
        _placed(F.col("_text"), KEY_BLOCK, key_rank, 0)).alias("_m"))
    block = block.select(*keys, (_breaks(F.substr("_text", F.lit(1), F.col("_m.start") - 1)) + 1).alias("line_number"),
                         _breaks(F.col("_m.value")).alias("more"), F.col("_m.type_rank").alias("type_rank"), F.col("_m.value").alias("value"))
    block = block.where("more > 0").select(*keys, "line_number", (F.col("line_number") + F.col("more")).alias("end_line"), "type_rank", "value")

    kind = F.get(F.array(*[F.lit(n) for n, _, _ in X.SECRET_PATTERNS]), F.col("type_rank"))
    sure = F.get(F.array(*[F.lit(c) for _, _, c in X.SECRET_PATTERNS]), F.col("type_rank"))
    return tokens.unionByName(block).select(*keys, "line_number", "end_line", kind.alias("secret_type"),
                                            X.redact(kind, F.col("value")).alias("redacted_value"), sure.alias("confidence"))
