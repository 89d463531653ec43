"""Character references of HTML, decoded the way a parser decodes them.

The table is the HTML standard's (as the Python library has it): 2,231 names, some of which also count without
their semicolon. A reference takes the longest name that what follows the ampersand begins with. The table is a
literal of the plan, in parts by first character, so a look-up compares few names.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A numeric reference, a run that may begin with a name, a run without one, or a lone '&'.
REFERENCE_REGEX = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&"


def windows_1252() -> dict[int, str]:
    """What the codes 128 to 159 stand for: characters of code page 1252, where it has one."""
    out = {}
    for code in range(128, 160):
        try:
            out[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    return out


def _names() -> Column:
    parts: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        parts.setdefault(name[0], {})[name] = text
    return F.from_json(F.lit(json.dumps(parts)), "map<string,map<string,string>>")


def _character(code: Column) -> Column:
    """The character of a code, null where there is none."""
    old = F.from_json(F.lit(json.dumps({str(k): v for k, v in windows_1252().items()})), "map<string,string>")
    ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(code.between(128, 159), F.coalesce(F.try_element_at(old, code.cast("string")), F.chr(code))).when(
        ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode(v: Column) -> Column:
    """``v`` with its references decoded; numbers that are no character and unknown names stay."""
    names = _names()

    def piece(p: Column) -> Column:
        hexadecimal = F.conv(F.regexp_extract(p, r"^&#[xX]0*([0-9a-fA-F]{1,6});?$", 1), 16, 10).try_cast("bigint")
        decimal = F.regexp_extract(p, r"^&#0*([0-9]{1,7});?$", 1).try_cast("bigint")
        name = F.substr(p, F.lit(2))
        own = F.try_element_at(names, F.substring(name, 1, 1))
        shorter = F.transform(F.sequence(F.length(name) - 1, F.lit(2), F.lit(-1)), lambda k: F.struct(
            k.alias("k"), F.try_element_at(own, F.substr(name, F.lit(1), k)).alias("c")))
        first = F.try_element_at(F.filter(shorter, lambda s: s["c"].isNotNull()), F.lit(1))
        prefix = F.when(F.length(name) > 2, F.concat(first["c"], F.substr(name, first["k"] + 1)))
        return (F.when(~p.startswith("&") | (p == "&"), p)
                .when(p.rlike("^&#[xX]"), F.coalesce(_character(hexadecimal), p))
                .when(p.startswith("&#"), F.coalesce(_character(decimal), p))
                .otherwise(F.coalesce(F.try_element_at(own, name), prefix, p)))

    decoded = F.array_join(F.transform(F.regexp_extract_all(v, F.lit(REFERENCE_REGEX), 0), piece), "")
    return F.when(v.contains("&"), decoded).otherwise(v)
