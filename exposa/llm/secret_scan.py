"""Secret scan: base patterns, and formats learned as probabilistic automata (op 1).

1. ``find`` runs the base patterns over each whole text and lists the other candidates: ``MIN_RUN`` or
   more token characters in a row outside base matches. Only positions and character classes leave the
   task, no secret.
2. ``learn`` takes up to ``EXAMPLES`` base matches of each kind (those of smallest hash) as labelled
   credentials, examples of public token formats drawn from a rule, and as many ordinary candidates,
   without what in them fits a format, word by word beside words drawn from a rule; prefix trees of their character classes are merged into automata (``automata``).
3. ``Formats.spans`` scores every part of a candidate that begins at its start or after a separator
   (anything but a letter or digit), ends at its end or before one, and has ``MIN_RUN`` characters: a key
   after ``NAME=``, in a path or before a full stop. A part is a secret of kind ``format`` if some format
   fits it as well as it fits its own examples (per symbol), better than the automaton of ordinary runs
   by ``MARGIN``, and it holds a digit where all examples of the format do. Of parts that overlap those stay
   that make the whole candidate likeliest, the rest of it read by the automaton of ordinary runs, which
   starts anew after each separator, and each side joined to other text paying ``JOINT``.

Defined results: a null text is the empty text (no spans); a null doc_id stays null; repeated rows
give a row each; an empty table gives an empty result; other columns are ignored by ``scan`` and kept
by ``redact``. Positions are code points, the end is exclusive. Without labelled base matches the
public formats alone are learned.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm.automata import Automaton, infer, symbols
from exposa.llm.common import batch, in_batches, materialize, sample_by_hash, text_of

KINDS = ("assign", "access", "hex", "format")
MIN_RUN = 16
#: Labelled examples of a kind, and their greatest length.
EXAMPLES, LONGEST = 2000, 128
#: What ``symbols`` makes of letters and digits; anything else separates.
CLASSES = frozenset("0azAZ")
#: Nats that a symbol costs while ordinary runs are learned: the classes, the separators ``+/_.=-`` and the end alike.
UNIFORM = math.log(len(CLASSES) + len("+/_.=-") + 1)
#: By how many nats a format must beat ordinary runs.
MARGIN = 15.0
#: Nats that a part pays for each side on which the run goes on.
JOINT = 3.0
#: Share of a format's own examples that may fall below its floor.
FLOOR = 0.02
#: Public token formats: prefix, characters, length of the rest. Fixed values.
PUBLIC_FORMATS = {
    "github": ("ghp_", string.ascii_letters + string.digits, 36),
    "google": ("AIza", string.ascii_letters + string.digits + "-_", 35),
    "stripe": ("sk_live_", string.ascii_letters + string.digits, 24),
    "slack": ("xoxb-", string.digits + "-" + string.ascii_letters, 40),
}
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
WORD = re.compile("[0azAZ]*[^0azAZ]|[0azAZ]+")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) in the order of start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """(start, run) of the token characters in a row outside base spans."""
    out, k = [], 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while k and base[k - 1][2] > at:  # an earlier span may reach into several runs
            k -= 1
        for s, _, e, _ in base[k:]:
            if s >= end:
                break
            if s - at >= MIN_RUN:
                out.append((at, text[at:s]))
            at = max(at, e)
            k += 1
        if end - at >= MIN_RUN:
            out.append((at, text[at:end]))
    return out


FOUND = pa.schema([("doc_id", pa.int64()), ("kind", pa.list_(pa.int32())), ("start", pa.list_(pa.int64())),
                   ("end", pa.list_(pa.int64())), ("shape", pa.list_(pa.string()))])
#: kind of a candidate in FOUND
CANDIDATE = 3


def find(documents: DataFrame) -> DataFrame:
    """Per document the base spans and the candidates (kind 3), each with its character classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {f.name: [] for f in FOUND}
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                base = base_spans(text)
                spans = [(s, k, e, symbols(v)) for s, k, e, v in base]
                spans += [(s, CANDIDATE, s + len(v), symbols(v)) for s, v in candidates(text, base)]
                out["doc_id"].append(doc_id)
                for name, column in zip(("start", "kind", "end", "shape"), zip(*sorted(spans)) if spans else ((),) * 4):
                    out[name].append(column)
            yield batch(FOUND, out)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return in_batches(docs, run, "doc_id long, kind array<int>, start array<long>, end array<long>, shape array<string>")


class Formats:
    """The learned automata, each with its examples' floor of log-likelihood per symbol and whether it needs a digit."""

    def __init__(self, examples: dict[str, Counter], ordinary: Counter):
        self.formats: list[tuple[Automaton, float, bool]] = []
        self.ordinary: Automaton | None = None
        self.seen: dict[str, list[tuple[int, int]]] = {}
        for _, shapes in sorted(examples.items()):
            a = infer(sorted(shapes.items()))
            fits = sorted(a.log_likelihood(s) / (len(s) + 1) for s, n in shapes.items() for _ in range(n))
            self.formats.append((a, fits[int(FLOOR * len(fits))], all("0" in s for s in shapes)))
        # unlabelled runs that look like a credential would teach the wrong thing
        plain = Counter(ordinary_examples())
        for s, n in ordinary.items():
            at = 0
            for start, end in [*self.spans(s), (len(s), len(s))]:
                for word in WORD.findall(s[at:start]):
                    plain[word] += n
                at = end
        self.seen.clear()
        self.ordinary = infer(sorted(plain.items()), smoothing=1.0)

    def spans(self, shape: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets in a candidate's character classes, in order."""
        known = self.seen.get(shape)
        if known is None:
            cost = self._ordinary_cost(shape)
            known = heaviest(part for form in self.formats for part in self._fits(form, shape, cost))
            if len(self.seen) < 100_000 and len(shape) <= LONGEST:
                self.seen[shape] = known
        return known

    def _ordinary_cost(self, shape: str) -> list[float]:
        """Log-likelihood of each beginning of the run as an ordinary one (while that is learned: all symbols alike)."""
        total, out, at = 0.0, [0.0], 0
        for i, c in enumerate(shape):
            if self.ordinary is None:
                total -= UNIFORM
            else:
                if i and shape[i - 1] not in CLASSES:
                    at = 0
                total += self.ordinary.log[at].get(c, self.ordinary.log_other[at])
                at = self.ordinary.next[at].get(c, at)
            out.append(total)
        return out

    @staticmethod
    def _fits(form: tuple[Automaton, float, bool], shape: str, cost: list[float]) -> Iterator[tuple[int, int, float]]:
        """(end, start, gain over ordinary runs less joints) of the parts that fit a format.

        All starts are read in one pass. Of the parts that stand in the same state, are long enough and
        hold a digit or none, only the one of greatest surplus over the floor and the one of greatest gain go
        on: whatever follows changes all of them alike. So the work is linear in the text's length."""
        a, floor, needs_digit = form
        if needs_digit and "0" not in shape:
            return
        live: list[tuple[int, bool, int, float, float]] = []  # state, digit, start, surplus, gain
        for i, c in enumerate(shape):
            if i == 0 or shape[i - 1] not in CLASSES:
                live.append((0, False, i, -floor, -JOINT if i else 0.0))
            ordinary = cost[i + 1] - cost[i]
            best: dict[tuple, list] = {}
            for f, digit, start, surplus, gain in live:
                x = a.log[f].get(c, a.log_other[f])
                surplus += x - floor
                if surplus - floor * (len(shape) - i) < 0:  # no rest of the run can mend it
                    continue
                part = (a.next[f].get(c, f), digit or c == "0", start, surplus, gain + x - ordinary)
                key = (part[0], part[1], start if i + 1 - start < MIN_RUN else -1)
                kept = best.get(key)
                if kept is None:
                    best[key] = [part, part]
                else:
                    if surplus > kept[0][3]:
                        kept[0] = part
                    if part[4] > kept[1][4]:
                        kept[1] = part
            live = [part for x, y in best.values() for part in ((x,) if x is y else (x, y))]
            if i + 1 == len(shape) or shape[i + 1] not in CLASSES:
                for f, digit, start, surplus, gain in live:
                    gain += a.log_end[f] - (JOINT if i + 1 < len(shape) else 0.0)
                    if (i + 1 - start >= MIN_RUN and (digit or not needs_digit) and surplus + a.log_end[f] >= 0
                            and gain >= MARGIN):
                        yield i + 1, start, gain


def heaviest(parts: Iterable[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """(start, end) of the parts (end, start, weight) without overlap whose weights add up to most, in order."""
    ends, totals, chosen = [0], [0.0], [(0, 0)]  # chosen: start, and the place of what stands before it
    for end, start, weight in sorted(parts):
        before = bisect_right(ends, start) - 1
        if totals[before] + weight > totals[-1]:
            if ends[-1] < end:
                for column in (ends, totals, chosen):
                    column.append(None)
            ends[-1], totals[-1], chosen[-1] = end, totals[before] + weight, (start, before)
    out, at = [], len(ends) - 1
    while at:
        start, before = chosen[at]
        out.append((start, ends[at]))
        at = before
    return out[::-1]


def public_examples(n: int = 300) -> dict[str, Counter]:
    rng = random.Random(7)
    return {name: Counter(symbols(prefix + "".join(rng.choices(chars, k=length))) for _ in range(n))
            for name, (prefix, chars, length) in PUBLIC_FORMATS.items()}


def ordinary_examples(n: int = 300) -> Counter:
    """Words of names, paths and numbers, each with the separator after it: lower-case, capital, upper-case, digits."""
    rng, out = random.Random(8), Counter()
    for i in range(n):
        first, rest, longest = (("az", "az", 9), ("AZ", "az", 9), ("AZ", "AZ", 9), ("0", "0", 3))[i % 4]
        out[rng.choice(first) + "".join(rng.choices(rest, k=rng.randint(0, longest))) + rng.choice("+/_.=- ").strip()] += 1
    return out


def learn(found: DataFrame, examples: int = EXAMPLES) -> Formats:
    """Automata from a bounded sample of the found matches: the ``examples`` shapes of each kind
    whose hashes with their position are smallest."""
    spans = (found.select("doc_id", F.explode(F.arrays_zip("kind", "start", "shape")).alias("s"))
             .select("doc_id", "s.*").where(F.length("shape") <= LONGEST))
    labelled: dict[str, Counter] = public_examples()
    ordinary: Counter = Counter()
    for kind, name in enumerate((*KINDS[:3], "ordinary")):
        rows = sample_by_hash(spans.where(F.col("kind") == kind), examples, "doc_id", "start", "shape").select("shape").collect()
        if rows:
            counts = Counter(r["shape"] for r in rows)
            if kind == CANDIDATE:
                ordinary = counts
            else:
                labelled[name] = counts
    return Formats(labelled, ordinary)


SPANS = "spans array<struct<kind:string,start:bigint,end:bigint>>"
DIGEST = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS),
                    ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans (all spans as
    kind:start:end by start, then kind, comma-joined)."""
    found = materialize(find(documents))
    formats = learn(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {f.name: [] for f in DIGEST}
            columns = [rows.column(c).to_pylist() for c in ("doc_id", "kind", "start", "end", "shape")]
            for doc_id, kinds, starts, ends, shapes in zip(*columns):
                spans = [(s, k, e) for k, s, e in zip(kinds, starts, ends) if k < CANDIDATE]
                spans += [(s + x, k, s + y) for k, s, shape in zip(kinds, starts, shapes) if k == CANDIDATE
                          for x, y in formats.spans(shape)]
                spans = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in sorted(spans)]
                out["doc_id"].append(doc_id)
                n = Counter(k for k, _ in spans)
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"].append(n[k])
                base = ",".join(s for k, s in spans if k < CANDIDATE)
                out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                out["spans"].append(",".join(s for _, s in spans))
            yield batch(DIGEST, out)

    return in_batches(found, run, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, "
                      "base_sha256 string, spans string")


def redacted(text: str, formats: Formats) -> str:
    """The text with each secret replaced by ``[kind]``; spans that overlap are replaced together."""
    base = base_spans(text)
    spans = [(s, e, k) for s, k, e, _ in base]
    spans += [(s + x, s + y, CANDIDATE) for s, v in candidates(text, base) for x, y in formats.spans(symbols(v))]
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with the secrets of each text replaced and ``n_chars`` counted again where the
    table has it; all rows and other columns stay. A null text stays null."""
    formats = learn(materialize(find(documents)))
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = rows.schema.get_field_index("text")
            texts = [t if t is None else redacted(t, formats) for t in rows.column(at).to_pylist()]
            yield rows.set_column(at, rows.schema.field(at), pa.array(texts, type=rows.schema.field(at).type))

    out = in_batches(documents, run, schema)
    return out.withColumn("n_chars", F.length(text_of()).cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out
