"""How far sources of a language differ in their words (op 11).

A term is a maximal run of bytes other than ASCII non-letters, A-Z lower-cased. One ``bytes.translate`` with a
table lowers the letters and blanks the separators, ``bytes.split`` cuts, and a document's ``Counter`` gives its
frequencies. Tasks add these up for each (lang, source) and send the sums; only terms that occur are ever
counted. A language keeps the ``V`` terms that at least ``min_docs`` of its documents hold.

Each (lang, source) and each language gives every kept term the smoothed share
``p = 1 + floor(scale * (count + 1) / (N + V))``, N being its count of kept terms. The divergence of p from q is
``floor((p - q)^2 / q)``, in whole numbers throughout: the shares by a long division in two steps, exact for up
to 2.8e14 occurrences; sums of divergences stay below 2^63 while V is below 2e9.

* ``pair``: each source against each other one of its language, summed over all kept terms. Tasks hold a
  matrix of sums for each language and send it instead of a row for each term and pair.
* ``term``: terms a source has more of than its language, the ``top`` first; batches send no more of a source
  than can be among them.

A hot source or language is many rows of terms, which hash by (lang, term). Per language the sources' totals
are one row, which joins to the terms. The result has a row for each two sources of a language, so memory of
that order is taken: a task sends its sums whenever it holds ``CELLS``.

Defined results: null text, lang and source count as ''; a document without terms still makes its (lang, source)
occur; rows that repeat a doc_id count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposa.llm.common import batch, in_batches, materialize, text_of

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Entries of term counts, and of sums, that a task holds before it sends them on.
ENTRIES, CELLS = 300_000, 4_000_000
#: Lowers A-Z, blanks every other byte below 128 that is no letter.
TABLE = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("docs", pa.int64()),
                    ("n", pa.int64())])
VALUES = pa.schema([("lang", pa.string()), ("source", pa.int32()), ("other", pa.int32()), ("term", pa.string()),
                    ("value", pa.int64())])


def term_counts(documents: DataFrame) -> DataFrame:
    """Partial sums: lang, source, term, docs (documents that hold it), n (occurrences)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        entries = 0

        def sums() -> pa.RecordBatch:
            """Both counters of a group met its terms in the same order."""
            sizes = [len(total) for _, total in held.values()]
            terms, docs, n = ([x for pair in held.values() for x in pick(*pair)] for pick in
                              (lambda d, t: t, lambda d, t: d.values(), lambda d, t: t.values()))
            lang, source = (np.repeat(np.array([k[i] for k in held], object), sizes) for i in (0, 1))
            return batch(COUNTS, {"lang": pa.array(lang, pa.string()), "source": pa.array(source, pa.string()),
                                  "term": terms, "docs": docs, "n": n})

        for rows in batches:
            for lang, source, text in zip(*(rows.column(c).to_pylist() for c in ("lang", "source", "text"))):
                docs, total = held[lang, source]
                before, own = len(total), Counter(text.translate(TABLE).split())
                docs.update(own.keys())
                total.update(own)
                entries += len(total) - before
                if entries >= ENTRIES:
                    yield sums()
                    held.clear()
                    entries = 0
        if entries:
            yield sums()

    return in_batches(documents.select("lang", "source", text_of().cast("binary").alias("text")), run,
                      "lang string, source string, term binary, docs long, n long")


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), without overflow below 2.8e14."""
    first, second = 31_250, 32_000
    assert first * second == SCALE
    whole, rest = np.divmod((n + 1) * first, total)
    return 1 + whole * second + rest * second // total


def numbered_sources(documents: DataFrame) -> DataFrame:
    """lang, source, place: the sources of a language in their order, from 0."""
    return (documents.select("lang", "source").distinct()
            .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1))


def kept_terms(documents: DataFrame, sources: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, n (of the language), entries (place of a source, n), of the terms that enough documents hold."""
    sums = (term_counts(documents).join(sources, ["lang", "source"]).repartition("lang", "term")
            .groupBy("lang", "term", "place").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
    return (sums.groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"),
                 F.collect_list(F.struct("place", "n")).alias("entries"))
            .where(F.col("docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"), "n", "entries"))


def language_table(sources: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each language with terms: lang, lang_total (N + V) and totals, the same of each source by place."""
    by_source = (terms.select("lang", F.explode("entries").alias("e"))
                 .groupBy("lang", F.col("e.place").alias("place")).agg(F.sum("e.n").alias("N")))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("V"), F.sum("n").alias("lang_n"))
    return (sources.join(by_source, ["lang", "place"], "left").join(sizes, "lang")
            .groupBy("lang", (F.col("lang_n") + F.col("V")).alias("lang_total"))
            .agg(F.sort_array(F.collect_list(F.struct("place", (F.coalesce("N", F.lit(0)) + F.col("V")).alias("total")))).alias("s"))
            .select("lang", "lang_total", F.col("s.total").alias("totals")))


def divergences(terms: DataFrame, languages: DataFrame, top: int) -> DataFrame:
    """lang, source (place), other (place; null for a term's row), term (null for a pair's), value: partial sums of
    the pairs, and the terms that may be among the first of their source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, matrix in held.items():
                k, step = len(matrix), max(1, 200_000 // len(matrix))
                for at in range(0, k, step):
                    part = matrix[at:at + step]
                    other, source = np.divmod(np.arange(part.size, dtype=np.int32), k)
                    yield batch(VALUES, {"lang": [lang] * part.size, "source": source, "other": other + at,
                                         "term": pa.nulls(part.size, pa.string()), "value": part.ravel()})

        for rows in batches:
            langs = np.array(rows.column("lang").to_pylist(), object)
            for lang in set(langs):
                own = rows.filter(pa.array(langs == lang))
                total = own.column("totals")[0].values.to_numpy()
                entry = np.repeat(np.arange(own.num_rows), own.column("places").value_lengths().to_numpy())
                place = own.column("places").flatten().to_numpy(zero_copy_only=False)
                p = np.tile(share(np.zeros_like(total), total), (own.num_rows, 1))
                p[entry, place] = share(own.column("counts").flatten().to_numpy(zero_copy_only=False), total[place])
                sums_of = held.setdefault(lang, np.zeros((len(total), len(total)), np.int64))
                for other in range(len(total)):
                    q = p[:, other:other + 1]
                    sums_of[other] += ((p - q) ** 2 // q).sum(0)
                q = share(own.column("n").to_numpy(), own.column("lang_total")[0].as_py())[entry]
                more = p[entry, place] > q
                entry, place, q = entry[more], place[more], q[more]
                value = (p[entry, place] - q) ** 2 // q
                for source in np.unique(place):
                    at = np.flatnonzero(place == source)
                    if len(at) > top:  # and all that tie with the last
                        at = at[value[at] >= np.partition(value[at], -top)[-top]]
                    yield batch(VALUES, {"lang": [lang] * len(at), "source": np.full(len(at), source, np.int32),
                                         "other": pa.nulls(len(at), pa.int32()), "value": value[at],
                                         "term": own.column("term").take(pa.array(entry[at]))})
            if sum(m.size for m in held.values()) >= CELLS:
                yield from sums()
                held.clear()
        yield from sums()

    rows = terms.join(languages, "lang").select("lang", "term", "n", "lang_total", "totals", F.col("entries.place").alias("places"),
                                                F.col("entries.n").alias("counts"))
    return in_batches(rows, run, "lang string, source int, other int, term string, value long")


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    documents = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    sources = materialize(numbered_sources(documents))
    terms = materialize(kept_terms(documents, sources, min_docs))
    values = materialize(divergences(terms, materialize(language_table(sources, terms)), top))
    own = sources.withColumnRenamed("place", "g")
    others = sources.select("lang", F.col("source").alias("item"), F.col("place").alias("h"))
    sums = (values.where("term IS NULL").groupBy("lang", F.col("source").alias("g"), F.col("other").alias("h"))
            .agg(F.sum("value").alias("value")))
    pairs = (own.join(others, "lang").where("g <> h").join(sums, ["lang", "g", "h"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))
    distinct = (values.where("term IS NOT NULL").select("lang", F.col("source").alias("g"), F.col("term").alias("item"), "value")
                .join(own, ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, distinct)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


ORACLE = r"""
WITH docs AS (
  SELECT coalesce(lang, '') lang, coalesce(source, '') source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
words AS (SELECT lang, source, r, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM sources LEFT JOIN counts USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v)::HUGEINT AS p
      FROM totals JOIN sizes USING (lang) JOIN (SELECT lang, term FROM kept) USING (lang)
           LEFT JOIN counts c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (kept.n + 1)) // (sizes.n + v)::HUGEINT AS q FROM kept JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM sources a JOIN sources b USING (lang) LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  WHERE a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200"""
