"""How the sources of a language differ in their words: DuckDB aggregates shards, Spark merges their sums and ranks them.

Tasks count the terms of their texts by language and source.  The counts are dealt by the hash of language and term, so
that a shard holds all there is of a term; DuckDB sums them there and keeps the terms of enough documents.  Spark sums
the totals of every group.  With these, shards of kept terms, as many as the table of terms by sources needs, make the
smoothed shares of all their terms in all sources and sum the distances of each pair of sources over them; Spark merges
the shards' partial sums and ranks them.

All arithmetic is of integers.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagefold.llm.common import pieces, stored, table, text_or_empty

#: A term is kept by a language if so many of its documents have it; added to each count; terms ranked for a source.
LEAST_DOCS, PRIOR, TOP_TERMS = 30, 5, 50
#: Shares are of so many.
SCALE = 1_000_000_000
#: Terms that a task counts before it hands them on, and rows that a shard takes before it sums them.
HELD_TERMS, HELD_ROWS = 400_000, 1_000_000
#: Terms times sources of one shard, about.
SHARD_CELLS = 500_000

#: A-Z as a-z; every other byte of ASCII ends a term.  All bytes of other characters are 0x80 or more.
BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

COUNTS = "lang string, source string, term string, n bigint, docs bigint"
KEPT = "lang string, source string, term string, n bigint"
FOUND = "lang string, source string, part string, item string, value bigint"

SUMMED = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM seen GROUP BY ALL"
#: Counts of the kept terms: of every source that has them, and of the language, where source is null.
KEPT_SQL = """
WITH often AS (SELECT lang, term, sum(n)::BIGINT AS n FROM seen GROUP BY ALL HAVING sum(docs) >= {least})
SELECT s.lang, s.source, s.term, s.n FROM seen s JOIN often o ON s.lang = o.lang AND s.term = o.term
UNION ALL SELECT lang, NULL, term, n FROM often"""
#: The share of each of a shard's terms in each group of its language, and in the language, whether it occurs there or not.
SHARES_SQL = """
CREATE TEMP TABLE shares AS
SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n,
  (1 + ({scale}::HUGEINT * (coalesce(k.n, 0) + {prior})) // (g.total + {prior} * g.terms))::BIGINT AS p
FROM (SELECT lang, term FROM kept WHERE source IS NULL) t JOIN groups g ON g.lang = t.lang
LEFT JOIN kept k ON k.lang = t.lang AND k.term = t.term AND k.source IS NOT DISTINCT FROM g.source"""
FOUND_SQL = """
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL
SELECT a.lang, a.source, 'pair', b.source, 0::BIGINT FROM groups a JOIN groups b ON a.lang = b.lang AND a.source < b.source
WHERE hash(a.source) % {shards} = {shard}
UNION ALL
SELECT lang, source, 'term', term, value FROM (
  SELECT a.lang, a.source, a.term, a.p - q.p AS value, row_number() OVER (PARTITION BY a.lang, a.source ORDER BY a.p - q.p DESC, a.term) AS nth
  FROM shares a JOIN shares q ON a.lang = q.lang AND a.term = q.term AND q.source IS NULL
  WHERE a.source IS NOT NULL AND a.n > 0 AND a.p > q.p) WHERE nth <= {top}"""


def connect():
    """An in-memory database of one thread that writes no files."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"})


def counted(docs: DataFrame) -> DataFrame:
    """COUNTS of (lang, source, text): occurrences of each term and documents that have it, summed over part of the rows."""

    def told(held):
        for (lang, source), (n, has) in held.items():
            terms = list(n)
            if terms:
                same = [pa.repeat(pa.scalar(v, pa.string()), len(terms)) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([has[t] for t in terms], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for b in (p for batch in batches for p in pieces(batch, 2)):
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                terms = text.translate(BYTES).split()
                n, has = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                has.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from told(held)
                held = {}
        yield from told(held)

    return docs.mapInArrow(run, COUNTS)


def kept_counts(counts: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """KEPT of COUNTS: one shard is one task, and holds no more than its distinct (lang, source, term) and HELD_ROWS rows."""

    def run(batches):
        with connect() as db:
            db.execute("CREATE TABLE seen (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            waits = most = 0
            for b in batches:
                db.register("part", pa.Table.from_batches([b]))
                db.execute("INSERT INTO seen SELECT lang, source, term, n, docs FROM part")
                waits += b.num_rows
                if waits > max(HELD_ROWS, most):
                    db.execute(f"CREATE OR REPLACE TABLE seen AS {SUMMED}")
                    waits, most = 0, db.execute("SELECT count(*) FROM seen").fetchall()[0][0]
            db.execute(f"CREATE OR REPLACE TABLE seen AS {SUMMED}")
            yield from arrow(db, KEPT_SQL.format(least=least_docs), ("lang", "source", "term", "n")).to_batches()

    return counts.repartition(shards, "lang", "term").mapInArrow(run, KEPT)


def arrow(db, sql: str, names) -> pa.Table:
    told = db.execute(sql).to_arrow_table()
    return pa.table([told.column(c).cast(pa.int64() if c in ("n", "value") else pa.string()) for c in names], names=list(names))


def divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, prior: int = PRIOR, top_terms: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and its own terms.

    A term is a longest stretch of ASCII letters, taken as lower case, and other characters beyond ASCII.  A language
    keeps the terms of at least least_docs of its rows.  A group's share of a kept term is 1 + floor(SCALE * (count + prior) /
    (total + prior * terms)), whether the term occurs in it or not; so is the language's.  part `pair`: item is another
    source of the language, value the sum over all kept terms of the distance of shares (0 without any).  part `term`:
    item is a kept term that the group has and whose share is above the language's, value by how much; the first
    top_terms.  rank: by value, highest first, then by item's bytes.

    Null languages, sources and texts are ''.  A group without terms is compared all the same; a lone source has no
    `pair` rows; an empty table gives an empty one.  Each row is a document: rows that repeat count as often.  Other
    columns are not read.
    """
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    # As many shards as the input has partitions: both grow with it.
    kept = stored(kept_counts(counted(rows), max(8, docs.rdd.getNumPartitions()), least_docs), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    langs = totals.where("source is null").select("lang", F.col("total").alias("lang_total"), "terms")
    groups = rows.select("lang", "source").distinct().join(totals.where("source is not null").select("lang", "source", "total"), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = stored(groups.unionByName(langs.select("lang", F.lit(None).cast("string").alias("source"), F.col("lang_total").alias("total"), "terms")), "groups")
    shards = 1 + int(groups.agg(F.sum("terms")).first()[0] or 0) // SHARD_CELLS

    def run(key, kept, groups):
        with connect() as db:
            db.register("kept", kept)
            db.register("groups", groups)
            db.execute(SHARES_SQL.format(scale=SCALE, prior=prior))
            return arrow(db, FOUND_SQL.format(shards=shards, shard=key[0].as_py(), top=top_terms), ("lang", "source", "part", "item", "value"))

    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    copies = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = dealt.groupBy("shard").cogroup(copies.groupBy("shard")).applyInArrow(run, FOUND)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    both = summed.withColumn("way", F.explode(F.when(F.col("part") == "pair", ways).otherwise(F.slice(ways, 1, 1)))).select("lang", "way.source", "part", "way.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top_terms))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


UPPER = "".join(map(chr, range(65, 91)))
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
langs AS (SELECT lang, sum(n) AS total, count(*) AS terms FROM kept GROUP BY lang),
own AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT g.lang, g.source, coalesce(sum(o.n), 0) AS total FROM grp g LEFT JOIN own o USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(o.n, 0) AS n,
        (1 + ({SCALE}::HUGEINT * (coalesce(o.n, 0) + {PRIOR})) // (t.total + {PRIOR} * l.terms))::BIGINT AS p,
        (1 + ({SCALE}::HUGEINT * (k.n + {PRIOR})) // (l.total + {PRIOR} * l.terms))::BIGINT AS q
      FROM tot t JOIN kept k ON k.lang = t.lang JOIN langs l ON l.lang = t.lang
      LEFT JOIN own o ON o.lang = t.lang AND o.source = t.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}"""

QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE_SQL = {"op13_source_divergence": SQL}
