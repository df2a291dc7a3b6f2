"""Queries of the paged-document operators over the driver's tables, with their oracle SQL.

The tables stand in for documents of the same shape: an order is a document and its distinct line numbers its pages,
a conversation is a split document and its turns the parts, events are attempt and job logs, orders are job rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagefold.functions import pages as pg
from pagefold.functions import text as tx
from pagefold.functions import units
from pagefold.operators import attempts, checks, diffing, jobs, merge, metrics, planning
from pagefold.sources import blobs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows, key, each=20_000):
    """rows dealt to tasks of about `each`, and to as many as there are cores at least: what is made of the rows is large.

    A scan is no measure of that: its splits are of bytes, and one of them gets all rows of a row group.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // each)
    return rows.repartition(n, key)


def order_pages(spark, sf_dir):
    """(doc_id, page): the distinct line numbers of each order."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("page")).distinct()


P = "WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page FROM lineitem)"


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS code_points, CAST(length_grapheme(text) AS BIGINT) AS graphemes,
    CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS utf16 FROM documents""")
def unit_lengths(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", *(units.unit_length(text, u).alias(n) for n, u in (("code_points", units.CODE_POINTS), ("graphemes", units.GRAPHEMES), ("utf16", units.UTF16))))


@query("""SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS len, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM conversations""")
def part_shifts(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("len"))
    return merge.part_shifts(turns, "conv_id", "turn", "len")


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS content_md5, CAST(length(string_agg(text, chr(10) ORDER BY turn)) AS BIGINT) AS len FROM conversations GROUP BY conv_id")
def merged_content(spark, sf_dir):
    whole = merge.merged_content(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return whole.select("conv_id", F.md5("content").alias("content_md5"), F.length("content").cast("bigint").alias("len"))


@query("""WITH s AS (SELECT conv_id, length(text) AS len, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM conversations)
    SELECT conv_id, count(*) AS parts, CAST(sum(len) + count(*) - 1 AS BIGINT) AS merged_length, CAST(max(shift + len) AS BIGINT) AS furthest_end FROM s GROUP BY conv_id""")
def merged_length_check(spark, sf_dir):
    shifted = part_shifts(spark, sf_dir)
    return shifted.groupBy("conv_id").agg(F.count("*").alias("parts"), (F.sum("len") + F.count("*") - 1).alias("merged_length"), F.max(F.col("shift") + F.col("len")).alias("furthest_end"))


PLAN = P + """, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
    k AS (SELECT *, (n + 2) // 3 AS k FROM s),
    q AS (SELECT *, CASE WHEN pos < (n % k) * (n // k + 1) THEN pos // (n // k + 1) ELSE n % k + (pos - (n % k) * (n // k + 1)) // (n // k) END AS part FROM k),
    plan AS (SELECT doc_id, page, CAST(part AS BIGINT) AS part, CAST(row_number() OVER (PARTITION BY doc_id, part ORDER BY page) AS BIGINT) AS local_no FROM q)"""


@query(PLAN + " SELECT * FROM plan")
def balanced_plan(spark, sf_dir):
    return planning.balanced_plan(order_pages(spark, sf_dir), 3)


@query(PLAN + ", z AS (SELECT doc_id, part, count(*) AS size FROM plan GROUP BY doc_id, part) SELECT size, count(*) AS parts, count(DISTINCT doc_id) AS docs FROM z GROUP BY size")
def plan_sizes(spark, sf_dir):
    sizes = balanced_plan(spark, sf_dir).groupBy("doc_id", "part").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("parts"), F.count_distinct("doc_id").alias("docs"))


@query(P + """, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
    SELECT doc_id, page, CAST(CASE WHEN pos <= (n + 1) // 2 THEN 0 ELSE 1 END AS BIGINT) AS half FROM s WHERE n >= 2""")
def halve_parts(spark, sf_dir):
    return planning.halve(order_pages(spark, sf_dir))


@query(P + """, i AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS island FROM p),
    r AS (SELECT doc_id, min(page) AS first, max(page) AS last FROM i GROUP BY doc_id, island)
    SELECT doc_id, string_agg(CASE WHEN first = last THEN CAST(first AS VARCHAR) ELSE first || '-' || last END, ',' ORDER BY first) AS runs FROM r GROUP BY doc_id""")
def format_pages(spark, sf_dir):
    return planning.page_runs(order_pages(spark, sf_dir))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber AS a, l_linenumber + CAST(l_quantity AS INT) % 4 AS b, CAST(l_quantity AS INT) % 9 + 1 AS c, row_number() OVER () AS rid FROM lineitem),
    g AS (SELECT a, b, c, count(*) AS uses FROM r WHERE b <= 8 AND c <= 8 GROUP BY ALL),
    e AS (SELECT a, b, c, uses, unnest(list_distinct(list_concat(range(a, b + 1), [c]))) AS page FROM g)
    SELECT a || '-' || b || ', ' || c AS spec, uses, count(*) AS n_pages, CAST(sum(page) AS BIGINT) AS page_sum FROM e GROUP BY a, b, c, uses""")
def select_ranges(spark, sf_dir):
    """Specs are parsed, selected against a document of 8 pages and counted; specs beyond it select nothing."""
    lines = read(spark, sf_dir, "lineitem")
    last = F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4
    spec = F.concat(F.col("l_linenumber"), F.lit("-"), last, F.lit(", "), F.col("l_quantity").cast("int") % 9 + 1)
    counted = lines.groupBy(spec.alias("spec")).agg(F.count("*").alias("uses"))
    chosen = counted.withColumn("pages", pg.select_pages(pg.parse_pages(F.col("spec")), F.lit(8))).where("pages is not null")
    total = F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return chosen.select("spec", "uses", F.size("pages").cast("bigint").alias("n_pages"), total.alias("page_sum"))


@query(PLAN + """, parts AS (SELECT doc_id, page FROM plan WHERE NOT (doc_id % 7 = 0 AND local_no = 2)
        UNION ALL SELECT doc_id, page FROM plan WHERE doc_id % 11 = 0 AND part = 0 UNION ALL SELECT doc_id, 99 FROM plan WHERE doc_id % 13 = 0 AND page = 1),
    c AS (SELECT doc_id, page, count(*) AS planned FROM parts GROUP BY doc_id, page)
    SELECT doc_id, page, coalesce(c.planned, 0) AS planned FROM (SELECT *, 1 AS wanted FROM p) FULL JOIN c USING (doc_id, page) WHERE coalesce(wanted, 0) <> coalesce(planned, 0)""")
def coverage_violations(spark, sf_dir):
    """Parts from which pages were taken, doubled and made up, against the selection."""
    plan = balanced_plan(spark, sf_dir)
    doc, page = F.col("doc_id"), F.col("page")
    kept, twice = F.when(~((doc % 7 == 0) & (F.col("local_no") == 2)), page), F.when((doc % 11 == 0) & (F.col("part") == 0), page)
    made_up = F.when((doc % 13 == 0) & (page == 1), F.lit(99).cast("bigint"))
    parts = plan.select("doc_id", F.explode(F.array_compact(F.array(kept, twice, made_up))).alias("page"))
    return planning.coverage_violations(parts, plan.select("doc_id", "page"))


@query(PLAN + """, r AS (SELECT l_orderkey AS doc_id, CAST(l_quantity AS BIGINT) % 2 AS part, CAST(l_partkey % 3 + 1 AS BIGINT) AS number, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT r.doc_id, r.part, r.number, n, page AS planned_page FROM r LEFT JOIN plan ON r.doc_id = plan.doc_id AND r.part = plan.part AND r.number = plan.local_no""")
def page_remap(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity").cast("bigint") % 2).alias("part"), (F.col("l_partkey") % 3 + 1).cast("bigint").alias("number")
    ).agg(F.count("*").alias("n"))
    out = merge.remap_pages(rows, balanced_plan(spark, sf_dir), "doc_id", "part", "number")
    return out.select("doc_id", "part", "number", "n", "planned_page")


@query("""WITH c AS (SELECT o_custkey AS doc_id, o_orderkey AS part, count(l_orderkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(items) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c)
    SELECT b.part, CAST(l_linenumber AS BIGINT) AS idx, count(*) AS n, CAST(max(CASE WHEN l_linenumber < items THEN l_linenumber + base END) AS BIGINT) AS merged_index
    FROM lineitem JOIN b ON l_orderkey = b.part GROUP BY ALL""")
def pointer_renumber(spark, sf_dir):
    """Pointers /lineitem/N of each order, renumbered in the array of its customer's orders."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    counts = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("part")).join(
        lines.groupBy(F.col("l_orderkey").alias("part")).agg(F.count("*").alias("items")), "part", "left"
    ).select("doc_id", "part", F.coalesce("items", F.lit(0)).alias("items"))
    bases = merge.running_base(counts, "doc_id", ["part"], F.col("items"), "base")
    spelled = lines.select(F.col("l_orderkey").alias("part"), tx.pointer(F.concat(F.lit("/lineitem/"), "l_linenumber"), ("lineitem",)).alias("p")).select("part", F.col("p.index").alias("idx"))
    pointers = spelled.groupBy("part", "idx").agg(F.count("*").alias("n"))
    return merge.renumber(pointers, bases, ["part"], "idx", "base", "items").select("part", "idx", "n", "merged_index")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def region_orphans(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return checks.dangling(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, ["o_orderkey"])


@query(P + """, n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id)
    SELECT doc_id, page AS ref FROM p JOIN n USING (doc_id) WHERE page > n""")
def dangling_pointers(spark, sf_dir):
    """Page numbers used as 1-based references to an order's distinct pages: those past their count dangle."""
    pages = order_pages(spark, sf_dir)
    targets = pages.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")).cast("bigint").alias("ref"))
    return checks.dangling(pages.select("doc_id", F.col("page").alias("ref")), targets, ["doc_id", "ref"])


LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM documents),
    s AS (SELECT doc_id, nth, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(line) AS len FROM l)"""


@query(LINES + """, w AS (SELECT doc_id, unnest(range(0, length(text) + 1, 1000)) AS o FROM documents)
    , j AS (SELECT s.doc_id, s.a, s.len, count(w.o) AS holders FROM s LEFT JOIN w ON s.doc_id = w.doc_id AND w.o <= s.a AND s.a + s.len <= w.o + 1000 GROUP BY ALL)
    SELECT doc_id, holders, count(*) AS n_lines FROM j GROUP BY doc_id, holders""")
def span_containment(spark, sf_dir):
    """How many windows of 1000 characters hold each distinct line span whole."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "line")).select("doc_id", "nth", F.length("line").cast("bigint").alias("len"))
    placed = merge.part_shifts(lines, "doc_id", "nth", "len").select("doc_id", F.col("shift").alias("inner_start"), (F.col("shift") + F.col("len")).alias("inner_end"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.length("text").cast("bigint"), F.lit(1000).cast("bigint"))
    windows = docs.select("doc_id", F.explode(starts).alias("outer_start")).withColumn("outer_end", F.col("outer_start") + 1000)
    held = merge.contained(placed, windows, "doc_id", 1000)
    return held.groupBy("doc_id", "holders").agg(F.count("*").alias("n_lines"))


@query(P + """, i AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS island FROM p)
    SELECT doc_id, min(page) * 10 AS first, max(page) * 10 + 10 AS last, count(*) AS n FROM i GROUP BY doc_id, island""")
def span_islands(spark, sf_dir):
    spans = order_pages(spark, sf_dir).select("doc_id", (F.col("page") * 10).alias("a"), (F.col("page") * 10 + 10).alias("b"))
    return merge.islands(spans, "doc_id", "a", "b")


@query(P + " SELECT doc_id, greatest(page * 10, 15) AS a, least(page * 10 + 10, 45) AS b FROM p WHERE greatest(page * 10, 15) < least(page * 10 + 10, 45)")
def span_clip(spark, sf_dir):
    spans = order_pages(spark, sf_dir).select("doc_id", (F.col("page") * 10).alias("a"), (F.col("page") * 10 + 10).alias("b"))
    return merge.clip(spans, "a", "b", F.lit(15), F.lit(45))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, 'returnflag' AS name, l_returnflag AS raw FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'linestatus', l_linestatus FROM lineitem
        UNION ALL SELECT l_orderkey, l_linenumber, 'discounted', 'yes' FROM lineitem WHERE l_discount > 0.05),
    p AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS of_parts FROM w GROUP BY l_orderkey)
    SELECT l_orderkey, name, count(DISTINCT raw) = 1 AND count(DISTINCT l_linenumber) = of_parts AS agrees, count(DISTINCT raw) AS n_values, count(DISTINCT l_linenumber) AS n_parts FROM w JOIN p USING (l_orderkey) GROUP BY l_orderkey, name, of_parts""")
def member_agreement(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    discounted = F.when(F.col("l_discount") > 0.05, F.struct(F.lit("discounted").alias("name"), F.lit("yes").alias("raw")))
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("raw")) for n, c in (("returnflag", "l_returnflag"), ("linestatus", "l_linestatus"))), discounted)
    members = lines.select("l_orderkey", "l_linenumber", F.explode(F.array_compact(names)).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
    return merge.agreement(members, "l_orderkey", "name", "raw", "l_linenumber")


FIRSTS = "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS place FROM events GROUP BY ALL), m AS (SELECT a.event_type AS before, b.event_type AS after, count(*) AS owners FROM f a JOIN f b ON a.user_id = b.user_id AND a.place < b.place GROUP BY ALL)"


@query(FIRSTS + " SELECT * FROM m")
def key_order_pairs(spark, sf_dir):
    return checks.order_pairs(read(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(FIRSTS + ", k AS (SELECT * FROM m WHERE owners >= (SELECT avg(owners) FROM m)) SELECT before, after, owners FROM m WHERE EXISTS (SELECT 1 FROM k WHERE k.before = m.after AND k.after = m.before) AND NOT EXISTS (SELECT 1 FROM k WHERE k.before = m.before AND k.after = m.after)")
def key_order_conflicts(spark, sf_dir):
    """A model of the pairs seen at least as often as the mean, and the pairs that turn it round."""
    pairs = key_order_pairs(spark, sf_dir)
    mean = pairs.agg(F.avg("owners").alias("mean"))
    model = pairs.join(F.broadcast(mean), F.col("owners") >= F.col("mean")).drop("mean")
    return checks.order_conflicts(model, pairs).select("before", "after", "owners")


TREE = """WITH RECURSIVE e(parent, child) AS (SELECT 'root', 'r' || r_regionkey FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
        UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
    t(node, depth) AS (SELECT 'root', 0 UNION ALL SELECT child, depth + 1 FROM e JOIN t ON parent = node)
    SELECT depth, count(*) AS nodes FROM t GROUP BY depth"""


@query(TREE.replace("depth, count", "CAST(depth AS BIGINT) AS depth, count"))
def section_depth(spark, sf_dir):
    """Sections as a tree of regions, nations and customers, walked from its root."""
    name = lambda letter, key: F.concat(F.lit(letter), key)
    of = lambda table, parent, child: read(spark, sf_dir, table).select(parent.alias("parent"), child.alias("child"))
    edges = of("region", F.lit("root"), name("r", "r_regionkey")).unionByName(of("nation", name("r", "n_regionkey"), name("n", "n_nationkey")))
    edges = edges.unionByName(of("customer", name("n", "c_nationkey"), name("c", "c_custkey")))
    return checks.tree_depths(edges, "root").groupBy("depth").agg(F.count("*").alias("nodes"))


def hour():
    return F.date_trunc("hour", F.col("ts"))


ATTEMPTS = """WITH a AS (SELECT event_id, user_id, ts, value, event_id % 37 = 0 AS caller_done, event_id % 5 = 0 AS deadline,
        CASE event_id % 14 WHEN 0 THEN NULL WHEN 1 THEN 202 WHEN 2 THEN 404 WHEN 3 THEN 405 WHEN 4 THEN 408 WHEN 5 THEN 429 WHEN 6 THEN 500 WHEN 7 THEN 502 WHEN 8 THEN 503 WHEN 9 THEN 504 WHEN 10 THEN 400 ELSE 200 END AS status,
        CASE event_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'azure_error' WHEN 2 THEN 'html' WHEN 3 THEN 'cut_short' ELSE 'result' END AS body FROM events),
    o AS (SELECT *, CASE WHEN caller_done THEN 'cancelled' WHEN (status IS NULL OR body = 'cut_short') AND deadline THEN 'retry_once' WHEN status IS NULL OR body = 'cut_short' THEN 'retry'
        WHEN status = 200 AND body = 'failed' THEN 'analysis_failed' WHEN status = 200 AND body = 'result' THEN 'success' WHEN status = 200 THEN 'terminal' WHEN status = 202 THEN 'retry'
        WHEN status IN (404, 405, 501) AND body <> 'azure_error' THEN 'route_missing' WHEN status IN (500, 504) THEN 'retry_once' WHEN status IN (408, 429, 502, 503) THEN 'retry' ELSE 'terminal' END AS outcome FROM a)"""


def attempt_log(spark, sf_dir):
    status = F.expr("case event_id % 14 when 0 then null when 1 then 202 when 2 then 404 when 3 then 405 when 4 then 408 when 5 then 429 when 6 then 500 when 7 then 502 when 8 then 503 when 9 then 504 when 10 then 400 else 200 end")
    body = F.expr("case event_id % 6 when 0 then 'failed' when 1 then 'azure_error' when 2 then 'html' when 3 then 'cut_short' else 'result' end")
    log = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", status.alias("status"), body.alias("body"))
    return log.withColumn("outcome", attempts.outcome(F.col("event_id") % 37 == 0, F.col("status"), F.col("body"), F.col("event_id") % 5 == 0))


@query(ATTEMPTS + " SELECT event_id, outcome FROM o")
def outcome_class(spark, sf_dir):
    return attempt_log(spark, sf_dir).select("event_id", "outcome")


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' 7 ' WHEN 2 THEN '-3' ELSE CAST(event_id AS VARCHAR) END AS raw, event_id % 9 + 1 AS n, value / 100.0 AS j FROM events),
    s AS (SELECT *, CASE WHEN regexp_matches(raw, '^ *[0-9]+ *$') THEN least(CAST(trim(raw) AS BIGINT), 86400) ELSE 0 END AS told FROM r)
    SELECT event_id, told, round(CASE WHEN told > 0 THEN least(CAST(told AS DOUBLE), 60.0) ELSE least(60.0, 2.0 * pow(2.0, n - 1)) * (0.5 + 0.5 * least(greatest(j, 0.0), 1.0)) END, 6) AS wait FROM s""")
def backoff_schedule(spark, sf_dir):
    raw = F.expr("case event_id % 4 when 0 then '' when 1 then ' 7 ' when 2 then '-3' else cast(event_id as string) end")
    rows = read(spark, sf_dir, "events").select("event_id", "value", attempts.retry_after(raw).alias("told"))
    return rows.select("event_id", "told", F.round(attempts.backoff(F.col("event_id") % 9 + 1, F.col("told"), F.col("value") / 100.0), 6).alias("wait"))


@query(ATTEMPTS + """, n AS (SELECT user_id, outcome, row_number() OVER w AS n, sum(CASE WHEN outcome = 'retry_once' THEN 1 ELSE 0 END) OVER w AS once FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    e AS (SELECT user_id, min(CASE WHEN outcome NOT IN ('retry', 'retry_once') OR n >= 5 OR once >= 2 THEN n END) AS stop, max(n) AS last FROM n GROUP BY user_id)
    SELECT e.user_id, CAST(n.n AS BIGINT) AS attempts, n.outcome AS last_outcome FROM e JOIN n ON n.user_id = e.user_id AND n.n = coalesce(e.stop, e.last)""")
def attempt_budget(spark, sf_dir):
    return attempts.budget(attempt_log(spark, sf_dir), "user_id", ["ts", "event_id"], "outcome")


@query("""SELECT event_id, round(CASE WHEN count(*) OVER w < 20 THEN 30.0 ELSE least(greatest(4 * quantile_cont(value / 20, 0.5) OVER w, 5.0), 30.0) END, 6) AS delay FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)""")
def hedge_delay(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 20)
    return attempts.hedge_delay(rows.select("event_id", "event_type", "ts", "seconds"), "event_type", hour(), ["ts", "event_id"], "seconds").select("event_id", F.round("delay", 6).alias("delay"))


@query("""WITH q AS (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS turn, min((ts, event_id)) OVER (PARTITION BY event_type, user_id) AS first FROM events)
    SELECT event_id, CAST(turn AS BIGINT) AS turn, CAST(row_number() OVER (PARTITION BY event_type ORDER BY turn, first) AS BIGINT) AS place FROM q""")
def fair_order(spark, sf_dir):
    """A fixed backlog for each surface, served round-robin by user."""
    queue = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts")
    return attempts.fair_order(queue, "event_type", "user_id", hour(), ["ts", "event_id"]).select("event_id", "turn", "place")


@query(f"SELECT le, count(value) FILTER (value / 10 <= le) AS n FROM events, (SELECT unnest([{', '.join(map(str, metrics.BOUNDS))}, 'inf'::DOUBLE]) AS le) GROUP BY le")
def latency_histogram(spark, sf_dir):
    return metrics.histogram(read(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 10), "seconds")


@query("SELECT event_type, count(event_id) AS n FROM (SELECT unnest(['click', 'view', 'purchase', 'signup', 'halved', 'hedged']) AS event_type) k LEFT JOIN events USING (event_type) GROUP BY event_type")
def labelled_counts(spark, sf_dir):
    return metrics.labelled_counts(read(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase", "signup", "halved", "hedged"])


JOBS = """WITH j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'notStarted' END AS status, o_orderpriority AS surface,
        epoch(o_orderdate)::BIGINT AS created_at, epoch(o_orderdate)::BIGINT + 86400 * (o_orderkey % 90) AS updated_at, epoch(o_orderdate)::BIGINT + 86400 * (o_orderkey % 400) AS expires_at,
        epoch(o_orderdate)::BIGINT + 86400 * (o_orderkey % 50) AS lease_until, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderkey % 5 AS attempts FROM orders)"""
NOW = 883612800  # 1998-01-01


def job_rows(spark, sf_dir):
    made, day = F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.lit(86400).cast("bigint")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("notStarted")
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        key.alias("id"), status.alias("status"), F.col("o_orderpriority").alias("surface"), made.alias("created_at"), (made + day * (key % 90)).alias("updated_at"),
        (made + day * (key % 400)).alias("expires_at"), (made + day * (key % 50)).alias("lease_until"), F.floor("o_totalprice").cast("bigint").alias("bytes"), (key % 5).alias("attempts"),
    )


@query(JOBS + f" SELECT id, status, expires_at FROM j WHERE expires_at < {NOW} AND (status IN ('succeeded', 'notStarted') OR lease_until < {NOW})")
def expired_jobs(spark, sf_dir):
    return jobs.expired(job_rows(spark, sf_dir), F.lit(NOW)).select("id", "status", "expires_at")


@query(JOBS + f" SELECT id, created_at FROM j WHERE ((status = 'notStarted' AND created_at < {NOW - 240}) OR status = 'running') AND lease_until < {NOW} AND expires_at >= {NOW} ORDER BY created_at, id LIMIT 100")
def orphaned_jobs(spark, sf_dir):
    return jobs.orphaned(job_rows(spark, sf_dir), F.lit(NOW), F.lit(NOW - 240), 100).select("id", "created_at")


@query(JOBS + f" SELECT id, status FROM j WHERE status IN ('running', 'notStarted') AND expires_at >= {NOW}")
def abandoned_jobs(spark, sf_dir):
    return jobs.abandoned(job_rows(spark, sf_dir), F.lit(NOW)).select("id", "status")


@query(JOBS + f" SELECT id, expires_at >= {NOW} AS live FROM j WHERE status = 'succeeded' ORDER BY live, updated_at, id LIMIT 256")
def eviction_order(spark, sf_dir):
    ordered = jobs.eviction_order(job_rows(spark, sf_dir), F.lit(NOW)).orderBy("live", "updated_at", "id").limit(256)
    return ordered.select("id", F.col("live").cast("boolean").alias("live"))


@query(JOBS + f""", e AS (SELECT *, (expires_at >= {NOW})::INT AS live FROM j WHERE status = 'succeeded'),
    f AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY surface ORDER BY live, updated_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM e)
    SELECT id, surface, CAST(freed AS BIGINT) AS freed_before FROM f WHERE freed < 5000000""")
def eviction_prefix(spark, sf_dir):
    return jobs.evict_until(job_rows(spark, sf_dir), F.lit(NOW), F.lit(5_000_000), "surface").select("id", "surface", "freed_before")


@query(JOBS + " SELECT id, updated_at FROM j ORDER BY updated_at DESC, id LIMIT 50")
def recent_jobs(spark, sf_dir):
    return job_rows(spark, sf_dir).orderBy(F.desc("updated_at"), "id").limit(50).select("id", "updated_at")


@query(JOBS + " SELECT surface, count(*) FILTER (status = 'notStarted') AS not_started, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) AS total FROM j GROUP BY surface")
def job_stats(spark, sf_dir):
    of = lambda s: F.count_if(F.col("status") == s)
    return job_rows(spark, sf_dir).groupBy("surface").agg(of("notStarted").alias("not_started"), of("running").alias("running"), of("succeeded").alias("succeeded"), F.count("*").alias("total"))


@query(JOBS + " SELECT id, CASE WHEN status = 'succeeded' THEN 'skip' WHEN id % 17 = 0 THEN 'fail_no_input' WHEN attempts >= 3 THEN 'fail_attempts' ELSE 'requeue' END AS action FROM j")
def recovery_actions(spark, sf_dir):
    return job_rows(spark, sf_dir).select("id", jobs.recovery_action(F.col("status"), F.col("id") % 17 != 0, F.col("attempts")).alias("action"))


@query("""WITH c AS (SELECT event_type, ts, event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS d FROM events)
    SELECT event_id, CAST(sum(d) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS inflight FROM c""")
def admission_replay(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("change", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1))
    return jobs.inflight(rows.select("event_id", "event_type", "ts", "change"), "event_type", hour(), ["ts", "event_id"], "change").select("event_id", "inflight")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM events GROUP BY user_id")
def job_latest_state(spark, sf_dir):
    return jobs.latest(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT doc_id AS id, max(doc_id % 100) AS newest, count(*) AS files FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id HAVING max(doc_id % 100) < 80")
def orphan_blobs(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100).alias("modified"))
    return blobs.orphans(files, read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), F.lit(80))


@query("""WITH s AS (SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 128) AS id FROM pages)
    SELECT page_id, left(id, 2) || '/' || substr(id, 3, 2) || '/' || id || '.res' AS path FROM s""")
def blob_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", blobs.blob_path(F.col("url"), F.lit("res")).alias("path"))


@query("SELECT DISTINCT source AS id FROM documents WHERE source > 'src1' ORDER BY id LIMIT 5")
def blob_listing(spark, sf_dir):
    return blobs.page_of(read(spark, sf_dir, "documents").select(F.col("source").alias("id")), "src1", 5)


MASK = """WITH m AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'id ' || substr(md5(html), 1, 8) || '-' || substr(md5(html), 9, 4) || '-' || substr(md5(html), 13, 4) || '-' || substr(md5(html), 17, 4) || '-' || substr(md5(html), 21, 12) || ' at ' || url
        WHEN 1 THEN '2024-01-0' || (page_id % 9 + 1) || CASE WHEN page_id % 2 = 0 THEN 'T' ELSE ' ' END || '10:20:30' || CASE page_id % 4 WHEN 0 THEN '.123' WHEN 1 THEN '.5' ELSE '' END || CASE page_id % 5 WHEN 0 THEN 'Z' WHEN 1 THEN 'z' WHEN 2 THEN '+02:00' WHEN 3 THEN '-11:30' ELSE '' END ELSE url END AS v, url FROM pages),
    k AS (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN '<datetime:2006-01-02' || CASE WHEN page_id % 2 = 0 THEN 'T' ELSE ' ' END || '15:04:05' || CASE page_id % 4 WHEN 0 THEN '.000' WHEN 1 THEN '.0' ELSE '' END || CASE page_id % 5 WHEN 0 THEN 'Z' WHEN 1 THEN 'z' WHEN 4 THEN '' ELSE '-07:00' END || '>'
        ELSE regexp_replace(replace(v, url, '<base>'), '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<guid>', 'g') END AS masked FROM m)"""


@query(MASK + " SELECT page_id, masked FROM k")
def mask_text(spark, sf_dir):
    value = F.expr("""case page_id % 3 when 0 then 'id ' || substr(md5(html), 1, 8) || '-' || substr(md5(html), 9, 4) || '-' || substr(md5(html), 13, 4) || '-' || substr(md5(html), 17, 4) || '-' || substr(md5(html), 21, 12) || ' at ' || url
        when 1 then '2024-01-0' || (page_id % 9 + 1) || if(page_id % 2 = 0, 'T', ' ') || '10:20:30' || case page_id % 4 when 0 then '.123' when 1 then '.5' else '' end
            || case page_id % 5 when 0 then 'Z' when 1 then 'z' when 2 then '+02:00' when 3 then '-11:30' else '' end else url end""")
    return read(spark, sf_dir, "pages").select("page_id", tx.mask(value, F.col("url")).alias("masked"))


@query(MASK + " SELECT masked, count(*) AS n FROM k GROUP BY masked")
def mask_stats(spark, sf_dir):
    return mask_text(spark, sf_dir).groupBy("masked").agg(F.count("*").alias("n"))


DIFF = """WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth FROM documents),
    b AS (SELECT doc_id, nth, CASE WHEN (doc_id + nth) % 11 = 0 THEN upper(v) ELSE v END AS v FROM a WHERE (doc_id + nth) % 7 <> 0 UNION ALL SELECT doc_id, 100000, 'x' FROM documents WHERE doc_id % 5 = 0),
    d AS (SELECT doc_id, CAST(nth AS BIGINT) AS nth, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'added' WHEN a.v <> b.v THEN 'changed' END AS kind FROM a FULL JOIN b USING (doc_id, nth))"""


@query(DIFF + " SELECT * FROM d WHERE kind IS NOT NULL")
def doc_diff(spark, sf_dir):
    """Lines of every document against a copy with lines left out, changed and added."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    whole = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "v")).withColumn("nth", F.col("nth").cast("bigint"))
    split = whole.where("(doc_id + nth) % 7 != 0").withColumn("v", F.when((F.col("doc_id") + F.col("nth")) % 11 == 0, F.upper("v")).otherwise(F.col("v")))
    split = split.unionByName(docs.where("doc_id % 5 = 0").select("doc_id", F.lit(100000).cast("bigint").alias("nth"), F.lit("x").alias("v")))
    return diffing.differences(whole, split, ["doc_id", "nth"], "v").select("doc_id", "nth", "kind")


@query(DIFF + """, r AS (SELECT kind, doc_id % 10 AS pattern, doc_id || ':' || nth AS example, row_number() OVER (PARTITION BY kind, doc_id % 10 ORDER BY doc_id, nth) AS k FROM d WHERE kind IS NOT NULL)
    SELECT kind, pattern, count(*) AS n, string_agg(example, '|' ORDER BY k) FILTER (k <= 3) AS examples FROM r GROUP BY kind, pattern""")
def diff_patterns(spark, sf_dir):
    found = doc_diff(spark, sf_dir).select("kind", (F.col("doc_id") % 10).alias("pattern"), "doc_id", "nth", F.concat_ws(":", "doc_id", "nth").alias("example"))
    return diffing.patterns(found, ["kind", "pattern"], ["doc_id", "nth"], "example")


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Application/Octet-Stream; x=1' WHEN 2 THEN 'application/json' ELSE 'text/plain' END AS kind, doc_id % 3 = 0 AS marked FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 4 < 2 AND marked THEN 'pdf' WHEN doc_id % 4 = 2 AND marked THEN 'base64' ELSE 'none' END AS source FROM s""")
def source_class(spark, sf_dir):
    kind = F.expr("case doc_id % 4 when 0 then 'application/pdf' when 1 then 'Application/Octet-Stream; x=1' when 2 then 'application/json' else 'text/plain' end")
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7\n").otherwise(""), F.col("text"))
    body = F.when(F.col("doc_id") % 4 == 2, F.concat(F.lit('{"base64Source":"'), F.base64(raw.cast("binary")), F.lit('"}'))).otherwise(raw)
    return read(spark, sf_dir, "documents").select("doc_id", blobs.source_class(kind, body.cast("binary")).alias("source"))


@query("""SELECT event_id, array_to_string(json_keys(props), ',') AS names, CAST(len(json_keys(props)) AS BIGINT) AS n, json_extract_string(props, '$.k') AS k FROM events""")
def json_members(spark, sf_dir):
    names = F.json_object_keys("props")
    return read(spark, sf_dir, "events").select("event_id", F.array_join(names, ",").alias("names"), F.size(names).cast("bigint").alias("n"), F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT event_type || '.' || (event_id % 7) AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 7 AS BIGINT) END AS page, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS rest, count(*) AS n FROM events GROUP BY ALL""")
def figure_ids(spark, sf_dir):
    spelled = F.concat(F.col("event_id") % 7, F.lit("."), F.col("user_id"))
    rows = read(spark, sf_dir, "events").select(F.concat("event_type", F.lit("."), F.col("event_id") % 7).alias("id"), tx.figure_id(spelled).alias("f"))
    return rows.groupBy("id", F.col("f.page").cast("bigint").alias("page"), F.col("f.rest").alias("rest")).agg(F.count("*").alias("n"))


@query("SELECT page_id, 'https://u:xxxxx@' || split_part(url, '://', 2) AS url, CASE WHEN length(url) > 30 THEN left(url, 30) || '…' ELSE url END AS shown FROM pages")
def url_redaction(spark, sf_dir):
    rest = F.substring_index("url", "://", -1)
    return read(spark, sf_dir, "pages").select("page_id", tx.redact_url(F.concat(F.lit("https://u:secret@"), rest)).alias("url"), tx.bounded(F.col("url"), 30).alias("shown"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'page' WHEN 1 THEN 'document' WHEN 2 THEN 'page' WHEN 3 THEN 'page' ELSE 'document' END AS level FROM documents""")
def path_levels(spark, sf_dir):
    keys = F.expr("case doc_id % 5 when 0 then array('pages', 'words') when 1 then array('tables', 'rowCount') when 2 then array('tables', 'cells', 'content') when 3 then array('paragraphs', 'boundingRegions') else array() end")
    return read(spark, sf_dir, "documents").select("doc_id", tx.level_of(keys.cast("array<string>")).alias("level"))
