"""N-gram Jaccard self-join by T-occurrence search.

Sets of word shingles are reduced to classes of equal sets.  A class's tokens have one global order: tokens that
many texts share last, else by hash.  Two sets that link share at least so many of the tokens of their ordered
prefixes, so a class whose prefix is not shared enough has no link and leaves.  Each shared prefix token has a hub,
the class whose prefix is shared most; the classes that meet at a hub make a block, and every two linked sets meet in
one.  In a block the whole sets are searched by DivideSkip (tsearch.block_links), which gives links that span its
components.  Blocks beyond a fixed number of tokens are cut into parts that are searched against the hub first; the
classes it leaves unlinked are then searched in all pairs of parts, so no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.llm.common import discard, hot_keys, pieces, salted_join, spot_of, spots, spotted, stored, table, text_or_empty
from pagefold.llm.components import components
from pagefold.llm.tsearch import block_links
from pagefold.llm.wordhash import NOT_SPACE, Powers, mix, words

#: Counters of the token census: its result is one bit for each, whatever the input's size.
COUNTERS = 1 << 18
#: Counters in one row of what a task counts.
ROW_COUNTERS = 1 << 9
#: A counter this many times over the mean marks its tokens as common.
COMMON = 4
#: Tokens in one part of a block: what a task holds at once.
BLOCK_TOKENS = 1_500_000


def windows(texts: pa.Array, n: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text and the end, word hashes, hashes of the n words from each word on)."""
    first, _, _, hashes = words(texts, NOT_SPACE, powers)
    out = np.zeros(len(hashes), np.uint64)
    factor = np.uint64(0x9FB21C651E98DF25)
    for k in range(min(n, len(hashes))):
        out *= factor
        out[: len(hashes) - k] += hashes[k:]
    return first, hashes, mix(out)


def shingles(texts: pa.Array, n: int, powers: Powers):
    """For each text its distinct shingle hashes, sorted."""
    first, hashes, out = windows(texts, n, powers)
    count = np.diff(first)
    for i, (begin, c) in enumerate(zip(first[:-1].tolist(), count.tolist(), strict=True)):
        if c >= n:
            found = np.sort(out[begin : begin + c - n + 1])
            twice = found[1:] == found[:-1]
            yield found[np.r_[True, ~twice]] if twice.any() else found
        elif c:
            short = int.from_bytes(hashlib.blake2b(hashes[begin : begin + c].tobytes(), digest_size=8).digest(), "little")
            yield np.array([short], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def prefix_rules(size: int, percent: int) -> tuple[int, int]:
    """(prefix length, tokens of it that must be shared with one other set) for a set of this size.

    With prefixes of size - least + extra(size) tokens, two linked sets share at least the smaller one's extra; a
    partner's size is at least percent of this one's.
    """
    extra = lambda s: max(1, s // 20)
    least = -(-percent * size // 100)
    return min(size, size - least + extra(size)), extra(least)


def census(texts: DataFrame, n: int) -> np.ndarray:
    """Which counters hold common tokens, over all texts of n words or more; at most COUNTERS rows reach the driver.

    A task gives its counters in rows of ROW_COUNTERS each, which are added up by their place.
    """

    def run(batches):
        powers, total = Powers(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for b in pieces(batch, 0):
                first, _, hashes = windows(b.column(0), n, powers)
                whole = np.arange(len(hashes)) + n <= np.repeat(first[1:], np.diff(first))
                total += np.bincount((hashes[whole] >> np.uint64(46)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            rows = total.reshape(-1, ROW_COUNTERS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["row", "counters"])

    def added(frame):
        total = sum(np.frombuffer(r, np.int64) for r in frame["counters"])
        at = np.flatnonzero(total)
        return pd.DataFrame({"c": frame["row"].iloc[0] * ROW_COUNTERS + at, "n": total[at]})

    counted = texts.mapInArrow(run, "row bigint, counters binary").groupBy("row").applyInPandas(added, "c bigint, n bigint")
    counts = stored(counted, "census")
    mean = counts.agg(F.sum("n") / COUNTERS).first()[0] or 0
    marks = np.zeros(COUNTERS, bool)
    for r in counts.where(F.col("n") > COMMON * mean + 16).collect():
        marks[r["c"]] = True
    return marks


def ordered(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    flag = common[(tokens >> np.uint64(46)).astype(np.int64)]
    return np.concatenate([tokens[~flag], tokens[flag]])


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def node_of(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "big", signed=True)


def sets_of(rows: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """(id, text_hash, size, sig, node, prefix) of (id, text_hash, text); sig and node name the set, null for an empty one."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        powers = Powers()
        for batch in batches:
            for b in pieces(batch, 2):
                sizes, sigs, prefixes = [], [], []
                for s in shingles(b.column(2), n, powers):
                    sizes.append(len(s))
                    sigs.append(signature(s) if len(s) else None)
                    prefixes.append(ordered(s, common)[: prefix_rules(len(s), percent)[0]].view(np.int64))
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                nodes = [s and node_of(s) for s in sigs]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                    ["id", "text_hash", "size", "sig", "node", "prefix"],
                )

    return rows.mapInArrow(run, f"id {kind}, text_hash bigint, size bigint, sig binary, node bigint, prefix array<bigint>")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, text): a row is told by its id and its text, as an id may repeat."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text"))


def linked(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, block_tokens: int) -> tuple[DataFrame, DataFrame, list]:
    """(rows, named, hot): rows (id, text_hash, size, node); named (named_node, component, component_id), one for each
    node of rows; hot: the nodes that many equal texts have.

    component_id is the smallest id of the component's rows, a null one only where there is no other.
    """
    rows = identified(docs, id_col, text_col)
    common = census(rows.select("text"), n)
    sets = stored(sets_of(rows, n, percent, common), "sets")

    # One class for each set; partial aggregates meet a large group of copies before the shuffle.
    grouped = sets.where("sig is not null").groupBy("sig")
    reps = grouped.agg(F.first("node").alias("node"), F.min("id").alias("rep"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.count("*").alias("copies"))
    reps = stored(reps, "classes")
    hot = hot_keys(reps.select("node", "copies"), "node", "copies")
    found = components(candidate_links(rows, reps, n, percent, block_tokens))
    named = reps.select("node", "rep").join(found.withColumnRenamed("node", "linked_node").hint("merge"), F.col("node") == F.col("linked_node"), "left")
    named = stored(named.select("node", "rep", F.coalesce("component", "node").alias("component")), "named")
    least = named.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    wide = hot_keys(least.select("of", "n"), "of", "n")
    named = salted_join(named, least.drop("n"), "component", "of", "node", wide).select(F.col("node").alias("named_node"), "component", "component_id")
    return sets.select("id", "text_hash", "size", "node"), named, hot


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, n_shingles, component_id): one row for each input row.

    A set is a text's distinct n-word shingles; with fewer words, the whole sequence is one.  Sets link when
    100 * intersection >= percent * union.  Null and empty texts, and texts without words, have no shingles and link
    with nothing: their component is their own id.  Ids are of any type with an order; rows that repeat an id keep one
    row each, with the component of their own text; a null id is never a component's smallest while others are in it.
    Other columns are not read.
    """
    rows, named, hot = linked(docs, id_col, text_col, n, percent, block_tokens)
    out = salted_join(rows, named, "node", "named_node", "id", hot, "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def candidate_links(rows: DataFrame, reps: DataFrame, n: int, percent: int, block_tokens: int) -> DataFrame:
    """(a, b): links between class nodes that span the components of all links.

    All joins are of sides that grow with the corpus: they are shuffled, and the rows of a token, hub or node that many
    classes share are dealt to many tasks.  Where the right side is a few numbers a key, and far smaller than the left
    one, it is hashed in its task, which saves the sort of the left one.
    """
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("size") * percent / 100) / 20)).cast("long")
    postings = reps.select("node", "size", F.size("prefix").alias("width"), F.explode("prefix").alias("token"))
    counts = stored(postings.groupBy(F.col("token").alias("key")).agg(F.count("*").alias("n")).where("n > 1"), "token-counts")
    hot = hot_keys(counts)
    left = stored(salted_join(postings, counts.select("key"), "token", "key", "node", hot, hint="shuffle_hash").drop("key"), "postings")
    discard(counts)
    # How much of a class's prefix is shared decides whether it can link at all, and who is the hub.  Tokens that only
    # one able class is left with no longer count.
    weight = left.groupBy("node").agg(F.count("*").alias("held"), F.first("size").alias("size"), F.first("width").alias("width"))
    able = weight.where(F.col("held") >= need).select(F.col("node").alias("able"), (F.col("width") - F.col("held")).alias("alone"))
    kept = left.join(able.hint("shuffle_hash"), F.col("node") == F.col("able"))
    hubs = kept.groupBy(F.col("token").alias("hub_token")).agg(F.min(F.struct("alone", "node"))["node"].alias("hub"), F.count("*").alias("df")).where("df > 1")
    kept = stored(salted_join(kept, hubs, "token", "hub_token", "node", hot, hint="shuffle_hash").select("node", "size", "hub"), "kept")
    discard(left)
    # Two linked classes share `need` tokens or more under at most as many hubs as either of them has, so they meet at
    # one hub that has at least this share of both.
    met = kept.groupBy("hub", "node").agg(F.first("size").alias("size"), F.count("*").alias("meets"))
    met = met.withColumn("hubs", F.count("*").over(Window.partitionBy("node"))).where(F.col("meets") * F.col("hubs") >= need)
    met = stored(met.select("hub", "node", "size"), "met")
    room = stored(met.groupBy(F.col("hub").alias("room_hub")).agg(F.sum("size").alias("tokens"), F.count("*").alias("classes")).where("classes > 1"), "rooms")
    parts = F.ceil(F.col("tokens") / block_tokens).cast("long")
    placed = salted_join(met, room, "hub", "room_hub", "node", hot_keys(room.select("room_hub", "classes"), "room_hub", "classes"))
    placed = stored(placed.select("hub", "node", "size", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("nth")), "placed")
    discard(kept, met, room)
    tokens = token_sets(rows, reps.join(placed.select("node").distinct().hint("merge"), "node", "left_semi").select("rep"), n)

    # First in each part, with the hub in every part of its block.
    here = F.when(F.col("hub") == F.col("node"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("nth"))
    own = placed.select("hub", "node", F.explode(here).alias("nth"))
    own = own.select(F.xxhash64("hub", "nth").alias("part"), (F.col("node") != F.col("hub")).cast("int").alias("place"), "node")
    first = stored(searched(own, tokens, percent, asked=False), "links")

    # In blocks of several parts, the classes outside their hub's component ask the members of all parts.
    wide = placed.where("parts > 1")
    if wide.isEmpty():
        discard(placed, tokens)
        return first
    found = stored(components(first), "components")
    large = hot_keys(wide.groupBy("hub").agg(F.count("*").alias("n")), "hub")
    wide = wide.join(found.select(F.col("node").alias("n1"), F.col("component").alias("c1")).hint("merge"), F.col("node") == F.col("n1"), "left")
    wide = salted_join(wide, found.select(F.col("node").alias("n2"), F.col("component").alias("c2")), "hub", "n2", "node", large, "left")
    apart = F.coalesce("c1", "node") != F.coalesce("c2", "hub")
    wide = stored(wide.select("hub", "node", "size", "parts", "nth", apart.alias("apart")), "wide")
    chunks = wide.where("apart").groupBy(F.col("hub").alias("open_hub")).agg(F.ceil(F.sum("size") / block_tokens).cast("long").alias("chunks"))
    wide = salted_join(wide, chunks, "hub", "open_hub", "node", large)
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    heard = wide.select("hub", "node", F.lit(1).alias("place"), "nth", upto("chunks").alias("chunk"))
    asking = wide.where("apart").select("hub", "node", F.lit(0).alias("place"), upto("parts").alias("nth"), F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).alias("chunk"))
    crossed = heard.unionByName(asking).groupBy("hub", "chunk", "nth", "node").agg(F.min("place").alias("place"))
    crossed = crossed.select(F.xxhash64("hub", "chunk", "nth", F.lit("ask")).alias("part"), "place", "node")
    return stored(first.unionByName(searched(crossed, tokens, percent, asked=True)), "links")


def token_sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(token_node, tokens): the sets of the texts whose ids are wanted, and of some others at large sizes.

    The wanted ids reach the tasks as bits of a fixed number, so no text is shuffled to find them.
    """
    bits = spots(wanted, "rep")

    def run(batches):
        powers = Powers()
        for batch in batches:
            batch = batch.filter(pa.array(spotted(bits, batch.column(1).to_numpy())))
            for b in pieces(batch, 0):
                sets = [s for s in shingles(b.column(0), n, powers) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(signature(s)) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["token_node", "tokens"])

    chosen = rows.select("text", spot_of("id").alias("spot"))
    return stored(chosen.mapInArrow(run, "token_node bigint, tokens binary").dropDuplicates(["token_node"]), "tokens")


def searched(placed: DataFrame, tokens: DataFrame, percent: int, asked: bool) -> DataFrame:
    """(a, b) links of (part, place, node): one search for each part, whose rows come in order of place.

    A part's tokens are at most about BLOCK_TOKENS for the members and as many for those that ask.
    """
    members = placed.join(tokens.hint("merge"), F.col("node") == F.col("token_node")).select("part", "place", "node", "tokens")
    members = members.repartition("part").sortWithinPartitions("part", "place", "node")

    def links(rows):
        sets = [np.frombuffer(t, np.uint64) for _, _, t in rows]
        for i, j in block_links(sets, percent, [place == 0 for place, _, _ in rows] if asked else None) if len(rows) > 1 else ():
            yield rows[i][1], rows[j][1]

    def run(batches):
        now, rows = None, []
        for b in batches:
            out = []
            for part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    out += links(rows)
                    now, rows = part, []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
        if out := list(links(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return members.mapInArrow(run, "a bigint, b bigint")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs with one row of each group of linked texts: the smallest id's, a null id only where there is no other.

    Rows, not ids, are grouped: an id that repeats with texts that do not link keeps a row of each.  Rows without
    words link with nothing and all stay, repeated ones too.  Rows of groups of one are told by bits of a fixed number
    and are never shuffled.
    """
    rows, named, hot = linked(docs, id_col, text_col, n, percent, block_tokens)
    assigned = stored(salted_join(rows.where("node is not null"), named, "node", "named_node", "id", hot).select("id", "text_hash", "component"), "assigned")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    groups = stored(assigned.groupBy(F.col("component").alias("of")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    grouped = salted_join(assigned, groups, "component", "of", "id", hot_keys(groups.select("of", "n"), "of", "n"))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    grouped = stored(grouped.select(F.col("id").alias("__id"), F.col("text_hash").alias("__text_hash"), stays.alias("__stays")).distinct(), "grouped")
    bits = spots(grouped, "__id", "__text_hash")

    names, at = docs.columns, len(docs.columns)
    keyed = docs.withColumn("__hash", F.xxhash64(text_or_empty(text_col))).withColumn("__spot", spot_of(F.col(id_col), F.col("__hash")))

    def where(wanted: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(spotted(bits, b.column(at + 1).to_numpy()) == wanted))

        return keyed.mapInArrow(run, keyed.schema)

    met = where(True).join(grouped.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text_hash")), "left")
    met = met.where(F.coalesce("__stays", F.lit(True))).withColumn("__row", F.when(F.col("__stays"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return where(False).select(names).unionByName(met.dropDuplicates([id_col, "__hash", "__row"]).select(names))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), n=4, percent=85)


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
