"""The order-preserving union of member lists."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keeps(order: list[str], given: list[str]) -> bool:
    place = {n: i for i, n in enumerate(order)}
    return all(place[a] < place[b] for a, b in zip(given, given[1:], strict=False))


def union(lists: list[list[str]]) -> list[str] | None:
    """All names in an order that every list keeps; None where the lists contradict each other.

    A name that is new goes behind its predecessor.  Where that breaks a list, the names are sorted by the lists'
    neighbours instead, the earliest in the order so built whenever there is a choice.
    """
    order: list[str] = []
    for given in lists:
        at = 0
        for name in given:
            if name not in order:
                order.insert(at, name)
            at = order.index(name) + 1
    if all(keeps(order, given) for given in lists):
        return order
    seen = {n: i for i, n in enumerate(order)}
    behind: dict[str, set[str]] = {n: set() for n in seen}
    for given in lists:
        for a, b in zip(given, given[1:], strict=False):
            behind[a].add(b)
    waits = {n: sum(n in x for x in behind.values()) for n in seen}
    ready, out = [(seen[n], n) for n, w in waits.items() if not w], []
    heapq.heapify(ready)
    while ready:
        _, name = heapq.heappop(ready)
        out.append(name)
        for b in behind[name]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, (seen[b], b))
    return out if len(out) == len(seen) else None


def member_orders(members: DataFrame, doc: str, part: str, at: str, name: str) -> DataFrame:
    """(doc, names): the merged member order of each document's parts; null where they contradict (V14).

    Spark gathers each document's distinct lists of names; the few that a corpus has are united once in a task each.
    """
    lists = members.groupBy(doc, part).agg(F.array_sort(F.collect_list(F.struct(at, name))).alias("own"))
    lists = lists.select(doc, part, F.transform("own", lambda m: m[name]).alias("own"))
    whole = lists.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(part, "own"))).alias("lists"))
    whole = whole.select(F.col(doc).alias("doc"), F.array_distinct(F.transform("lists", lambda p: p["own"])).alias("lists"))

    def run(batches):
        known: dict = {}
        for b in batches:
            told = []
            for given in b.column(1).to_pylist():
                key = tuple(map(tuple, given))
                if key not in known:
                    known[key] = union(given)
                told.append(known[key])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, pa.list_(pa.string()))], ["doc", "names"])

    kind = members.schema[doc].dataType.simpleString()
    return whole.mapInArrow(run, f"doc {kind}, names array<string>").withColumnRenamed("doc", doc)
