"""Problem 7: filling fixed-capacity containers, by hierarchical residual packing.

Items longer than the capacity are cut into full pieces and a rest; all others
stay whole. Each partition packs its items best-fit, largest first, and emits
the bins that are nearly full. The underfull ones go on as items of their own
into fewer partitions (a merge tree of a given fan-in) and are packed again,
largest first, until one bounded partition is left or nothing merges any more.
A partition holds at most ``partition_items`` items in every round, so a round
over any number of items is a round of many equal tasks, whatever source or
job they come from.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut

BIN = "container_name string, capacity long, used long, members array<struct<id:bigint,part_no:int,tokens:bigint>>"


def best_fit(items: list[tuple[int, int, int]], capacity: int, most: int) -> list[tuple[int, list[int]]]:
    """Packs (size, index, members) items, largest first, each into the fullest bin it fits; (used, indexes) a bin.

    A bin of ``most`` members or more takes no further item, so items of no
    size can't pile up in one bin.
    """
    rooms: list[tuple[int, int]] = []  # (room left, bin), rising
    used: list[int] = []
    inside: list[list[int]] = []
    members: list[int] = []
    for size, i, n in sorted(items, key=lambda x: (-x[0], x[1])):
        at = bisect_left(rooms, (size, -1))
        if at == len(rooms):
            used.append(0)
            inside.append([])
            members.append(0)
            b = len(used) - 1
        else:
            _, b = rooms.pop(at)
        used[b] += size
        inside[b].append(i)
        members[b] += n
        if members[b] < most:
            insort(rooms, (capacity - used[b], b))
    return list(zip(used, inside))


#: A bin is closed at so many members, however full it is.
MAX_MEMBERS = 16_384
#: More container kinds than this are refused: every item is packed once for each.
MAX_KINDS = 1_000


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple[str, int], list[tuple[int, list]]] = {}
    for frame in frames:
        for name, capacity, used, members in frame[["container_name", "capacity", "used", "members"]].itertuples(index=False):
            held.setdefault((name, capacity), []).append((used, list(members)))
    for (name, capacity), items in held.items():
        bins = best_fit([(used, i, len(members)) for i, (used, members) in enumerate(items)], capacity, MAX_MEMBERS)
        for k in range(0, len(bins), 5000):
            yield pd.DataFrame({"container_name": name, "capacity": capacity, "used": [u for u, _ in bins[k : k + 5000]], "members": [[m for i in ids for m in items[i][1]] for _, ids in bins[k : k + 5000]]})


def pack(items: DataFrame, containers: DataFrame, key: str, tokens: str, full: float = 0.98, partition_items: int = 50_000, fan_in: int = 8) -> DataFrame:
    """(container_name, capacity, bin_id, key, part_no, tokens): every item's place in a bin of each container kind.

    ``items`` has ``key`` (bigint, not null) and ``tokens``; ``containers`` has
    container_name and capacity_tokens (kinds with a null or no positive
    capacity hold nothing; repeated kinds count once). Items longer than the
    capacity come in parts numbered from 0; items of no tokens lie in some bin
    and take no room, at most MAX_MEMBERS items a bin; null sizes count as 0. ``bin_id`` is built from the
    bin's first member, so it is stable for a given placement.
    """
    kinds = containers.where("container_name is not null and capacity_tokens > 0").groupBy("container_name").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    known = kinds.limit(MAX_KINDS + 1).collect()
    if len(known) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} container kinds")
    sized = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("tokens"))
    of_kind = F.array(*(F.struct(F.lit(k["container_name"]).alias("container_name"), F.lit(k["capacity"]).cast("long").alias("capacity")) for k in known)) if known else F.expr("cast(array() as array<struct<container_name:string,capacity:bigint>>)")
    each = sized.select("id", "tokens", F.explode(of_kind).alias("kind")).select("kind.container_name", "kind.capacity", "id", "tokens")
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")))
    parts = each.withColumn("part_no", F.explode(F.sequence(F.lit(0), n_parts.cast("int") - 1)))
    parts = parts.withColumn("size", F.least(F.col("capacity"), F.col("tokens") - F.col("part_no") * F.col("capacity")))
    whole = parts.select("container_name", "capacity", F.col("size").alias("used"), F.array(F.struct(F.col("id"), F.col("part_no"), F.col("size").alias("tokens"))).alias("members"))
    # pieces that fill a bin alone are done; the rest is packed
    done = whole.where("used >= capacity")
    left = whole.where("used < capacity")
    closed: list[DataFrame] = [done]
    count, most, width = None, None, 0
    while True:
        if count is None:
            left = cut(left)
            count = left.count()
        n = max(1, math.ceil(count / partition_items))
        if most is not None:  # the merge tree: fewer partitions by the fan-in, unless that would overfill them
            n = max(n, math.ceil(most / fan_in))
        width = n
        spread = left.repartition(width, F.xxhash64(F.col("members")[0]["id"], F.col("members")[0]["part_no"], F.size("members"))) if width > 1 else left.coalesce(1)
        packed = cut(spread.mapInPandas(_pack, BIN))
        if width == 1:
            closed.append(packed)
            break
        closed.append(packed.where(F.col("used") >= full * F.col("capacity")))
        left = packed.where(F.col("used") < full * F.col("capacity"))
        before, count = count, left.count()
        if count == 0:
            break
        if count > 0.98 * before and most is not None and n >= most:  # nothing merges any more
            closed.append(left)
            break
        most = n
    bins = closed[0]
    for more in closed[1:]:
        bins = bins.unionByName(more)
    first = F.col("members")[0]
    named = bins.withColumn("bin_id", F.concat_ws("-", first["id"].cast("string"), first["part_no"].cast("string")))
    out = named.select("container_name", "capacity", "bin_id", F.explode("members").alias("m"))
    return out.select("container_name", "capacity", "bin_id", F.col("m.id").alias(key), F.col("m.part_no").alias("part_no"), F.col("m.tokens").alias("tokens"))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per container kind: bins, tokens, and the share of the room that is used."""
    bins = packed.groupBy("container_name", "capacity", "bin_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"))
    return bins.groupBy("container_name", "capacity").agg(
        F.count("*").alias("bins"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * F.col("capacity")), 6).alias("fill"),
    )
