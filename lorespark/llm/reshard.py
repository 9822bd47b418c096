"""Minimum-cost-flow resharding: block transfers that move the fewest bytes, then a rewrite of the affected files.

A shard is a value of ``shard_col``; its blocks are the hash values of ids modulo ``ranges``, so that no choice of ids makes
a block large. One aggregation gives the blocks' bytes; the driver solves a minimum-cost flow from old shard sizes to new
capacities, in which a byte that stays costs nothing and one that moves costs one. The flow says how many bytes each shard
sheds and receives. Blocks are whole, so each shedding shard gives the blocks of least bytes that cover its flow (subset
sums), and they go where the flow sends bytes, the largest first. If they do not fit that way, branch and bound looks for
the cheapest assignment of all blocks. Only shards that lose or gain a block are rewritten.

How good: while a shard has fewer than 2**18 bytes its cover is exact; beyond, sums are rounded, and it sheds at most
(blocks + 1) / 2**18 of its bytes too many. With :func:`even_capacity` the covers always fit. Branch and bound is exact;
it gives up after ``NODES`` nodes with the best plan it has.

Cases: null texts count 0 bytes and stay null; a null shard is the shard named ''; null ids form one block of their own
per shard. Ids may have any type. Repeated rows are kept, in one block. A document is never split, however long; one longer
than a shard's room stays where it fits. An empty table gives an empty result. Extra columns, whatever their names, are
rewritten unchanged; ties between blocks go to the lower block number. Capacities that cannot hold the data raise ValueError.
"""

from __future__ import annotations

import heapq
import sys
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import partitions_for, shared_dir, track

RANGES = 512  # most blocks of one shard
MOST_BROADCAST = 200_000  # moves of which every executor gets a copy; more are joined by a shuffle
FILE_BYTES = 32 << 20  # text bytes that a rewritten file holds, about
UNITS = 1 << 18  # steps into which a shard's bytes are divided for subset sums
NODES = 300_000


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], s: int, t: int) -> tuple[int, list[int]]:
    """Maximum flow of least cost by successive shortest paths. arcs: (from, to, capacity, cost >= 0). -> (cost, flow of each arc)."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, k, p in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y), cap.append(k), cost.append(p)
    high, total = [0] * n, 0
    while True:
        dist, via = [None] * n, [-1] * n
        dist[s], heap = 0, [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in out[u]:
                v = to[e]
                if cap[e] > 0 and (dist[v] is None or d + cost[e] + high[u] - high[v] < dist[v]):
                    dist[v], via[v] = d + cost[e] + high[u] - high[v], e
                    heapq.heappush(heap, (dist[v], v))
        if dist[t] is None:
            return total, [cap[2 * i + 1] for i in range(len(arcs))]
        far = max(d for d in dist if d is not None)
        high = [h + (far if d is None else d) for h, d in zip(high, dist)]
        push, v = None, t
        while v != s:
            push = cap[via[v]] if push is None else min(push, cap[via[v]])
            v = to[via[v] ^ 1]
        v = t
        while v != s:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            total += push * cost[via[v]]
            v = to[via[v] ^ 1]


def cover(blocks: dict[int, int], least: int, units: int = UNITS) -> list[int]:
    """Blocks of fewest bytes that hold ``least`` bytes or more, by subset sums over rounded sizes."""
    unit = max(1, -(-sum(blocks.values()) // units))
    some = sorted((b for b in blocks.items() if b[1] > 0), key=lambda b: (-b[1], b[0]))
    reach = [1]  # bit k: the first blocks can add up to k units
    for _, n in some:
        reach.append(reach[-1] | reach[-1] << (n // unit))
    want = -(-least // unit)
    high = reach[-1] >> want
    if not high:  # rounding down lost what all blocks together have
        return [b for b, _ in some]
    at, chosen = want + (high & -high).bit_length() - 1, []
    for i in range(len(some), 0, -1):
        if not reach[i - 1] >> at & 1:
            at -= some[i - 1][1] // unit
            chosen.append(some[i - 1])
    spare = sum(n for _, n in chosen) - least
    for b in sorted(chosen, key=lambda b: (-b[1], b[0])):
        if b[1] <= spare:
            spare -= b[1]
            chosen.remove(b)
    return sorted(b for b, _ in chosen)


def plan_transfers(sizes: dict[str, dict[int, int]], capacity: dict[str, int]) -> tuple[int, list[tuple[str, int, str]]]:
    """(bytes that any plan must move, moves (old shard, block, new shard)) from block sizes and new capacities.

    All moves pass one hub node, so the graph has as many arcs as shards, not as pairs of shards.
    """
    old, new = sorted(sizes), sorted(capacity)
    total = sum(sum(b.values()) for b in sizes.values())
    if total > sum(capacity.values()):
        raise ValueError(f"{total} bytes do not fit capacities of {sum(capacity.values())} bytes")
    s, hub, t = 0, 1, 2
    at_old, at_new = {x: 3 + i for i, x in enumerate(old)}, {x: 3 + len(old) + i for i, x in enumerate(new)}
    arcs, role = [], []
    for x in old:
        n = sum(sizes[x].values())
        arcs.append((s, at_old[x], n, 0)), role.append(None)
        if x in capacity:
            arcs.append((at_old[x], at_new[x], n, 0)), role.append(None)
        arcs.append((at_old[x], hub, n, 1)), role.append(("out", x))
    for x in new:
        arcs.append((hub, at_new[x], total, 0)), role.append(("in", x))
        arcs.append((at_new[x], t, capacity[x], 0)), role.append(None)
    least, flow = min_cost_flow(3 + len(old) + len(new), arcs, s, t)
    sent = {r: f for r, f in zip(role, flow) if r}
    gone = [(x, b) for x in old for b in (sorted(sizes[x]) if x not in capacity else cover(sizes[x], sent["out", x]) if sent["out", x] else [])]
    room = {x: capacity[x] - sum(n for b, n in sizes.get(x, {}).items() if (x, b) not in set(gone)) for x in new}
    moves = send(gone, sizes, room, {x: sent["in", x] for x in new})
    if moves is None:
        moves = search(sizes, capacity)
    return least, moves


def send(gone: list[tuple[str, int]], sizes: dict[str, dict[int, int]], room: dict[str, int], due: dict[str, int]) -> list[tuple[str, int, str]] | None:
    """A new shard for every block, the largest first: the one to which the flow has most bytes left to send, or else the roomiest. None: they do not fit."""
    moves, heap = [], [(-min(due[x], room[x]), -room[x], x) for x in room]
    heapq.heapify(heap)
    for x, b in sorted(gone, key=lambda g: (-sizes[g[0]][g[1]], g)):
        n = sizes[x][b]
        d, r, to = heap[0]
        if -r < n:
            to = max(room, key=lambda y: (room[y], y))
            if room[to] < n:
                return None
            heap.remove(next(h for h in heap if h[2] == to))
            heapq.heapify(heap)
        else:
            heapq.heappop(heap)
        room[to], due[to] = room[to] - n, due[to] - n
        moves.append((x, b, to))
        heapq.heappush(heap, (-min(max(due[to], 0), room[to]), -room[to], to))
    return moves


def search(sizes: dict[str, dict[int, int]], capacity: dict[str, int], nodes: int = NODES) -> list[tuple[str, int, str]]:
    """The cheapest assignment of whole blocks to shards by branch and bound, the largest blocks first."""
    blocks = sorted(((n, x, b) for x, own in sizes.items() for b, n in own.items()), key=lambda k: (-k[0], k[1], k[2]))
    rest = [0] * (len(blocks) + 1)
    for i in range(len(blocks), 0, -1):
        rest[i - 1] = rest[i] + blocks[i - 1][0]
    room, left, best = dict(capacity), [nodes], [float("inf"), None]
    place: list[str] = []
    before, most = sys.getrecursionlimit(), len(blocks) + 1000
    stay_left = {x: sum(own.values()) for x, own in sizes.items()}  # bytes of each old shard not yet placed

    def bound() -> int:
        return sum(max(0, n - room.get(x, 0)) for x, n in stay_left.items())

    def step(i: int, cost: int) -> None:
        left[0] -= 1
        if cost + bound() >= best[0] or (left[0] < 0 and best[1]) or left[0] < -nodes or rest[i] > sum(room.values()):
            return
        if i == len(blocks):
            best[:] = [cost, list(place)]
            return
        n, x, _ = blocks[i]
        stay_left[x] -= n
        tried = set()
        for to in sorted(room, key=lambda y: (y != x, -room[y], y)):
            if room[to] < n or (to not in sizes and room[to] in tried):
                continue  # empty shards of equal room are alike
            tried |= {room[to]} if to not in sizes else set()
            room[to] -= n
            place.append(to)
            step(i + 1, cost + (n if to != x else 0))
            place.pop()
            room[to] += n
        stay_left[x] += n

    sys.setrecursionlimit(max(before, most))
    try:
        step(0, 0)
    finally:
        sys.setrecursionlimit(before)
    if best[1] is None:
        raise ValueError("no assignment of whole blocks to these capacities was found")
    return [(x, b, to) for (_, x, b), to in zip(blocks, best[1]) if to != x]


def block_sizes(docs: DataFrame, shard_col: str = "source", id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES) -> dict[str, dict[int, int]]:
    """Bytes by shard and block: the one aggregation over the whole table."""
    got = docs.groupBy(*_place(shard_col, id_col, ranges)).agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0))).cast("long").alias("n"))
    sizes: dict[str, dict[int, int]] = {}
    for r in got.collect():  # a row per block: at most ``ranges`` + 1 a shard
        sizes.setdefault(r["shard_"], {})[r["block_"]] = r["n"]
    return sizes


def _place(shard_col: str, id_col: str, ranges: int) -> list:
    key = F.col(f"`{id_col}`")
    return [F.coalesce(F.col(f"`{shard_col}`").cast("string"), F.lit("")).alias("shard_"), F.when(key.isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(ranges))).cast("long").alias("block_")]


def even_capacity(sizes: dict[str, dict[int, int]], shards: int, slack: float = 0.1) -> dict[str, int]:
    """Equal capacities for ``shards`` shards: the old names in order, then new ones; ``slack`` of free room."""
    total = sum(sum(b.values()) for b in sizes.values())
    biggest = max((n for b in sizes.values() for n in b.values()), default=0)
    names = sorted(sizes)[:shards]
    names += [f"shard-{i:05d}" for i in range(shards - len(names))]
    return dict.fromkeys(names, max(int(total * (1 + slack) / shards), -(-total // shards) + biggest))


def reshard(docs: DataFrame, shards: int, shard_col: str = "source", id_col: str = "doc_id", text_col: str = "text", slack: float = 0.1, out_dir: str | None = None, ranges: int = RANGES) -> tuple[DataFrame, dict]:
    """Rewrites the affected shards under ``out_dir`` (Parquet, one folder a shard) and returns every document's place, with the plan's figures."""
    spark = docs.sparkSession
    sizes = block_sizes(docs, shard_col, id_col, text_col, ranges)
    least, moves = plan_transfers(sizes, even_capacity(sizes, shards, slack))
    touched = sorted({m[0] for m in moves} | {m[2] for m in moves})
    moved = sum(sizes[a][b] for a, b, _ in moves)
    out_dir = out_dir or track(spark, f"{shared_dir(spark)}/reshard-{uuid.uuid4().hex}")
    to = spark.createDataFrame(moves, "from_ string, moved_ long, to_ string")
    if len(moves) <= MOST_BROADCAST:
        to = F.broadcast(to)  # else the texts are shuffled to the moves
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_place(shard_col, id_col, ranges))
    hit = row.join(to, (F.col("shard_") == F.col("from_")) & (F.col("block_") == F.col("moved_")), "left")
    placed = hit.select("row", "shard_", "block_", F.coalesce("to_", "shard_").alias("new_"))
    affected = placed.filter(F.col("new_").isin(touched)) if touched else placed.filter(F.lit(False))
    after = {x: sum(b.values()) for x, b in sizes.items()}
    for a, b, x in moves:
        after[a], after[x] = after[a] - sizes[a][b], after.get(x, 0) + sizes[a][b]
    files = max(1, -(-max((after[x] for x in touched), default=0) // FILE_BYTES))
    parts = partitions_for(spark, sum(after[x] for x in touched))
    affected = affected.repartition(parts, "new_", F.pmod("block_", F.lit(files)))  # a few whole files a shard, however many tasks
    affected.write.partitionBy("new_").parquet(out_dir)
    done = spark.read.schema(affected.schema).parquet(out_dir).withColumn("new_", F.coalesce("new_", F.lit("")))  # '' is written as Hive's default partition
    place = lambda d, rewritten: d.select(
        F.col("row")[id_col].alias("doc_id"), F.col("shard_").alias("old_shard"), F.col("new_").alias("new_shard"), (F.col("shard_") != F.col("new_")).alias("moved"), F.lit(rewritten).alias("rewritten")
    )
    kept = row.filter(~F.col("shard_").isin(touched) if touched else F.lit(True)).withColumn("new_", F.col("shard_"))
    return place(done, True).unionByName(place(kept, False)), {"least_bytes": least, "moved_bytes": moved, "moves": len(moves), "rewritten": touched, "out_dir": out_dir}
