"""Items of varying length put into containers of fixed capacity by a grouping genetic algorithm on islands.

Items are hashed to shards of about SHARD_CONTAINERS containers. For each shard some islands breed packings of their own:
a child gets whole well-filled containers of one parent, loses the other's containers that hold the same items, and what
falls out is put back by best fit. Between epochs the best packing of each island moves to the next one. What ends in
ill-filled containers is taken out of all shards, hashed anew and packed again, so that what shards leave over is shared,
until what is left of a budget is one shard. The first packing of an island is best fit from the largest item down; a
shard in which that needs no more containers than there can be at least is done, and the others are bred.
"""

from __future__ import annotations

import base64
import itertools
import random
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilespark.llm.common import spread
from profilespark.session import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer of that file cuts text before it merges bytes (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SHARD_CONTAINERS = 128
#: Islands of a shard, times they breed with a migration between, generations each time, and packings on an island.
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 3, 8, 8
#: Containers filled less than this share of the capacity are taken apart for the next round.
WELL_FILLED = 0.999
#: Budgets are few and fixed; more are refused.
MOST_BUDGETS = 1000

Packing = list[list[int]]  # containers, each a list of item numbers


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens: one row per document; null and empty texts have 0 tokens; copies of a row count once.

    The tokenizer's file is sent to the executors, which need no copy of it.
    """

    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = Path(tokenizer).name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(SparkFiles.get(name), "rb"))}
        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts})

    source = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL"), "doc_id")
    return source.mapInPandas(run, "doc_id long, n_tokens long").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


@dataclass(frozen=True)
class Breeding:
    islands: int = ISLANDS
    epochs: int = EPOCHS
    generations: int = GENERATIONS
    population: int = POPULATION


class Open:
    """Containers that still have room, found by best fit: the least room that is enough."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: Packing = []
        self.room: list[int] = []
        self.order: list[tuple[int, int]] = []

    def add(self, items: list[int], fill: int) -> None:
        self.bins.append(items)
        self.room.append(self.capacity - fill)
        insort(self.order, (self.capacity - fill, len(self.bins) - 1))

    def put(self, item: int, size: int) -> None:
        k = bisect_left(self.order, (size, -1))
        if k == len(self.order):
            self.add([item], size)
            return
        room, b = self.order.pop(k)
        self.bins[b].append(item)
        self.room[b] = room - size
        insort(self.order, (room - size, b))


def best_fit(sizes: list[int], capacity: int, order: list[int], bins: Packing = ()) -> Packing:
    """Items put in the given order into the containers given and new ones."""
    at = Open(capacity)
    for b in bins:
        at.add(list(b), sum(sizes[i] for i in b))
    for i in order:
        at.put(i, sizes[i])
    return at.bins


def fitness(p: Packing, sizes: list[int], capacity: int) -> float:
    """Few containers first, then uneven fills, which leave room that can still be used."""
    fills = [sum(sizes[i] for i in b) / capacity for b in p]
    return -len(p) + sum(f * f for f in fills) / max(1, len(p))


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, r: random.Random) -> Packing:
    """Well-filled containers of b go whole into a; a's containers with the same items are taken apart."""
    good = [x for x in b if sum(sizes[i] for i in x) >= WELL_FILLED * capacity] or b
    k = r.randint(1, max(1, len(good) // 2))
    at = r.randrange(len(good))
    injected = [good[(at + j) % len(good)] for j in range(min(k, len(good)))]
    have = {i for x in injected for i in x}
    kept, loose = [], []
    for x in a:
        if have.isdisjoint(x):
            kept.append(x)
        else:
            loose += [i for i in x if i not in have]
    if kept and r.random() < 0.7:  # mutation: the worst of what is kept is taken apart too
        kept.sort(key=lambda x: sum(sizes[i] for i in x))
        for _ in range(min(len(kept), r.randint(1, 3))):
            loose += kept.pop(0)
    loose.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, capacity, loose, [*injected, *kept])


def evolve(sizes: list[int], capacity: int, elites: list[Packing], seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[Packing]:
    """Best packings first. Ends early where the number of containers is the least possible."""
    n = len(sizes)
    if not n:
        return [[]]
    r = random.Random(seed)
    least = max(1, -(-sum(sizes) // capacity))
    scored = [(fitness(p, sizes, capacity), p) for p in elites]
    down = sorted(range(n), key=lambda i: -sizes[i])

    def add(p: Packing) -> bool:
        scored.append((fitness(p, sizes, capacity), p))
        return len(p) == least

    if not scored and add(best_fit(sizes, capacity, down)):
        return [scored[-1][1]]
    while len(scored) < population:
        noise = r.uniform(0.02, 0.3)
        if add(best_fit(sizes, capacity, sorted(range(n), key=lambda i: -sizes[i] * r.uniform(1 - noise, 1)))):
            return [scored[-1][1]]
    for _ in range(generations):
        scored.sort(key=lambda x: -x[0])
        del scored[population:]
        parents = [p for _, p in scored]
        for _ in range(population - 1):
            a, b = (min(r.sample(range(len(parents)), 2)) for _ in range(2))
            if add(cross(parents[a], parents[b] if a != b else parents[-1], sizes, capacity, r)):
                return [scored[-1][1]]
    scored.sort(key=lambda x: -x[0])
    return [p for _, p in scored]


def _coded(p: Packing, n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(p):
        out[b] = k
    return out.tobytes()


def _decoded(b: bytes) -> Packing:
    if not b:
        return []
    of = np.frombuffer(b, np.int32)
    out: Packing = [[] for _ in range(int(of.max()) + 1)]
    for i, k in enumerate(of.tolist()):
        out[k].append(i)
    return [x for x in out if x]


_STATE = "budget_id int, shard long, island int, capacity long, items binary, best binary, guest binary, done boolean, score double"


def _epoch(epoch: int, how: Breeding):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.itertuples(index=False):
                sizes = np.frombuffer(x.items, np.int64).tolist()
                elites = [_decoded(e) for e in (x.best, x.guest) if e]
                if not x.done:
                    seed = (int(x.budget_id) * 1_000_003 + int(x.shard)) * 31 + int(x.island) * 7 + epoch
                    elites = evolve(sizes, int(x.capacity), elites, seed, how.generations, how.population)
                best = elites[0]
                done = len(best) <= max(1, -(-sum(sizes) // int(x.capacity)))
                rows.append((x.budget_id, x.shard, x.island, x.capacity, x.items, _coded(best, len(sizes)), b"", done, fitness(best, sizes, int(x.capacity))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _STATE.split(", ")])

    return run


@F.pandas_udf(T.BinaryType())
def _pack_longs(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda a: np.asarray(a, np.int64).tobytes())


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _unpack_ints(b: pd.Series) -> pd.Series:
    return b.map(lambda x: np.frombuffer(x, np.int32).tolist())


def _packed_round(items: DataFrame, scratch: Scratch, number: int, how: Breeding) -> DataFrame:
    """One round over items (budget_id, capacity, shard, doc_id, piece_no, size): the items with bin and bin_fill."""
    entry = F.struct(F.col("size"), F.col("doc_id"), F.col("piece_no"))
    shards = items.groupBy("budget_id", "capacity", "shard").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    shards = scratch.write(shards)
    spark = items.sparkSession
    cores = spark.sparkContext.defaultParallelism
    state = shards.select(
        "budget_id", "shard", F.explode(F.array(*[F.lit(i) for i in range(how.islands)])).alias("island"), "capacity", _pack_longs(F.col("entries.size")).alias("items"),
        F.lit(b"").alias("best"), F.lit(b"").alias("guest"), F.lit(False).alias("done"), F.lit(0.0).alias("score"),
    ).repartition(4 * cores, "budget_id", "shard", "island")
    for epoch in range(how.epochs):
        if epoch and state.where("NOT done").isEmpty():
            break
        if epoch and how.islands > 1:  # the best of each island visits the next; a shard that is done takes no part
            guest = state.where("NOT done").select("budget_id", "shard", ((F.col("island") + 1) % how.islands).alias("island"), F.col("best").alias("visitor"))
            state = state.drop("guest").join(guest, ["budget_id", "shard", "island"], "left").withColumn("guest", F.coalesce("visitor", F.lit(b""))).drop("visitor")
            state = state.select(*[c.split()[0] for c in _STATE.split(", ")])
        state = scratch.write(state.mapInPandas(_epoch(epoch, how), _STATE))
    best = state.groupBy("budget_id", "shard").agg(F.max_by("best", F.struct("score", -F.col("island"))).alias("best"))
    placed = shards.join(best, ["budget_id", "shard"]).select("budget_id", "capacity", "shard", F.explode(F.arrays_zip("entries", _unpack_ints("best").alias("bin"))).alias("e"))
    placed = placed.select("budget_id", "capacity", "shard", "e.entries.doc_id", "e.entries.piece_no", "e.entries.size", F.col("e.bin").alias("bin"))
    fill = placed.groupBy("budget_id", "shard", "bin").agg(F.sum("size").alias("bin_fill"))
    return scratch.write(placed.join(fill, ["budget_id", "shard", "bin"]).withColumn("round", F.lit(number)))


def _sharded(items: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """Items with a shard, so many shards of each capacity that each fills about SHARD_CONTAINERS containers."""
    totals = {r.budget_id: (r.t, r.capacity, r.n) for r in items.groupBy("budget_id", "capacity").agg(F.sum("size").alias("t"), F.count("*").alias("n")).collect()}
    if not totals:
        return items.withColumn("shard", F.lit(0).cast("long")), 0
    shards = {b: max(1, round(max(t / (c * SHARD_CONTAINERS), n / 8000))) for b, (t, c, n) in totals.items()}
    number = F.create_map(*[F.lit(v) for kv in shards.items() for v in kv])
    return items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(seed)), number[F.col("budget_id")]).cast("long")), sum(shards.values())


def pack(docs: DataFrame, budgets: DataFrame, tokenizer: str = TOKENIZER, how: Breeding = Breeding()) -> DataFrame:
    """budget_id, container_id, doc_id, piece_no, token_start, token_end: which tokens of which document go where.

    A document longer than the capacity is cut into pieces of just the capacity, which fill a container each, and a
    rest that is packed like a document. Every document comes out for every budget; one without tokens takes no room.
    Budgets are few and fixed; those without a positive capacity are left out. Tokens are counted once for all budgets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    caps = [(r.budget_id, r.capacity_tokens) for r in budgets.where("capacity_tokens > 0").select("budget_id", "capacity_tokens").distinct().limit(MOST_BUDGETS + 1).collect()]
    if len(caps) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets")
    counts = scratch.write(token_counts(docs, tokenizer))
    out_cols = ["budget_id", "container_id", "doc_id", "piece_no", "token_start", "token_end"]
    if not caps:
        return counts.where("false").select(F.lit(0).alias("budget_id"), F.lit("").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("token_end"))
    cap = F.explode(F.array(*[F.struct(F.lit(b).cast("int").alias("b"), F.lit(c).cast("long").alias("c")) for b, c in caps])).alias("cap")
    each = counts.select("doc_id", "n_tokens", cap).select("doc_id", "n_tokens", F.col("cap.b").alias("budget_id"), F.col("cap.c").alias("capacity"))
    whole = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    full = each.withColumn("k", whole).where("k > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("piece_no"))
    full = full.select(
        "budget_id", F.concat_ws("-", "budget_id", F.lit("full"), "doc_id", "piece_no").alias("container_id"), "doc_id", "piece_no",
        (F.col("piece_no") * F.col("capacity")).alias("token_start"), ((F.col("piece_no") + 1) * F.col("capacity")).alias("token_end"),
    )
    rest = each.select("budget_id", "capacity", "doc_id", whole.alias("piece_no"), (F.col("n_tokens") % F.col("capacity")).alias("size")).where("size > 0 OR piece_no = 0")
    items, results = rest, []
    before = None
    for number in itertools.count():
        items, n_shards = _sharded(items, number)
        if not n_shards:
            break
        placed = _packed_round(items, scratch, number, how)
        ill = F.col("bin_fill") < WELL_FILLED * F.col("capacity")
        stuck = before is not None and n_shards > 0.9 * before  # what is left is not of a kind that fills containers
        before = n_shards
        if stuck or n_shards <= len(caps):
            results.append(placed)
            break
        results.append(placed.where(~ill))
        items = placed.where(ill).select("budget_id", "capacity", "doc_id", "piece_no", "size")
    if not results:  # no documents
        return full.select(*out_cols)
    packed = results[0]
    for r in results[1:]:
        packed = packed.unionByName(r)
    start = F.col("piece_no") * F.col("capacity")
    packed = packed.select("budget_id", F.concat_ws("-", "budget_id", "round", "shard", "bin").alias("container_id"), "doc_id", "piece_no", start.alias("token_start"), (start + F.col("size")).alias("token_end"))
    return full.select(*out_cols).unionByName(packed.select(*out_cols))


def packing_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: documents, containers, tokens, fill (tokens over room), and the least possible number of containers."""
    caps = budgets.select(F.col("budget_id").cast("int").alias("budget_id"), F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct()
    by = packed.groupBy("budget_id", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("fill"))
    by = by.groupBy("budget_id").agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("most"))
    return by.join(F.broadcast(caps), "budget_id").select(
        "budget_id", "capacity_tokens", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"),
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), (F.col("most") <= F.col("capacity_tokens")).alias("fits"),
    )
