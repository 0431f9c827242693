"""Mixture-controlled packing of items into containers of fixed capacity.

Items wait in one queue per source.  Every container (window) gives each queue a quantum of
``share x capacity`` tokens; the queue with the largest deficit is served first and takes its largest
item that still fits, so windows follow the target proportions and little space stays unused.
The proportions are stated or, without a statement, the queues' own shares of all tokens.
Deficits are carried from window to window and from partition to partition: with own shares a partition
packs everything it owns, so what it will have spent per queue is known from a sum before packing starts
and the deficit of partition p is the prefix sum over the partitions before it.
With stated proportions that the corpus does not have, a partition mixes until a queue with a share
runs out; what cannot be mixed then comes last, in containers of its own (``mixed`` is false), and each
partition starts without a deficit, since its mixed part ends without one.

Items longer than a container are cut into full containers and a rest; every other item stays whole.

Defined results for odd input: null texts are no items; an item without tokens takes no space and
goes to its partition's first container; a null or unlisted source waits in the queue ``other``;
ties are broken by id; repeated rows are separate items; no items give no containers.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_width
from .tokens import OTHER

CAPACITY = 2048
#: Tokens one packing task owns: 1,024 containers; at most one of them ends partly empty.
TOKENS_PER_TASK = 1024 * CAPACITY


#: Consecutive containers of one stretch of the report.
STRETCH = 32


class Queue:
    """Items of one source by size; finds the largest item that fits by a bit mask over sizes."""

    def __init__(self, capacity: int):
        self._stacks: dict[int, list] = {}
        self._mask = 0
        self._low = [(1 << (i + 1)) - 1 for i in range(capacity + 1)]

    def put(self, size: int, item) -> None:
        self._stacks.setdefault(size, []).append(item)
        self._mask |= 1 << size

    def largest(self, room: int) -> int:
        """Size of the largest item of at most ``room``, -1 if there is none."""
        return (self._mask & self._low[room]).bit_length() - 1

    def take(self, size: int):
        stack = self._stacks[size]
        item = stack.pop()
        if not stack:
            self._mask ^= 1 << size
        return item

    def __bool__(self) -> bool:
        return bool(self._mask)


def pack(
    items: list[tuple[str, object, int, int]],
    shares: dict[str, float],
    deficits: dict[str, float] | None = None,
    capacity: int = CAPACITY,
    until_short: bool = False,
) -> tuple[list[list[tuple[object, int, int]]], dict[str, float]]:
    """Containers of (id, piece number, size) and the deficits left over.

    ``items`` are (queue, id, piece number, size) with 0 <= size <= capacity.  With ``until_short`` packing
    ends before the window for which a queue with a share has nothing left; ``items`` keeps the rest.
    """
    queues = {q: Queue(capacity) for q in shares}
    empty: list[tuple[object, int, int]] = []
    for q, key, piece, size in items:
        if size:
            if q not in queues:
                queues[q] = Queue(capacity)
            queues[q].put(size, (key, piece))
        else:
            empty.append((key, piece, 0))
    deficit = {q: float((deficits or {}).get(q, 0.0)) for q in queues}
    names = sorted(q for q in queues if queues[q] and (shares.get(q, 0.0) > 0 or not until_short))
    needed = {q for q in shares if shares[q] > 0}
    out: list[list[tuple[object, int, int]]] = []
    while names and not (until_short and not needed <= set(names)):
        for q in queues:
            deficit[q] += shares.get(q, 0.0) * capacity
        window, room = [], capacity
        while room:
            # first what a queue's deficit pays for, then, to leave no space, what merely fits
            best, best_size = None, -1
            for paid in (True, False):
                for q in names:
                    if best is not None and deficit[q] <= deficit[best]:
                        continue
                    size = queues[q].largest(min(room, max(0, int(deficit[q]))) if paid else room)
                    if size > 0:
                        best, best_size = q, size
                if best is not None:
                    break
            if best is None:
                break
            key, piece = queues[best].take(best_size)
            window.append((key, piece, best_size))
            deficit[best] -= best_size
            room -= best_size
            if not queues[best]:
                names.pop(bisect.bisect_left(names, best))
        out.append(window)
    if until_short:
        packed = {(key, piece) for w in out for key, piece, _ in w}
        items[:] = [x for x in items if (x[1], x[2]) not in packed]
    elif empty:
        if not out:
            out.append([])
        out[0].extend(empty)
    return out, deficit


def pack_items(
    sizes: DataFrame, known: list[str], capacity: int = CAPACITY, tokens_per_task: int = TOKENS_PER_TASK, targets: dict[str, float] | None = None
) -> DataFrame:
    """(id, piece_no, n_tokens, container_id, slot, queue, mixed) for ``sizes`` (id, queue, n_tokens).

    ``known`` names the queues (a table of fixed size); ``targets`` states their proportions (summing to 1), without
    it they are the queues' own shares of all tokens, so that every item can be placed in the mixture.
    ``sizes`` should be a written table: it is read once for the sums and once for the packing.
    """
    queue = F.when(F.col("queue").isin(known), F.col("queue")).otherwise(F.lit(OTHER))
    # ids travel as strings: a null among integers would turn them into floats on the way through pandas
    items = sizes.select(F.col("id").cast("string").alias("id"), queue.alias("queue"), F.col("n_tokens").cast("long").alias("n_tokens"))
    total = items.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = max(1, -(-total // tokens_per_task))
    items = items.withColumn("task", F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("long"))
    spent = items.groupBy("task", "queue").agg(F.sum("n_tokens").alias("spent"))
    per_queue = {r["queue"]: r["n"] for r in items.groupBy("queue").agg(F.sum("n_tokens").alias("n")).collect()}
    shares = {q: (n or 0) / total for q, n in per_queue.items()} if total else dict.fromkeys(per_queue, 0.0)
    schema = "id string, piece_no int, n_tokens bigint, container_id string, slot int, queue string, mixed boolean"
    if not shares:
        nothing = sizes.sparkSession.createDataFrame([], schema)
        return nothing.withColumn("id", F.col("id").cast(sizes.schema["id"].dataType))
    # what tasks before this one spent per queue; one row per (task, queue)
    grid = spent.groupBy("task").agg(
        F.map_from_entries(F.collect_list(F.struct("queue", "spent"))).alias("by_queue")
    )
    # prefix sums in two levels: within blocks of tasks, then over the (few) blocks
    block = 4096
    grid = grid.withColumn("block", F.floor(F.col("task") / block))
    before = Window.partitionBy("block").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    columns = {q: F.coalesce(F.col("by_queue")[q], F.lit(0)) for q in sorted(shares)}
    named = {q: f"q{i}" for i, q in enumerate(sorted(shares))}
    grid = grid.select("task", "block", *[c.alias(named[q]) for q, c in columns.items()])
    blocks = grid.groupBy("block").agg(*[F.sum(n).alias(n) for n in named.values()])
    blocks = blocks.select("block", *[F.coalesce(F.sum(n).over(over), F.lit(0)).alias(f"b{n}") for n in named.values()])
    carried = (
        grid.select("task", "block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in named.values()])
        .join(blocks, "block")
        .select(F.col("task").alias("owner"), *[(F.col(n) + F.col(f"b{n}")).cast("long").alias(n) for n in named.values()])
    )

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        carry = {q: int(right[n].iloc[0]) if len(right) else 0 for q, n in named.items()}
        so_far = sum(carry.values())
        deficits = {q: shares[q] * so_far - carry[q] for q in carry}
        left = left.sort_values(["n_tokens", "id"], kind="stable")
        rows, entries = [], []
        names = dict(zip(left["id"], left["queue"]))
        task = int(left["task"].iloc[0])
        full = 0
        for key, q, size in zip(left["id"], left["queue"], left["n_tokens"]):
            whole, rest = divmod(int(size), capacity) if size > capacity else (0, int(size))
            for piece in range(whole):
                rows.append((key, piece, capacity, f"{task}-f{full}", 0, q, False))
                full += 1
            if rest or not whole:
                entries.append((q, key, whole, rest))

        def place(windows: list, kind: str, mixed: bool) -> None:
            for k, window in enumerate(windows):
                rows.extend((key, piece, size, f"{task}-{kind}{k}", slot, names[key], mixed) for slot, (key, piece, size) in enumerate(window))

        if targets is None:
            place(pack(entries, shares, deficits, capacity)[0], "", True)
        else:
            # items of one id and piece are told apart by their place in the list: repeated rows are separate items
            numbered = [(q, i, 0, size) for i, (q, _, _, size) in enumerate(entries)]
            named_again = lambda windows: [[(entries[i][1], entries[i][2], size) for i, _, size in w] for w in windows]
            place(named_again(pack(numbered, targets, None, capacity, True)[0]), "", True)
            rest: dict[str, float] = {}
            for q, _, _, size in numbered:
                rest[q] = rest.get(q, 0.0) + size
            total_rest = sum(rest.values()) or 1.0
            place(named_again(pack(numbered, {q: n / total_rest for q, n in rest.items()}, None, capacity)[0]), "r", False)
        return pd.DataFrame(rows, columns=["id", "piece_no", "n_tokens", "container_id", "slot", "queue", "mixed"])

    # packing is work on few bytes: without a stated number of partitions it would be merged into one
    width = int(min(tasks, 4 * shuffle_width(sizes.sparkSession)))
    packed = (
        items.repartition(width, "task")
        .groupBy("task")
        .cogroup(carried.repartition(width, "owner").groupBy("owner"))
        .applyInPandas(run, schema)
    )
    return packed.withColumn("id", F.col("id").cast(sizes.schema["id"].dataType))


def packing_report(packed: DataFrame, capacity: int = CAPACITY, targets: dict[str, float] | None = None) -> DataFrame:
    """One row: containers, tokens placed, the fullest container, the share of space left unused, the share of
    tokens in mixed containers and the mean deviation from the proportions (half the sum of absolute
    differences; the own shares of all tokens without ``targets``) of these containers and of stretches
    of ``STRETCH`` consecutive ones."""
    sums = packed.groupBy("container_id", "queue", "mixed").agg(F.sum("n_tokens").alias("n"))
    by_queue_of = F.map_from_entries(F.collect_list(F.struct("queue", "n"))).alias("by_queue")
    per = sums.groupBy("container_id").agg(F.sum("n").alias("used"), F.bool_and("mixed").alias("mixed"), by_queue_of)
    if targets is None:
        by_queue = {r["queue"]: r["n"] for r in packed.groupBy("queue").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per queue
        targets = {q: (n or 0) / max(1, sum(by_queue.values())) for q, n in by_queue.items()}
    held = lambda q: F.coalesce(F.col("by_queue")[q], F.lit(0)) / F.greatest("used", F.lit(1))
    apart = sum((F.abs(held(q) - F.lit(float(t))) for q, t in sorted(targets.items())), F.lit(0.0))
    away = (apart + F.lit(1.0) - sum((held(q) for q in sorted(targets)), F.lit(0.0))) / 2
    one = per.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        (F.lit(1.0) - F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("unused_share"),
        (F.sum(F.when(F.col("mixed"), F.col("used"))) / F.sum("used")).alias("mixed_share"),
        F.avg(F.when(F.col("mixed"), away)).alias("mean_deviation"),
    )
    # a container holds few whole items; stretches of consecutive containers of a partition show the mixture
    place = F.split("container_id", "-")
    stretches = sums.where("mixed").groupBy(place[0].alias("task"), F.floor(place[1].cast("int") / STRETCH).alias("stretch"), "queue").agg(F.sum("n").alias("n"))
    long = stretches.groupBy("task", "stretch").agg(F.sum("n").alias("used"), by_queue_of)
    return one.join(long.agg(F.avg(away).alias("stretch_deviation")))  # one row beside one row
