"""Packing documents into sequences of bounded length by linear grouping.

Documents of one length are alike to a packer, so the plan is made from the histogram of lengths, which has at most
``limit`` entries however large the corpus is:

1. Large lengths, in descending order, form groups of equal cardinality; each is rounded up to the largest of its group.
2. For these few sizes, configurations (multisets that fit a sequence) are chosen by column generation: a linear
   program whose prices drive a knapsack. Whole multiples are used.
3. Actual documents replace the rounded ones: the longest that fit each place.
4. Small lengths, and large ones that no tight configuration holds, go where they fit best, longest first.

The plan is a list of runs "so many sequences hold these lengths at these offsets". Every document finds its place in it
from its rank among those of its length. Ranks come from counters of the tasks that tokenize, so no group meets in one
task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.llm import tokens
from veilgrain.llm.words import ROWS_AT_ONCE, forget, slices
from veilgrain.session import record_batches, store

GROUPS = 48  # rounded sizes of the large lengths
SMALL = 1 / 3  # lengths up to this share of the limit are small
LOOSE = 1 / 16  # configurations that leave more of a sequence empty are not used


# --- the plan, from a histogram of lengths ---------------------------------------------------------------------------


def rounded_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths in descending order cut into ``groups`` groups of equal cardinality, as runs (length, count)."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = each
            n = min(left, room)
            out[-1].append((length, n))
            left -= n
            room -= n
    return out


def best_knapsack(sizes: list[int], prices: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """Multiset of sizes within ``limit`` of the highest total price."""
    worth = np.zeros(limit + 1)
    pick = np.full(limit + 1, -1)
    order = np.asarray(sizes)
    for room in range(1, limit + 1):
        worth[room], pick[room] = worth[room - 1], -1
        fit = order <= room
        if fit.any():
            gain = np.where(fit, worth[np.maximum(room - order, 0)] + prices, -1.0)
            i = int(gain.argmax())
            if gain[i] > worth[room] + 1e-12:
                worth[room], pick[room] = gain[i], i
    counts = np.zeros(len(sizes), np.int64)
    room = limit
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(worth[limit]), counts


def configurations(sizes: list[int], demand: list[int], limit: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """(counts of each size, number of sequences) that hold no more than the demand; found by column generation.

    Starts with one size per configuration and brings in the configuration that the prices of the linear program favour
    until none improves it. The numbers are rounded down, so some demand stays open.
    """
    m = len(sizes)
    basis = np.diag([float(max(1, limit // s)) for s in sizes])
    columns = [basis[:, i].astype(np.int64) for i in range(m)]
    want = np.asarray(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        prices = inverse.sum(axis=0)  # every configuration costs one sequence
        value, new = best_knapsack(sizes, np.maximum(prices, 0), limit)
        if value <= 1 + 1e-7:
            break
        level, step = inverse @ want, inverse @ new
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out], columns[out] = new, new
    level = np.linalg.solve(basis, want)
    open_demand = np.asarray(demand, np.int64).copy()
    chosen = []
    for column, times in sorted(zip(columns, level), key=lambda x: -x[1]):
        used = column > 0
        n = min(int(times + 1e-6), int((open_demand[used] // column[used]).min()))
        if n > 0:
            chosen.append((column, n))
            open_demand -= column * n
    return chosen


class Bins:
    """Runs of equal sequences by the room that is left in them; a run is (number, lengths held)."""

    def __init__(self, limit: int):
        self.limit, self.by_room, self.rooms = limit, {}, []

    def add(self, held: tuple[int, ...], number: int, room: int) -> None:
        if room not in self.by_room:
            self.by_room[room] = {}
            bisect.insort(self.rooms, room)
        same = self.by_room[room]
        same[held] = same.get(held, 0) + number

    def place(self, length: int, count: int) -> None:
        """Put ``count`` pieces of one length where the least room is left after them, or into new sequences."""
        while count:
            i = bisect.bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.limit // length
                full, rest = divmod(count, each)
                if full:
                    self.add((length,) * each, full, self.limit - length * each)
                if rest:
                    self.add((length,) * rest, 1, self.limit - length * rest)
                return
            room = self.rooms[i]
            held = min(self.by_room[room])
            number = self.by_room[room].pop(held)
            if not self.by_room[room]:
                del self.by_room[room]
                self.rooms.pop(i)
            fit = min(room // length, max(1, count // number))  # as many of this length in each as fit and exist
            use = min(number, count // fit)
            self.add(held + (length,) * fit, use, room - length * fit)
            if number > use:
                self.add(held, number - use, room)
            count -= use * fit


class Stock:
    """Documents by length."""

    def __init__(self, counts: dict[int, int]):
        self.counts, self.lengths = dict(counts), sorted(counts)

    def longest(self, most: int) -> int:
        """The longest length of at most ``most`` in stock, 0 if there is none."""
        i = bisect.bisect_right(self.lengths, most)
        return self.lengths[i - 1] if i else 0

    def take(self, length: int, number: int) -> None:
        self.counts[length] -= number
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)


def plan(counts: dict[int, int], limit: int, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths held by one sequence, number of such sequences) that hold every length of the histogram."""
    counts = {length: n for length, n in counts.items() if n}
    bins = Bins(limit)
    large = {length: n for length, n in counts.items() if length > limit * SMALL}
    sizes = [g[0][0] for g in rounded_groups(large, groups)]  # rounded up to the largest of the group
    numbers = [sum(n for _, n in g) for g in rounded_groups(large, groups)]
    merged = sorted(set(sizes), reverse=True)
    demand = [sum(n for s, n in zip(sizes, numbers) if s == own) for own in merged]
    stock = Stock(large)
    chosen = configurations(merged, demand, limit) if merged else []
    for column, number in sorted(chosen, key=lambda x: tuple(-x[0])):
        slots = [merged[i] for i, c in enumerate(column) for _ in range(int(c))]
        if limit - sum(slots) > limit * LOOSE:
            continue
        while number:
            # actual documents: the longest that a rounded size allows; the last slot takes what fits best
            held: list[int] = []
            for j, size in enumerate(slots):
                length = stock.longest(size if j + 1 < len(slots) else limit - sum(held))
                while length and stock.counts[length] <= held.count(length):
                    length = stock.longest(length - 1)
                if not length:
                    break
                held.append(length)
            if len(held) < len(slots):
                break
            n = min(number, *(stock.counts[x] // held.count(x) for x in held))
            for x in set(held):
                stock.take(x, n * held.count(x))
            bins.add(tuple(sorted(held, reverse=True)), n, limit - sum(held))
            number -= n
    rest = dict(stock.counts)
    rest.update((length, n) for length, n in counts.items() if length not in large)
    for length in sorted(rest, reverse=True):
        bins.place(length, rest[length])
    return [(held, n) for room in bins.rooms for held, n in sorted(bins.by_room[room].items())]


# --- pieces and their places -----------------------------------------------------------------------------------------


def piece_rows(
    batches: Iterator[pa.RecordBatch], path: str, limit: int, end_id: int, keep_ids: bool
) -> Iterator[pa.RecordBatch]:
    """Pieces of every document with their rank among the pieces of that length in this task."""
    forget()  # tokenizing needs no words; earlier stages' caches would lie beside the encoder's
    encode = tokens.encoder(path).encode
    task = TaskContext.get().partitionId()
    met = np.zeros(limit + 1, np.int64)
    end = np.array([end_id], np.uint32)
    for batch in slices(batches):
        found = encode(batch.column(1).to_pylist())
        flat = np.concatenate([x for ids in found for x in (ids, end)]).astype("<u4")
        size = np.array([len(ids) + 1 for ids in found], np.int64)
        number = -(-size // limit)  # pieces of each document
        row = np.repeat(np.arange(len(size)), number)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        first = (size - 1) % limit + 1
        start = np.where(piece == 0, 0, first[row] + (piece - 1) * limit)
        length = np.where(piece == 0, first[row], limit)
        at = (np.repeat(np.cumsum(size) - size, number) + start) * 4
        data = memoryview(flat.tobytes())
        bodies = [data[x:y] for x, y in zip(at.tolist(), (at + 4 * length).tolist())]
        order = np.argsort(length, kind="stable")
        run = np.concatenate([[0], np.flatnonzero(np.diff(length[order])) + 1]) if len(row) else np.zeros(0, np.int64)
        rank = np.zeros(len(row), np.int64)
        rank[order] = np.arange(len(row)) - np.repeat(run, np.diff(run, append=len(row))) + met[length[order]]
        met += np.bincount(length, minlength=limit + 1)
        columns = {
            "doc_id": batch.column(0).take(pa.array(row)),
            "piece": pa.array(piece.astype(np.int32)),
            "start": pa.array(start),
            "length": pa.array(length),
            "ids": pa.array(bodies, pa.binary()) if keep_ids else None,
            "ids_crc32": pa.array(list(map(zlib.crc32, bodies)), pa.int64()),
            "task": pa.array(np.full(len(row), task, np.int32)),
            "rank": pa.array(rank),
        }
        yield pa.record_batch({k: v for k, v in columns.items() if v is not None})


def places(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, copies in each sequence, offset of the first copy)."""
    out, used, sequence = [], {}, 0
    for held, number in runs:
        offset = 0
        for length in sorted(set(held), reverse=True):
            copies = held.count(length)
            begin = used.get(length, 0)
            used[length] = begin + copies * number
            out.append((length, begin, used[length], sequence, copies, offset))
            offset += copies * length
        sequence += number
    return out


def pack(
    docs: DataFrame, path: str, limit: int = 1024, end_id: int = 2, groups: int = GROUPS, keep_ids: bool = True
) -> DataFrame:
    """One row per piece of every row of ``docs``: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    ``ids`` holds little-endian unsigned 32-bit ids of the tokenizer file ``path``, with ``end_id`` after each document; without
    ``keep_ids`` the column is left out and never stored.
    Documents of more than ``limit`` ids are cut into pieces of ``limit``; the first may be shorter. Sequences are
    filled without gaps from offset 0 and hold at most ``limit`` ids. A full piece is a sequence of its own, with a
    negative number. A null or empty text is the end id alone. Repeated rows are packed once each; rows with a null
    id like others. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    kinds = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, {'ids binary, ' if keep_ids else ''}"
        "ids_crc32 long, task int, rank long"
    )
    pieces = docs.select("doc_id", "text").mapInArrow(lambda it: piece_rows(it, path, limit, end_id, keep_ids), kinds)
    with record_batches(spark, ROWS_AT_ONCE):
        pieces = store(pieces, "pieces")
    short = pieces.where(F.col("length") < limit)
    tally = store(short.groupBy("length", "task").agg(F.count("*").alias("n")), "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # < limit rows
    table = places(plan(counts, limit, groups))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = tally.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    schema = "len long, begin long, end long, sequence long, copies long, first long"
    spots = F.broadcast(spark.createDataFrame(table, schema))  # its size depends on limit and groups, not on the corpus
    place = F.col("before") + F.col("rank")
    nth = place - F.col("begin")
    out = ["doc_id", "piece", "start", "length", *["ids"] * keep_ids, "ids_crc32"]
    found = (F.col("length") == F.col("len")) & (place >= F.col("begin")) & (place < F.col("end"))
    packed = (
        short.join(before, ["length", "task"])
        .join(spots, found)
        .select(
            *out,
            (F.col("sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
            (F.col("first") + nth % F.col("copies") * F.col("length")).cast("long").alias("offset"),
        )
    )
    alone = (-1 - F.col("task").cast("long") * F.lit(1 << 40) - F.col("rank")).alias("sequence_id")
    full = pieces.where(F.col("length") == limit).select(*out, alone, F.lit(0).cast("long").alias("offset"))
    return full.union(packed)
