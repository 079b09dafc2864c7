"""Best-fit packing by bin completion.

A bin's contents matter only by their lengths, so the search runs over the histogram of lengths: at most
`capacity` numbers, whatever the corpus holds. Best-fit decreasing gives the incumbent. A branch-and-bound search then
builds bins around the largest length that is left. It enumerates the fillings of what that length leaves, by waste and
then largest lengths first, as far as they are undominated (no single length that is left replaces a part of one without
wasting less) and as the waste bound allows: no more may be wasted in all than a packing with one sequence less than the
incumbent wastes. A filling is used as often as counts allow, or a half, a quarter, ... as often. A branch ends when its
bins and Martello and Toth's bound on what is left cannot beat the incumbent. The search goes in waves of limited
discrepancies and stops at the lower bound, else after `nodes` nodes with the best packing found.

The plan (patterns of lengths with how often each is used) is bounded by the histogram too. Pieces of full length are
sequences of their own and are not ranked. The others are numbered within their length (in hashed groups, more of them the
more rows a length has, offset by the groups' counts) and look up their sequence and offset in the plan.

Defined results: null text counts as empty and is its end id alone; rows that repeat an id are pieces of
their own; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import limit_batches, read, tidy, written
from .tokens import END_ID, encoder
from .wordhash import word_slices

CAPACITY, NODES = 1024, 6000
#: Discrepancies of the last wave; pieces left from which on the search chooses freely.
MOST_WAVES, FEW = 12, 20
#: Rows of one length that one task ranks, on average, and into how many groups a length is dealt at most.
GROUP_ROWS, MOST_GROUPS = 200_000, 1024
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece; with_ids adds its ids as little-endian unsigned 32-bit integers."""
    limit_batches(df.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    @tidy
    def pieces(batches):
        own = encoder(vocabulary)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, words in word_slices(batch.column(1), fold=False):
                ids, ends = own.encode(words, END_ID)
                raw, rows, begin = ids.tobytes(), [], 0
                for name, end in zip(doc_ids[a : a + words.n_docs], ends.tolist()):
                    start, first = 0, (end - begin - 1) % capacity + 1
                    for k, upto in enumerate(range(first, end - begin + 1, capacity)):
                        part = raw[4 * (begin + start) : 4 * (begin + upto)]
                        rows.append((name, k, start, upto - start, zlib.crc32(part), part))
                        start = upto
                    begin = end
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns[: len(names)], kinds)], names=names)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def reachable(counts: list[int], room: int) -> tuple[list[int], list[int]]:
    """The lengths up to room, largest first, and for each place in that list which sums (bits) the lengths from there on make."""
    sizes = [s for s in range(min(room, len(counts) - 1), 0, -1) if counts[s]]
    sums, out, whole = 1, [1] * (len(sizes) + 1), (1 << (room + 1)) - 1
    for k in range(len(sizes) - 1, -1, -1):
        left, step = min(counts[sizes[k]], room // sizes[k]), 1
        while left:  # 1, 2, 4, ... copies and what is left make every number of copies
            take = min(step, left)
            sums |= sums << (sizes[k] * take)
            left, step = left - take, 2 * step
        sums &= whole
        out[k] = sums
    return sizes, out


def dominated(counts: list[int], filling: tuple[int, ...], waste: int) -> bool:
    """Whether one length that is left could take the place of some of the filling and waste no more: what it frees is smaller."""
    parts = {0: 0}  # sums of subsets: how many lengths the smallest one takes
    for s in filling:
        for total, n in list(parts.items()):
            parts[total + s] = min(parts.get(total + s, n + 1), n + 1) if n else parts.get(total + s, 1)
    one = set(filling)
    free = lambda y: y < len(counts) and counts[y] > filling.count(y)
    for total in parts:
        if total:
            if total not in one and free(total):
                return True
            if any(free(y) for y in range(total + 1, total + waste + 1)):
                return True
    return False


def fillings(counts: list[int], room: int, most_waste: int) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of the room that wastes no more than that, the least waste and the largest lengths first."""
    sizes, sums = reachable(counts, room)
    for waste in range(min(most_waste, room) + 1):
        if not sums[0] >> (room - waste) & 1:
            continue
        # A stack of (place in sizes, what is still to be filled, filling): the next length is the one at the place or a smaller one.
        stack = [(0, room - waste, ())]
        while stack:
            k, left, filling = stack.pop()
            if not left:
                if not dominated(counts, filling, waste):
                    yield filling
                continue
            while k < len(sizes) and sizes[k] > left:
                k += 1
            if k == len(sizes):
                continue
            s = sizes[k]
            if sums[k + 1] >> left & 1:
                stack.append((k + 1, left, filling))
            for n in range(1, min(counts[s], left // s) + 1):
                if sums[k + 1] >> (left - n * s) & 1:
                    stack.append((k + 1, left - n * s, filling + (s,) * n))


def lower_bound(counts: list[int], capacity: int) -> int:
    """Martello and Toth's bound: lengths over half a bin never meet, and what is over `small` fits only into their gaps."""
    size, n = np.arange(capacity + 1), np.array(counts, dtype=np.int64)
    upto, filled = np.cumsum(n), np.cumsum(n * size)
    half = capacity // 2
    small = np.arange(1, half + 1)
    alone, large = upto[capacity] - upto[capacity - small], upto[capacity - small] - upto[half]
    gaps = large * capacity - (filled[capacity - small] - filled[half])
    rest = filled[half] - filled[small - 1]
    best = int((alone + large + np.maximum(0, -(-(rest - gaps) // capacity))).max(initial=0))
    return max(best, -(-int(filled[capacity]) // capacity))


def uses(counts: list[int], bin_: tuple[int, ...]) -> int:
    """How often the bin can be filled from the counts."""
    return min(counts[s] // bin_.count(s) for s in set(bin_))


def best_fit(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing: around the largest length ever smaller ones, each the largest that fits."""
    counts, plan = list(counts), []
    for largest in range(capacity, 0, -1):
        while counts[largest]:
            own, bin_, room, s = list(counts), [largest], capacity - largest, capacity - largest
            own[largest] -= 1
            while s > 0:
                if own[s]:
                    own[s] -= 1
                    bin_.append(s)
                    room -= s
                    s = min(s, room)
                else:
                    s -= 1
            times = uses(counts, tuple(bin_))
            for s in bin_:
                counts[s] -= times
            plan.append((tuple(bin_), times))
    return plan


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, each at most capacity) and how often each is used: few sequences in all.

    The incumbent is best fit's. Waves of limited discrepancy search then complete bins around the largest length left: a wave
    follows the first choices but for so many discrepancies, and chooses freely once few pieces are left."""
    counts = [histogram.get(s, 0) for s in range(capacity + 1)]
    total, bound = sum(s * n for s, n in enumerate(counts)), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    bins = sum(times for _, times in best)
    spent = 0
    for wave in range(MOST_WAVES):
        # Each entry: what is left (counts, largest length, bins used, filled so far), the plan so far as a linked list, discrepancies left.
        stack = [(iter([(counts, capacity, 0, total, None)]), wave)]
        while stack and bins > bound and spent < nodes:
            options, free = stack[-1]
            node = next(options, None) if free >= 0 else None
            if node is None:
                stack.pop()
                continue
            own, largest, used, rest, plan = node
            stack[-1] = options, (free if sum(own) <= FEW else free - 1)
            spent += 1
            while largest and not own[largest]:
                largest -= 1
            if not largest:
                if used < bins:
                    bins, best = used, []
                    while plan:
                        plan, step = plan
                        best.append(step)
                continue
            waste = (bins - 1 - used) * capacity - rest
            if waste >= 0 and used + lower_bound(own, capacity) < bins:
                stack.append((choices(own, largest, used, rest, plan, capacity, waste), free))
        if bins <= bound or spent >= nodes:
            break
    return best


def choices(counts: list[int], largest: int, used: int, rest: int, plan, capacity: int, waste: int) -> Iterator[tuple]:
    """What is left after each way to fill a bin around the largest length: as often as counts and the waste allow, then half as often."""
    others = list(counts)
    others[largest] -= 1
    for filling in fillings(others, capacity - largest, waste):
        bin_ = (largest, *filling)
        lost = capacity - sum(bin_)
        times = uses(counts, bin_)
        times = min(times, waste // lost) if lost else times
        while times:
            own = list(counts)
            for s in bin_:
                own[s] -= times
            yield own, largest, used + times, rest - times * (capacity - lost), (plan, (bin_, times))
            times //= 2


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces (doc_id, piece, length and others) with sequence_id and offset. pieces must be a written table: full ones are numbered by their place in it."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    histogram.pop(capacity, None)
    groups = int(min(MOST_GROUPS, max(4, -(-max(histogram.values(), default=0) // group_rows))))
    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int")
    tagged = pieces.where(F.col("length") < capacity).withColumn("_pk_g", group)
    sums = tagged.groupBy("length", "_pk_g").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select("length", "_pk_g", (F.sum("n").over(Window.partitionBy("length").orderBy("_pk_g")) - F.col("n")).alias("_pk_before")).collect()
    before = np.zeros((capacity + 1, groups), dtype=np.int64)  # of bounded size: capacity * groups numbers
    for r in sums:
        before[r["length"], r["_pk_g"]] = r["_pk_before"]
    # For each length: from which rank on, which pattern; a pattern's k-th copy of a length has ranks of its own.
    spans: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for bin_, times in complete_bins(histogram, capacity, nodes):
        offset = 0
        for s in bin_:
            spans[s].append((used[s], sequence, offset))
            used[s] += times
            offset += s
        sequence += times
    tables = {s: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for s, rows in spans.items()}
    names = [c for c in tagged.columns if c != "_pk_g"]

    @tidy
    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            at = batch.column("_pk_r").to_numpy() - 1 + before[length, batch.column("_pk_g").to_numpy()]
            sequence_id, offset = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)]):
                rows = order[a:b]
                first, sequences, offsets = tables[int(length[rows[0]])]
                k = np.searchsorted(first, at[rows], side="right") - 1
                sequence_id[rows] = sequences[k] + at[rows] - first[k]
                offset[rows] = offsets[k]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence_id), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ranked = tagged.withColumn("_pk_r", F.row_number().over(Window.partitionBy("length", "_pk_g").orderBy("doc_id", "piece", "ids_crc32")).cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    full = pieces.where(F.col("length") == capacity).select("*", (F.lit(sequence) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint").unionByName(full)


def pack_documents(df: DataFrame, **options) -> DataFrame:
    """The pieces of df's texts with their sequences and offsets."""
    return pack(written(token_pieces(df, **options), "pieces"), options.get("capacity", CAPACITY))


def op8_bin_completion(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
