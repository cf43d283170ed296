"""Packing token sequences into bins of a fixed size, by linear grouping.

The plan is made from the histogram of piece lengths alone: at most ``size``
numbers, however large the corpus.  Large lengths are rounded up within groups
of equal cardinality, configurations of those few sizes are chosen, the actual
lengths take their places, and small ones go best-fit into what is left.  The
plan names runs of ranks ("the 7th to 90th piece of length 812"), so every
piece finds its place from its length and its rank within that length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from epiframe.llm.common import cut, text_slices
from epiframe.llm.wordbpe import word_bpe

#: Most runs of ranks a plan may hold; its size follows from ``size``, not from the data.
MAX_RUNS = 2_000_000


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32 [, ids]): every document in pieces of at most ``size`` tokens.

    A document is the ids of its whole text (null as empty), then ``end_id``;
    only longer ones are cut, into pieces of ``size``, the last maybe shorter.
    ids_crc32 is over the little-endian unsigned 32-bit ids."""
    def run(batches):
        bpe = word_bpe(tokenizer_path)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                flat, counts = bpe.encode(texts)
                flat = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                n = -(-counts // size)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                length = np.minimum(size, counts[row] - start)
                ends = np.cumsum(length)
                data = memoryview(flat.tobytes())
                crc = [zlib.crc32(data[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), length.tolist())]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)),
                           pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pairs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    return pairs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _groups(lengths: list[int], counts: dict[int, int], n_groups: int) -> list[list[int]]:
    """Lengths (descending) in runs of about equal cardinality; a length is never split."""
    total, groups, have = sum(counts[x] for x in lengths), [], 0
    for x in lengths:
        if not groups or have >= len(groups) * total / n_groups:
            groups.append([])
        groups[-1].append(x)
        have += counts[x]
    return groups


def _best_fill(sizes: list[int], left: list[int], room: int) -> list[int]:
    """Indices (repeats allowed up to ``left``) whose sizes fill ``room`` best.

    Reachable sums as bits of one number, size by size, then traced back."""
    layers, reach = [], 1
    mask = (1 << (room + 1)) - 1
    for s, n in zip(sizes, left):
        steps = []
        for _ in range(min(n, room // s)):
            more = reach | (reach << s) & mask
            if more == reach:
                break
            steps.append(reach)
            reach = more
        layers.append(steps)
    at, chosen = reach.bit_length() - 1, []
    for i in range(len(sizes) - 1, -1, -1):
        for before in reversed(layers[i]):
            if not before >> at & 1:
                chosen.append(i)
                at -= sizes[i]
    return chosen


def plan(histogram: dict[int, int], size: int = 4096, n_groups: int = 96, small: int = 8) -> tuple[list, int]:
    """(runs, bins): runs (length, first rank, first bin, how many, offset).

    Piece ``first rank + i`` of that length goes to bin ``first bin + i`` at
    ``offset``.  Lengths up to ``size // small`` are the small ones.  Ranks of
    each length are used from 0 on, each once."""
    counts = {x: n for x, n in histogram.items() if n}
    if counts and not 0 < min(counts) <= max(counts) <= size:
        raise ValueError(f"lengths must be within 1 to {size}")
    runs: list[tuple[int, int, int, int, int]] = []
    rank = dict.fromkeys(counts, 0)
    bins = 0
    rooms: list[int] = []  # distinct free rooms, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # free room -> (first bin, how many)

    def leave(room, first, n):
        if room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    if size in counts:  # full bins
        runs.append((size, 0, 0, counts[size], 0))
        bins = counts.pop(size)
    large = sorted((x for x in counts if x > size // small), reverse=True)
    groups = _groups(large, counts, n_groups)
    rounded = [g[0] for g in groups]
    left = [sum(counts[x] for x in g) for g in groups]
    queue = [[[x, counts[x]] for x in g] for g in groups]  # longest first
    for i in range(len(groups)):
        while left[i]:
            # A configuration: the largest size still there, and the best fill of the rest by rounded sizes.
            left[i] -= 1
            config = [i, *_best_fill(rounded[i:], left[i:], size - rounded[i])]
            config = [config[0], *(i + k for k in config[1:])]
            left[i] += 1
            uses = {k: config.count(k) for k in set(config)}
            times = min(left[k] // n for k, n in uses.items())
            for k, n in uses.items():
                left[k] -= n * times
            # Actual lengths take the places, a run of bins with equal lengths at a time.
            while times:
                places, n = [], times
                need: dict[int, int] = {}
                for k in config:
                    need[k] = need.get(k, 0) + 1
                for k, u in need.items():
                    head = queue[k][0]
                    if head[1] >= u:
                        n = min(n, head[1] // u)
                        places += [head[0]] * u
                    else:  # one bin with several lengths of the group
                        n = 1
                        short, q = u, 0
                        while short:
                            got = min(short, queue[k][q][1])
                            places += [queue[k][q][0]] * got
                            short -= got
                            q += 1
                offset = 0
                for x in places:
                    runs.append((x, rank[x], bins, n, offset))
                    rank[x] += n
                    offset += x
                for k, u in need.items():
                    take = u * n
                    while take:
                        got = min(take, queue[k][0][1])
                        queue[k][0][1] -= got
                        take -= got
                        if not queue[k][0][1]:
                            queue[k].pop(0)
                leave(size - offset, bins, n)
                bins += n
                times -= n
    # What is small goes where it leaves least, longest first.
    for x in sorted((x for x in counts if x <= size // small), reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                new = -(-n // (size // x))
                leave(size, bins, new)
                bins += new
                continue
            room = rooms[at]
            first, have = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            got = min(n, have)
            runs.append((x, rank[x], first, got, size - room))
            rank[x] += got
            n -= got
            leave(room - x, first, got)
            if got < have:
                leave(room, first + got, have - got)
    return runs, bins


def best_plan(histogram: dict[int, int], size: int = 4096) -> tuple[list, int]:
    """The plan with the fewest bins over a few group counts and bounds of "small"."""
    return min((plan(histogram, size, g, s) for g in (96, 400, size) for s in (4, 8, 32)), key=lambda p: p[1])


def pack(parts: DataFrame, size: int = 4096, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``parts`` (with a ``length`` from 1 to ``size``) plus sequence_id and offset: every
    row gets a place in a bin of ``size``, gapless from offset 0; as few bins as the plan finds.

    Only the histogram of lengths (at most ``size`` rows) goes to the driver,
    and only the plan, whose size the number of lengths bounds, goes back.
    Ranks within a length are counted in salted buckets first, so one length
    that holds any share of the rows is spread over tasks."""
    spark = parts.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    salt = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = cut(parts.withColumn("_salt", salt), "pieces")
    tally = rows.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = (Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    tally = cut(tally.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))), "tally")
    histogram = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_plan(histogram, size)
    if len(runs) > MAX_RUNS:
        raise RuntimeError(f"the plan holds {len(runs)} runs")
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    runs_b = spark.sparkContext.broadcast((table[:, 0] << 44 | table[:, 1], table))

    order = Window.partitionBy("length", "_salt").orderBy(*keys, *[c for c in ("ids_crc32",) if c in rows.columns])
    ranked = rows.withColumn("_n", F.row_number().over(order)).join(tally.drop("n"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_n") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys_, table_ = runs_b.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        run = table_[np.searchsorted(keys_, length << 44 | rank, "right") - 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + rank - run[:, 1], "offset": run[:, 4]})

    return ranked.withColumn("_place", place("length", "_rank")).select(*parts.columns, "_place.*")
