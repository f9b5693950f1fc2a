"""Best-fit packing of token sequences: a configuration linear program over the length histogram.

The program has one variable for each multiset of lengths that fits a sequence (a configuration) and one covering row for each
length. Multiplicative weights price the rows: a row that has been served less weighs more. A knapsack dynamic program finds the
configuration of the highest price, which is added until one of its rows has moved by STEP of its demand, and so on until every row
is covered. The fractional cover is rounded down, and the pieces left over are covered by the same program in whole sequences.
All of this works on the histogram (at most `capacity` numbers) on the driver; documents are placed by their rank among those of
equal length, in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwave.llm.common import map_texts, stage_table

CAPACITY = 1024
TOKENIZER = "byte_bpe_50k"
END = 2
#: The part of its demand by which the most moved row of a round moves.
STEP = 0.25
#: A piece of length l is worth l (1 + TILT l / capacity) at first: long pieces, which fewer configurations hold, are not left to the end.
TILT = 0.3
#: The weight of a row that has got the share x of its demand falls as exp(-RATE x).
RATE = 0.05
SALT = 64


# ------------------------------------------------------------------ the plan, on the histogram


def price_knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length (ascending, distinct) is taken in a sequence of at most `capacity` tokens of the greatest total value
    (lengths may repeat). Ties: the shortest last piece."""
    price = np.full(capacity + 1, -np.inf)
    price[lengths] = values
    best = np.zeros(capacity + 1)  # backwards: the value of c tokens is at capacity - c
    took = np.zeros(capacity + 1, np.int64)
    top = 0.0
    for c in range(1, capacity + 1):
        gain = best[capacity - c + 1 :] + price[1 : c + 1]
        i = int(gain.argmax())
        if gain[i] > top:
            top, took[c] = float(gain[i]), i + 1
        best[capacity - c] = top
    use = np.zeros(capacity + 1, np.int64)
    c = capacity
    while c > 0:
        if took[c]:
            use[took[c]] += 1
            c -= int(took[c])
        else:
            c -= 1
    return use[lengths]


def filled(values: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """As price_knapsack, but no length more often than it is left: what is too much goes, and other lengths fill the room."""
    use = np.zeros(len(lengths), np.int64)
    live = np.flatnonzero(left > 0)
    room = capacity
    while len(live := live[lengths[live] <= room]):
        take = price_knapsack(values[live], lengths[live], room)
        some = np.minimum(take, left[live] - use[live])
        use[live] += some
        room -= int((some * lengths[live]).sum())
        if (some == take).all():
            break
        live = live[some == take]
    return use


def configuration_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, step: float = STEP, whole: bool = False) -> tuple[list[tuple[np.ndarray, float]], float]:
    """(a cover of the counts: (configuration, how many of it); the best lower bound on the number of sequences that the prices prove).

    Row l asks for counts[l] pieces. A round takes the configuration of the greatest price and adds so much of it that no row moves by
    more than `step` of its demand, one sequence at least (whole: whole numbers), and that no row gets more than it asks for. A price
    vector w proves the bound sum(counts w) / (price of the best configuration); bounds are taken at the first prices and at lengths.
    """
    want = counts.astype(float)
    done = np.zeros(len(lengths))
    worth = lengths * (1 + TILT * lengths / capacity)
    bound = float((lengths * want).sum() / capacity)
    found: dict[bytes, list] = {}
    while (live := np.flatnonzero(want - done > 1e-6)).size:
        share = done[live] / want[live]
        value = worth[live] * np.exp(-RATE * (share - share.min()))
        left = np.ceil(want[live] - done[live] - 1e-6).astype(np.int64)
        if not found:
            best = price_knapsack(value, lengths[live], capacity)
            bound = max(bound, float((value * want[live]).sum() / (value * best).sum()))
        use = filled(value, lengths[live], left, capacity)
        took = use > 0
        amount = max(1.0, step * float(np.min(want[live][took] / use[took])))
        amount = min(amount, float(np.min((want - done)[live][took] / use[took])))
        if whole:
            amount = float(max(1, int(amount + 1e-9)))
        done[live] += amount * use
        every = np.zeros(len(lengths), np.int64)
        every[live] = use
        found.setdefault(every.tobytes(), [every, 0.0])[1] += amount
    return [(c, x) for c, x in found.values()], bound


def plan_packing(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence, longest first) and how many sequences have them; together exactly the counts."""
    order = np.argsort(lengths)
    lengths, left = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order].copy()
    plan: dict[tuple[int, ...], int] = {}

    def put(use: np.ndarray, n: int) -> None:
        pattern = tuple(int(x) for x in np.repeat(lengths, use)[::-1])
        plan[pattern] = plan.get(pattern, 0) + n
        left[:] -= n * use

    fractional, _ = configuration_program(lengths, left, capacity)
    for use, amount in fractional:
        if n := int(amount + 1e-6):
            put(use, n)
    rest = np.flatnonzero(left)
    for use, amount in configuration_program(lengths[rest], left[rest], capacity, whole=True)[0]:
        every = np.zeros(len(lengths), np.int64)
        every[rest] = use
        put(every, int(amount))
    return sorted(plan.items())


# ------------------------------------------------------------------ documents


def _encoder(name: str):
    """ids of a text by the tokenizers file; its tiktoken form, several times as fast, gives the same ids for texts without special strings."""
    import base64
    import os

    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32. A null text has the end id alone; only documents of over
    `capacity` ids are cut, the first piece being the short one."""

    def make():
        ids_of = _encoder(tokenizer)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*(ids_of(text) if text else ()), end], dtype="<u4")
                a, b, k = 0, len(ids) % capacity or capacity, 0
                while a < len(ids):
                    b = min(b, len(ids))
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    a, b, k = b, b + capacity, k + 1
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return f

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", PIECES, make, 1 << 20)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, length of 1 to capacity, and any other columns) with sequence_id and offset.

    Equal rows are placed one by one; an empty table gives none. Memory: the driver and each task hold the plan, whose size is bounded by
    the number of lengths and steps, not by the rows. `pieces` is read twice, so pass a table or a staged one.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALT)).cast("int"))
    grouped = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    table = grouped.toPandas()  # at most capacity * SALT rows
    hist = table.groupby("length")["n"].sum()
    lengths, counts = hist.index.to_numpy(np.int64), hist.to_numpy(np.int64)
    plan = plan_packing(lengths, counts, capacity)

    # for each length: the ranks from which a slot of a pattern takes over, its first sequence, its place
    slots: dict[int, list[list[int]]] = {}
    sequence = 0
    for pattern, n in plan:
        offset = 0
        for size in pattern:
            s = slots.setdefault(size, [[0], [], []])
            s[0].append(s[0][-1] + n)
            s[1].append(sequence)
            s[2].append(offset)
            offset += size
        sequence += n
    slots_np = {k: tuple(np.array(x, np.int64) for x in v) for k, v in slots.items()}

    before = table.sort_values(["length", "_salt"]).assign(n=lambda t: t.groupby("length")["n"].cumsum() - t["n"])
    base = {(int(a), int(b)): int(n) for a, b, n in before[["length", "_salt", "n"]].itertuples(index=False)}
    start_of = spark.sparkContext.broadcast((slots_np, base))  # bounded: capacity * SALT numbers and the plan

    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"

    def place(batches):
        slots_here, base_here = start_of.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            salt = batch.column("_salt").to_numpy()
            rank = batch.column("_rank").to_numpy().astype(np.int64) - 1
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for pair in np.unique(length * SALT + salt):
                at = np.flatnonzero(length * SALT + salt == pair)
                size, s = int(pair) // SALT, int(pair) % SALT
                edges, first, place_at = slots_here[size]
                r = rank[at] + base_here[(size, s)]
                k = np.searchsorted(edges, r, side="right") - 1
                seq[at] = first[k] + (r - edges[k])
                off[at] = place_at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_salt", "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack documents (doc_id, text; other columns are left out): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id; long texts are cut into pieces and never held twice; equal rows, and rows that share an id or have
    none, are placed each; ties go by doc_id and piece; an empty table gives none.
    """
    return pack(stage_table(token_pieces(docs, capacity), "pieces"), capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
