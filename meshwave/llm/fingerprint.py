"""Order MinHash fingerprints in DataFrame functions.

A text's k-mers are pairs of neighbouring words, numbered by occurrence. A tuple of the fingerprint holds two k-mers of the smallest ranks
under one hash order, in the order in which the text has them, hashed to 16 bits; so it changes with the words and with their order.
Likeness is the share of equal tuples.

The two are the smallest k-mer of either half, where a bit of the rank deals the k-mers to halves: so they are never the same k-mer, and
in half of all cases they are the two smallest of all. The exact second smallest would need a state that no aggregate function of
DataFrames has (they keep one minimum each), a second pass over all k-mers, or sorted lists, at more than the cost allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwave.llm.common import partitions

TUPLES = 64
#: Tuples whose minima are taken in one row.
SLICE = 16
_POS = 27
_HASH = (1 << 36) - 1
_MASK = (1 << _POS) - 1
_TOP = (1 << 63) - 1


def _let(value: Column, body) -> Column:
    """body(value), the value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def numbered_kmers(text: Column) -> Column:
    """array<long>: hash of (k-mer, occurrence), 36 bits, then the k-mer's place, 27 bits; one for each word, the last without a follower.

    Equal k-mers become neighbours by a sort; an occurrence is the distance from the first of its run. Texts of over 2^27 words raise.
    """
    last = F.lit(_MASK).cast("long")

    def place(tokens: Column) -> Column:
        placed = F.transform(tokens, lambda w, i: F.shiftleft(F.xxhash64(w, F.get(tokens, i + 1)).bitwiseAND(F.lit(_HASH)), _POS).bitwiseOR(i.cast("long")))
        return F.when(F.size(tokens) <= _MASK, placed).otherwise(F.raise_error("a text has over 2^27 words").cast("array<bigint>"))

    def number(s: Column) -> Column:
        n = F.size(s)
        key = lambda i: F.shiftright(F.get(s, i), _POS)
        runs = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (key(i) != key(i - 1)))
        renamed = lambda a, j: F.shiftleft(F.xxhash64(key(j), j - a).bitwiseAND(F.lit(_HASH)), _POS).bitwiseOR(F.get(s, j).bitwiseAND(last))
        return _let(
            runs,
            lambda r: F.flatten(
                F.transform(
                    r, lambda a, i: _let(F.coalesce(F.get(r, i + 1), n), lambda b: F.when(b == a + 1, F.array(F.get(s, a))).otherwise(F.transform(F.sequence(a, b - 1), lambda j: F.when(j == a, F.get(s, j)).otherwise(renamed(a, j)))))
                )
            ),
        )

    return _let(F.sort_array(_let(F.split(text, r"\s+"), place)), number)


def _tuple(a: Column, b: Column) -> Column:
    x, y = F.shiftright(a, _POS), F.shiftright(b, _POS)
    ordered = F.when(a.bitwiseAND(F.lit(_MASK)) <= b.bitwiseAND(F.lit(_MASK)), F.xxhash64(x, y)).otherwise(F.xxhash64(y, x, F.lit(1)))
    return F.lpad(F.hex(ordered.bitwiseAND(F.lit(0xFFFF))), 4, "0")


def _minima(rows: DataFrame, keys: list[str], tuples: int) -> DataFrame:
    """keys, _g and, for each tuple _g + j of a slice, _a{j} and _b{j}, the smallest k-mers of either half; rows: keys and _v, one k-mer.

    Tuples go in slices of equal width, at most SLICE: generated code of more columns is not compiled as one, and runs at half the speed.
    """
    width = -(-tuples // -(-tuples // SLICE))
    rows = rows.select(*keys, "_v", F.explode(F.array(*(F.lit(g) for g in range(0, tuples, width)))).alias("_g"))
    kmer, at = F.shiftright(F.col("_v"), _POS), F.col("_v").bitwiseAND(F.lit(_MASK))
    minima = []
    for j in range(width):
        rank = F.xxhash64(F.col("_g") + F.lit(j), kmer)
        placed = rank.bitwiseAND(F.lit(_TOP & ~_MASK)).bitwiseOR(at)
        # all ones for the half that the k-mer is not in; without a branch, so that the hash is computed once
        other = F.shiftrightunsigned(-rank.bitwiseAND(F.lit(1)), 1)
        minima.append(F.min(placed.bitwiseOR(other)).alias(f"_a{j}"))
        minima.append(F.min(placed.bitwiseOR(other.bitwiseXOR(F.lit(_TOP)))).alias(f"_b{j}"))
    return rows.groupBy(*keys, "_g").agg(*minima)


def _slices(minima: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _g and _part, the tuples of the slice in hex digits."""
    width = sum(c.startswith("_a") for c in minima.columns)
    own = lambda c: F.when(F.col(c) < F.lit(_TOP), F.col(c)).otherwise(F.lit(0).cast("long"))  # noqa: E731  a half without k-mers: 0
    return minima.select(*keys, "_g", F.concat(*(_tuple(own(f"_a{j}"), own(f"_b{j}")) for j in range(width))).alias("_part"))


def _whole(tuples: int, of: Column | None = None) -> Column:
    """The fingerprint of the slices of a group, of those alone that `of` is true for."""
    width = -(-tuples // -(-tuples // SLICE))
    parts = [F.max(F.when(F.col("_g") == g if of is None else of & (F.col("_g") == g), F.col("_part"))) for g in range(0, tuples, width)]
    return F.substring(F.concat(*parts), 1, 4 * tuples)


def fingerprints(cells: DataFrame, keys: list[str], tuples: int = TUPLES) -> DataFrame:
    """cells: keys, which name a row, and cell (array<long> of numbered_kmers); returns keys and fingerprint (4 hex digits a tuple).
    Only fixed-size minima are kept for a text while its k-mers pass; null and empty arrays have the fingerprint of no k-mers."""
    rows = cells.select(*keys, F.explode_outer("cell").alias("_v"))
    return _slices(_minima(rows, keys, tuples), keys).groupBy(*keys).agg(_whole(tuples).alias("fingerprint"))


def likeness(a: Column, b: Column, tuples: int = TUPLES) -> Column:
    """Share of equal tuples of two fingerprints, 0 to 1."""
    same = F.filter(F.sequence(F.lit(0), F.lit(tuples - 1)), lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)))
    return F.size(same) / F.lit(float(tuples))


def _bucket(ids: Column, cuts: list[int]) -> Column:
    """How many cuts are smaller than the id, in two steps of about sqrt(len(cuts)) comparisons; nulls go behind the last."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda xs: "array(" + ", ".join(f"{int(x)}L" for x in xs) + ")"
    outer = F.size(F.filter(F.expr(longs(g[-1] for g in groups)), lambda c: c < ids))
    inner = _let(outer, lambda o: o * step + F.coalesce(F.size(F.filter(F.get(F.expr("array(" + ", ".join(map(longs, groups)) + ")"), o), lambda c: c < ids)), F.lit(0)))
    return F.when(ids.isNull(), F.lit(len(cuts))).otherwise(F.least(inner, F.lit(len(cuts))))


def with_next(docs: DataFrame, per_partition: int = 8) -> tuple[DataFrame, Window]:
    """docs (doc_id, text) in buckets of neighbouring ids, each with the first rows of the bucket behind it (`extra`, the last bucket
    with the first of all), and the window that orders a bucket: the next row of a row that is not extra is the next document.

    One shuffle by bucket; cuts are approximate quantiles of doc_id, as many as partitions * per_partition. Order: doc_id, nulls last, then text.
    """
    spark = docs.sparkSession
    count = partitions(spark) * per_partition
    shares = ", ".join(repr(i / count) for i in range(1, count))
    cuts = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {count * 20})")).first()[0] if count > 1 else None
    cuts = sorted(set(cuts or []))
    own = docs.select("doc_id", "text", _bucket(F.col("doc_id"), cuts).alias("bucket"))
    firsts = {r["bucket"]: r["low"] for r in docs.select("doc_id", _bucket(F.col("doc_id"), cuts).alias("bucket")).where("doc_id is not null").groupBy("bucket").agg(F.min("doc_id").alias("low")).collect()}  # one number a bucket
    order = sorted(firsts)
    last = max([len(cuts) if docs.where("doc_id is null").head(1) else -1, *order], default=0)
    target = {firsts[b]: (order[i - 1] if i else last) for i, b in enumerate(order)}
    extra = docs.limit(0).select("doc_id", "text", F.lit(0).alias("bucket"))
    if target:
        small = F.broadcast(spark.createDataFrame(list(target.items()), "doc_id long, bucket int"))  # one row a bucket
        extra = docs.join(small, "doc_id").select("doc_id", "text", "bucket")
        if last == len(cuts) and order and order[-1] != last:  # ids without a number stand alone in the last bucket
            extra = extra.union(own.where("doc_id is null").select("doc_id", "text", F.lit(order[-1]).alias("bucket")))
    both = own.withColumn("extra", F.lit(False)).union(extra.withColumn("extra", F.lit(True)))
    return both, Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").asc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame, tuples: int = TUPLES) -> DataFrame:
    """For each row of docs (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next document in
    ascending doc_id (then text; ids that are null come last), the last document's next being the first. Null texts are empty; rows
    that repeat are documents of their own; a single document is its own next. Empty texts share one fingerprint. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both, order = with_next(own)
    n, half = F.char_length("text"), F.expr("cast(char_length(text) div 2 as int)")
    ready = both.withColumn("rn", F.row_number().over(order)).withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit("")))
    kept = F.substring(F.col("text"), F.lit(1), n - half)
    # k-mers before `same` are of words that end within what is kept: both texts have them at the same places, by the same numbers
    same = F.greatest(F.size(F.split(kept, r"\s+")) - 2, F.lit(0)).alias("same")
    ready = ready.select("bucket", "rn", "doc_id", "extra", n.cast("long").alias("n_chars"), "text", same, F.concat(kept, F.substring(F.col("_next"), F.lit(1), half)).alias("_edited"))
    # keys of a k-mer are numbers, the digest too
    sha = [f"sha{i}" for i in range(4)]
    keys = ["bucket", "rn", "doc_id", "extra", "n_chars", *sha]
    sides = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("_edited").alias("t")))
    hashed = ready.withColumn("sha", F.sha2(F.col("_edited").cast("binary"), 256))
    cells = hashed.select(*keys[:5], *(F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("long").alias(c) for i, c in enumerate(sha)), "same", F.inline(sides))
    rows = cells.select(*keys, "same", "v", F.explode_outer(numbered_kmers(F.col("t"))).alias("_v"))
    early = F.col("_v").bitwiseAND(F.lit(_MASK)) < F.col("same")
    # part 0: k-mers of both, taken from the text; 1: those of the text alone; 2: of the edited text alone
    parts = rows.where(~(early & (F.col("v") == 1))).select(*keys, F.when(early, 0).otherwise(F.col("v") + 1).alias("part"), "_v")
    of_parts = _minima(parts, [*keys, "part"], tuples)
    of_both = of_parts.withColumn("v", F.explode(F.when(F.col("part") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("part") - 1))))
    minima = [c for c in of_parts.columns if c.startswith(("_a", "_b"))]
    found = of_both.groupBy(*keys, "v", "_g").agg(*(F.min(c).alias(c) for c in minima))
    paired = _slices(found, [*keys, "v"]).groupBy(*keys).agg(_whole(tuples, F.col("v") == 0).alias("fingerprint"), _whole(tuples, F.col("v") == 1).alias("edited_fingerprint"))
    paired = paired.withColumn("sha", F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in sha))))
    paired = paired.withColumn("_next", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("rn")))
    return paired.where(~F.col("extra")).select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), tuples).alias("near_edited"), likeness(F.col("fingerprint"), F.coalesce("_next", "fingerprint"), tuples).alias("near_next"),
    )


def op6_order_minhash(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: What SQL can say of the query: the number of code points and the edited text.
EDITED_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
o as (select doc_id, t, cast(length(t) as bigint) as n, coalesce(lead(t) over (order by doc_id, t), first_value(t) over (order by doc_id, t)) as nxt from d)
select doc_id, n as n_chars, sha256(substr(t, 1, n - n // 2) || substr(nxt, 1, n // 2)) as edited_sha256 from o
"""
