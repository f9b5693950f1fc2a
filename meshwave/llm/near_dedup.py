"""Near-duplicate documents: DartMinHash signatures of counted word shingles, banded joining, exact verification, components.

An element is a five-word shingle, its weight the number of times the text has it; similarity is the weighted Jaccard index. Each
unit of an element's weight is a strip of the plane weight x rank, on which a hash throws darts at unit rate: the first darts of a
strip, in order of rank, are the same for all texts that have the strip. About k ln k + 2 k darts of a text fall below its rank
limit; each dart names a coordinate, and the coordinate keeps the earliest. Two texts agree in a coordinate with the probability of
their similarity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwave.llm.common import SIMILARITY, drop_staged, id_filter, lookup, map_texts, maybe_in, mix, only_ids, partitions, shingles, stage_table, text_bytes, word_bounds, word_hashes
from meshwave.llm.components import components

BANDS = 25
ROWS = 5
#: Of a band with several components, so many texts are queries at first, then STEP times as many, then all others.
FIRST, STEP = 8, 8
#: Queries that a task holds at a time, and keys over which the texts that pass them are dealt.
BLOCK, SALT = 256, 8
#: A block of texts that are verified together: so many texts, or fewer long ones (every LONG bytes count as one more).
TILE, LONG = 256, 2048
#: A pair is verified unless its signatures agree in less than this share: five standard deviations below the similarity asked for.
LIKELY = 0.62
_LOW44 = np.uint64((1 << 44) - 1)


def cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell): a cell is one unit of weight of a shingle, a 44-bit number equal in all texts that have it; sorted by text."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_bounds(data, offsets)
    h, begin = shingles(word_hashes(data, starts, ends), first)
    of = np.repeat(np.arange(len(begin) - 1, dtype=np.uint64), np.diff(begin))
    key = np.sort((of << np.uint64(44)) | (h >> np.uint64(20)))
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    run = np.flatnonzero(new)
    unit = np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))  # the occurrence
    cell = mix((key & _LOW44) + unit.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(20)
    return (key >> np.uint64(44)).astype(np.int64), cell


def dart_signatures(of: np.ndarray, cell: np.ndarray, n: int, k: int, share: np.ndarray | None = None) -> np.ndarray:
    """uint32 signatures (n, k) of n texts from their cells. share: the part of each cell's strip that counts, for weights that are
    not whole. A text without cells has a row of the largest number."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n * k, top)
    weight = np.bincount(of, weights=share, minlength=n)
    limit = (k * math.log(k) + 2 * k) / np.maximum(weight, 1e-300)
    todo = weight > 0
    while todo.any():
        live = np.flatnonzero(todo[of])
        rank = np.zeros(len(live))
        step = 0
        while len(live):
            step += 1
            dart = mix(cell[live] + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            rank -= np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            inside = rank <= limit[of[live]]
            live, rank, dart = live[inside], rank[inside], dart[inside]
            name = mix(dart + np.uint64(0x632BE59BD9B4E019))
            counts = slice(None) if share is None else np.flatnonzero(((name >> np.uint64(40)).astype(np.float64) + 0.5) * 2.0**-24 < share[live])
            value = (rank[counts].view(np.uint64) & ~np.uint64(0xFFFFFF)) | (name[counts] & np.uint64(0xFFFFFF))
            np.minimum.at(best, of[live][counts] * k + ((name[counts] >> np.uint64(24)) % np.uint64(k)).astype(np.int64), value)
        grid = best.reshape(n, k)
        todo &= (grid == top).any(1)
        limit = limit * 2  # a coordinate without a dart: look further up
    out = (mix(best) >> np.uint64(32)).astype(np.uint32)
    out[best == top] = np.uint32(0xFFFFFFFF)
    return out.reshape(n, k)


def signatures(docs: DataFrame, k: int = BANDS * ROWS) -> DataFrame:
    """doc_id, key (digest of the text), n (shingles), sig (4 k bytes; null without words) of docs (doc_id, text)."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            of, cell = cells(batch.column("text"))
            n = batch.num_rows
            sig = dart_signatures(of, cell, n, k)
            count = np.bincount(of, minlength=n)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(count), pa.array([s.tobytes() if c else None for s, c in zip(sig, count, strict=True)], pa.binary())], names=["doc_id", "key", "n", "sig"]
            )

        return f

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("key"), text.alias("text"))
    return map_texts(ready, "text", "doc_id long, key string, n long, sig binary", make)


def weighted_jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Similarity of a[i] and b[i]; 0 where both are without words."""
    sides = []
    for x in (a, b):
        of, cell = cells(x)
        sides.append(np.sort((of.astype(np.uint64) << np.uint64(44)) | cell))
    n = len(a)
    common = np.bincount((np.intersect1d(*sides, assume_unique=True) >> np.uint64(44)).astype(np.int64), minlength=n)
    total = sum(np.bincount((s >> np.uint64(44)).astype(np.int64), minlength=n) for s in sides)
    return common / np.maximum(total - common, 1)


def linked_in(texts: pa.Array, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (texts[x[i]], texts[y[i]]) have the similarity. Where a text stands in many pairs its cells are marked once."""
    n = len(texts)
    if len(x) <= 2 * n:
        return weighted_jaccard(texts.take(pa.array(x)), texts.take(pa.array(y))) >= similarity
    of, cell = cells(texts)
    values, number = np.unique(cell, return_inverse=True)
    begin = np.searchsorted(of, np.arange(n + 1))
    size = np.diff(begin)
    some = np.flatnonzero(size)
    marked = np.zeros(len(values), bool)
    out = np.zeros(len(x), bool)
    by = np.argsort(x, kind="stable")
    edge = np.flatnonzero(np.diff(x[by], prepend=-1))
    for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(by)], strict=True):
        a = int(x[by[i]])
        own = number[begin[a] : begin[a + 1]]
        marked[own] = True
        common = np.zeros(n, np.int64)
        if len(some):
            common[some] = np.add.reduceat(marked[number], begin[some], dtype=np.int64)
        marked[own] = False
        other = y[by[i:j]]
        out[by[i:j]] = common[other] >= similarity * np.maximum(size[a] + size[other] - common[other], 1) - 1e-9
    return out


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (rep, block, text) have the similarity.

    Pairs are dealt by the blocks of their two texts, and a text goes to each pair of blocks once: so a group of n texts of which all
    pairs are asked for moves n * n / TILE texts, not n * n. Memory: the texts of two blocks, and those of the next pairs of blocks up to
    2 MB.
    """

    def run(batches):
        held: list[tuple] = []  # (rep, text) of the tiles at hand
        asked: list[tuple] = []
        size, tile = 0, None

        def flush():
            nonlocal held, asked, size
            if asked:
                where: dict[int, int] = {}
                texts_here = []
                for rep, text in held:
                    if rep not in where:
                        where[rep] = len(texts_here)
                        texts_here.append(text)
                a, b = (np.concatenate(z) for z in zip(*asked, strict=True))
                at = np.array([where[i] for i in a.tolist()], np.int64), np.array([where[i] for i in b.tolist()], np.int64)
                keep = linked_in(pa.array(texts_here, pa.large_string()), *at, similarity)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])
            held, asked, size = [], [], 0

        for batch in batches:
            t, a, b, text = (batch.column(n) for n in ("tile", "a", "b", "text"))
            key, first = t.to_numpy(), text.is_valid().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((key[1:] != key[:-1]) | (first[1:] != first[:-1])) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
                if i == j:
                    continue
                if key[i] != tile:
                    tile = key[i]
                    if size > 2 << 20:
                        yield from flush()
                if first[i]:
                    values = text.slice(i, j - i).to_pylist()
                    held += zip(a.slice(i, j - i).to_pylist(), values, strict=True)
                    size += sum(map(len, values))
                else:
                    asked.append((a.slice(i, j - i).to_numpy(), b.slice(i, j - i).to_numpy()))
        yield from flush()

    where = texts.select("rep", "block")
    placed = pairs.join(where.select(F.col("rep").alias("a"), F.col("block").alias("_p")), "a").join(where.select(F.col("rep").alias("b"), F.col("block").alias("_q")), "b")
    tiled = stage_table(placed.select(F.xxhash64(F.least("_p", "_q"), F.greatest("_p", "_q")).alias("tile"), "a", "b"), "tiles")
    here = tiled.select("tile", F.col("a").alias("rep")).union(tiled.select("tile", F.col("b").alias("rep"))).distinct().join(texts.select("rep", "text"), "rep")
    rows = here.select("tile", F.lit(0).alias("kind"), F.col("rep").alias("a"), F.lit(None).cast("long").alias("b"), F.coalesce("text", F.lit("")).alias("text")).union(tiled.select("tile", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text")))
    rows = rows.repartition(partitions(pairs.sparkSession), "tile").sortWithinPartitions("tile", "kind")
    return rows.select("tile", "a", "b", "text").mapInArrow(run, "a long, b long")


def blocks_of(texts: DataFrame, homes: DataFrame) -> DataFrame:
    """texts (rep, text) with block: texts of one home (homes: b, its leader a) share as many blocks as their number and length ask for."""
    housed = texts.join(homes.select(F.col("b").alias("rep"), F.col("a").alias("_a")), "rep", "left").withColumn("home", F.coalesce("_a", "rep")).drop("_a")
    housed = stage_table(housed, "housed")
    weight = 1 + F.octet_length(F.coalesce("text", F.lit(""))) / LONG
    size = housed.groupBy("home").agg(F.greatest(F.lit(1), F.ceil(F.sum(weight) / TILE)).alias("_n"), F.count(F.lit(1)).alias("n"))
    out = lookup(housed, size, "home").select("rep", "text", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("_n"))).alias("block"))
    out = stage_table(out, "texts")
    drop_staged(housed)
    return out


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) to a row for each row with an id: doc_id, key (the text's digest), class_id, class_key, first (whether the row
    has the smallest doc_id of its class and, of the texts with that id, the smallest digest; equal rows are all first)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = stage_table(signatures(docs, bands * rows), "signatures")
    # each distinct text has a number of its own: ids of documents may repeat
    known = signed.groupBy("key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"), F.min("sig").alias("sig"))
    known = stage_table(known.withColumn("rep", F.monotonically_increasing_id()), "known")
    signed_rows = stage_table(signed.select("doc_id", "key"), "rows")
    drop_staged(signed)
    reps = known.where("sig is not null").select("rep", "key", "sig")
    width = 4 * rows
    names = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("i"), F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))).alias("band")))
    banded = reps.select("rep", F.explode(names).alias("_b")).select("rep", "_b.i", "_b.band")
    led = banded.groupBy("band").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n"))
    members = stage_table(lookup(banded, led, "band"), "bands")  # band, rep, i, lead, size: of bands with more than one text
    pairs = stage_table(members.where("rep <> lead").groupBy(F.col("lead").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("n")), "pairs")
    involved = stage_table(members.select("rep").distinct().join(known.select("rep", "low", "key"), "rep"), "involved")
    # the most shared leader of each text first
    first = stage_table(pairs.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b"), "first")
    own = only_ids(docs, involved.select(F.col("low").alias("doc_id")).distinct()).withColumn("key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    texts = blocks_of(own.join(involved, (own["doc_id"] == involved["low"]) & (own["key"] == involved["key"])).dropDuplicates(["rep"]).select("rep", "text"), first)
    found = stage_table(components(stage_table(verify(first, texts, similarity), "links")), "components")

    def labelled(df: DataFrame, by: str, name: str) -> DataFrame:
        return df.join(found.select(F.col("id").alias(by), F.col("component").alias("_c")), by, "left").withColumn(name, F.coalesce("_c", by)).drop("_c")

    def joined_up(links: DataFrame) -> DataFrame:
        """found, with the components that the links join as one: the links are contracted first."""
        between = labelled(labelled(links, "a", "ca"), "b", "cb").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        merged = stage_table(components(between), "merged").select(F.col("id").alias("component"), F.col("component").alias("_to"))
        whole = found.union(merged.select(F.col("component").alias("id"), "component")).distinct()
        out = stage_table(whole.join(merged, "component", "left").select("id", F.coalesce("_to", "component").alias("component")).distinct(), "components")
        drop_staged(found)
        return out

    rest = labelled(labelled(pairs.join(first, ["a", "b"], "left_anti").select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    links = stage_table(verify(rest, texts, similarity), "links")
    if links.head(1):
        found = joined_up(links)

    # bands that still hold several components: texts outside their leader's component are queries, in the order of a hash
    turn = F.pmod(F.xxhash64("rep", "band"), F.col("size"))
    begin, end = 0, FIRST
    while begin is not None:
        mixed = labelled(labelled(members, "rep", "c"), "lead", "cl")
        asked = mixed.where("c <> cl").where(turn >= begin)
        if end is not None:
            asked = asked.where(turn < end)
        biggest = mixed.where("c <> cl").agg(F.max("size")).first()[0] or 0
        now = stage_table(asked.select("band", "i", "size", "rep", "c"), "queries")
        if now.head(1):
            met = stage_table(likely(now, mixed.select("band", "i", "rep", "c"), reps, rows).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "met")
            links = stage_table(verify(met, texts, similarity), "links")
            if links.head(1):
                found = joined_up(links)
            drop_staged(met, links)
        drop_staged(now)
        begin, end = (None, None) if end is None or biggest <= end else (end, end * STEP if end < FIRST * STEP else None)

    # a class's smallest doc_id, and of the texts that have it the smallest digest
    of_class = stage_table(found.join(known.select(F.col("rep").alias("id"), "key", "low", F.col("n").alias("_n")), "id"), "of-class")
    heads = of_class.groupBy("component").agg(F.min(F.struct("low", "key")).alias("h"), F.count(F.lit(1)).alias("n")).select("component", "n", F.col("h.low").alias("class_id"), F.col("h.key").alias("class_key"))
    linked = lookup(of_class.select("component", "key", F.col("_n").alias("many")), heads, "component").select("key", "class_id", "class_key", F.col("many").alias("n"))
    alone = known.join(of_class.select("key"), "key", "left_anti").select("key", F.col("low").alias("class_id"), F.col("key").alias("class_key"), "n")
    classes = stage_table(linked.union(alone), "classes")
    out = lookup(signed_rows, classes, "key")
    return out.withColumn("first", (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("class_key")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) to doc_id, class_id: the smallest doc_id of its class, one row for each row of docs.

    Classes are the components of two relations: equal texts (nulls are empty), and weighted Jaccard index of at least `similarity`.
    Texts without words link to equal texts alone. Rows without doc_id get class_id null. Equal rows get a row each. Rows that share an id
    and not the text are documents of their own, each in the class of its text. Long texts are taken whole; an empty table gives none.
    Columns besides doc_id and text are not read. A pair of exactly the similarity 0.8 shares none of the 25 bands with probability 5e-5.

    Each distinct text counts once. Every text is compared with the smallest one of each of its bands, the most shared one first; then,
    where a band holds texts of more than one component, those outside the component of its smallest one are queries against the band's
    other components, in up to three rounds. So no two similar texts of one band stay apart, and links inside a component are not asked for.
    """
    out = near_classes(docs, similarity, bands, rows).select("doc_id", "class_id")
    return out.union(docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id")))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the documents that repeat others: of each class of near-duplicates the row with the smallest doc_id stays (of several
    texts with that id, the one of the smallest digest; of equal rows, one), and rows without doc_id stay all.

    A Bloom filter finds the rows that may go; the rest pass without a shuffle.
    """
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    classes = near_classes(docs, similarity).groupBy("doc_id", "key").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 or not first")
    lost = stage_table(classes.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "first"), "lost").withColumn("_row", F.xxhash64("_id", "_key"))
    marked = docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), digest))
    maybe = F.col("doc_id").isNotNull() & maybe_in(id_filter(lost.select("_row").distinct(), "_row"), "_row")
    doubtful = stage_table(marked.where(maybe).withColumn("_own", digest), "doubtful")
    tested = doubtful.join(lost.drop("_row"), (doubtful["doc_id"] == lost["_id"]) & (doubtful["_own"] == lost["_key"]), "left").where("_id is null or first")
    return marked.where(~maybe).select(*docs.columns).union(tested.dropDuplicates(["doc_id", "_own"]).select(*(doubtful[c] for c in docs.columns)))


def likely(queries: DataFrame, members: DataFrame, reps: DataFrame, rows_of: int = ROWS, share: float = LIKELY) -> DataFrame:
    """Pairs (a < b) of a query and a member (band, i: the band's number, rep, c: component) of its band, of different components, whose
    signatures agree in that share of coordinates at least; a pair once, in the first band that it shares.

    A sorted stream: at most about BLOCK queries are held while the members pass, so pairs that differ are never rows. The queries of a band
    are dealt over groups by their number, its members over SALT keys with the queries at each.
    """
    width = 4096

    def pairs_of(i: int, held: list, ids: np.ndarray, c: np.ndarray, sig: np.ndarray):
        qi, qc, qs = np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.stack([h[2] for h in held])
        step = max(1, width // len(held))
        for at in (slice(k, k + step) for k in range(0, len(ids), step)):
            x, y = np.nonzero(((qs[:, None, :] == sig[None, at, :]).mean(2) >= share) & (qc[:, None] != c[None, at]))
            if len(x):
                same = (qs[x] == sig[at][y]).reshape(len(x), -1, rows_of).all(2)
                new = same.argmax(1) == i
                a, b = qi[x][new], ids[at][y][new]
                yield np.minimum(a, b), np.maximum(a, b)

    def run(batches):
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            group, number, kind, ids, c = (batch.column(n).to_numpy() for n in ("group", "i", "kind", "rep", "c"))
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
            edge = np.flatnonzero((group[1:] != group[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)], strict=True):
                if key != group[i]:
                    key, held = group[i], []
                if kind[i] == 0:
                    held += [(ids[r], c[r], sig[r].copy()) for r in range(i, j)]
                elif held:
                    for a, b in pairs_of(number[i], held, ids[i:j], c[i:j], sig[i:j]):
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    counted = queries.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_g"))
    part = F.pmod(F.xxhash64("rep"), F.col("_g"))
    asked = queries.join(counted, "band").select("band", "i", part.alias("_p"), "rep", "c")
    each = asked.select("band", "i", "_p", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_s"), F.lit(0).alias("kind"), "rep", "c")
    salt = F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(SALT)).cast("int")
    rest = members.join(counted, "band").select("band", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g").cast("long") - 1)).alias("_p"), salt.alias("_s"), F.lit(1).alias("kind"), "rep", "c")
    rows = each.union(rest).join(reps.select("rep", "sig"), "rep").withColumn("group", F.xxhash64("band", "_p", "_s"))
    rows = rows.repartition(partitions(queries.sparkSession), "group").sortWithinPartitions("group", "kind", "rep")
    return rows.select("group", "i", "kind", "rep", "c", "sig").mapInArrow(run, "a long, b long").distinct()


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
