"""Quality and toxicity of documents by hierarchical empirical Bayes.

Evidence of a text: log-odds of its words and of their shapes, learned by counting from labelled texts, and a few ratios, weighed by a
logistic regression. Sites: labelled documents are counted by host and by path within a host; a path's rate is shrunk toward its
host's and a host's toward the global rate, by prior strengths that the spread of the rates themselves sets (moments). A document's
own label is left out of its site's counts. The posterior odds of a document, for quality and for toxicity alike, are the evidence
odds times the site's odds over the global ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwave.llm.common import lookup, map_texts, mix, only_ids, stage_table, text_bytes, word_bounds, word_hashes

#: Labelled texts that the evidence is learned from, half for the counts and half for the regression; site counts use all labels.
TRAIN_LIMIT = 20_000
BITS = 18
KINDS = 4
COLUMNS = 5 * KINDS + 8
LEAST_SHOWN = 4
STRENGTH = (1.0, 10_000.0)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_CLASS = np.zeros(256, np.uint8)  # 1 lower or other letter, 2 upper, 3 digit, 4 plain mark, 5 odd mark
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 5
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4


def _tokens(texts: pa.Array):
    """(words, beginnings of 4 and 5 bytes, shapes): (slots, first slot of each text, sorted and distinct in a text); the ratios (texts, 8)."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    of = np.repeat(np.arange(n), np.diff(first))
    whole = word_hashes(data, starts, ends)
    a, b, core_first = word_bounds(data, offsets, _LETTER)
    core = word_hashes(data, a, b)
    core_of = np.repeat(np.arange(n), np.diff(core_first))
    cls = _CLASS[data]
    size = ends - starts
    counts = np.zeros((5, len(data) + 1), np.int32)
    for c in range(5):
        np.cumsum(cls == c + 1, out=counts[c, 1:])
    per = counts[:, ends] - counts[:, starts]
    tail = np.where(cls[np.maximum(ends - 1, 0)] >= 4, data[np.maximum(ends - 1, 0)], 0).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    before = np.zeros(len(whole), bool)
    before[1:] = (whole[1:] == whole[:-1]) & (of[1:] == of[:-1])
    upper = (per[1] > 1) & (per[1] >= per[0])
    shape = (tail << 8) | (np.minimum(per[4], 3).astype(np.int64) << 4) | (upper.astype(np.int64) << 2) | (before.astype(np.int64) << 1) | (per[2] > 0)
    slots = []
    begins = [word_hashes(data, a, np.minimum(b, a + k)) for k in (4, 5)]
    for h, who in ((core, core_of), *((x, core_of) for x in begins), (mix(shape.astype(np.uint64) + np.uint64(77)), of)):
        key = np.unique((who.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
        slots.append((key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(n + 1))))
    words = np.maximum(np.diff(first), 1)
    chars = np.maximum(np.diff(offsets), 1)
    total = counts[:, offsets[1:]] - counts[:, offsets[:-1]]
    ratios = np.stack([total[1] / chars, total[2] / chars, total[3] / chars, total[4] / chars, np.bincount(of, before, n) / words, np.bincount(of, upper, n) / words, np.bincount(of, size, n) / words / 10, np.log1p(np.diff(first)) / 10], 1)
    return slots, ratios


@dataclass
class Model:
    odds: np.ndarray  # (kind, slot): log-odds of the positive class
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    rate: float

    def features(self, texts: pa.Array) -> np.ndarray:
        slots, ratios = _tokens(texts)
        n = len(ratios)
        cols = []
        for k, (slot, first) in enumerate(slots):
            o = self.odds[k][slot].astype(np.float64)
            count = np.diff(first)
            got = np.flatnonzero(count)
            mean, most, least, strong, weak = (np.zeros(n) for _ in range(5))
            if len(got):
                mean[got] = np.add.reduceat(o, first[got]) / count[got]
                most[got] = np.maximum.reduceat(o, first[got])
                least[got] = np.minimum.reduceat(o, first[got])
                strong[got] = np.add.reduceat((o > 1.5).astype(float), first[got])
                weak[got] = np.add.reduceat((o < -1.5).astype(float), first[got])
            cols += [mean, most, least, np.log1p(strong), np.log1p(weak)]
        return np.concatenate([np.stack(cols, 1), ratios], 1)

    def logit(self, texts: pa.Array) -> np.ndarray:
        x = (self.features(texts) - self.center) / self.scale
        return self.weights[0] + x @ self.weights[1:]


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.concatenate([np.ones((len(x), 1)), np.clip((x - center) / scale, -8, 8)], 1)
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T * np.maximum(p * (1 - p), 1e-6) @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, center, scale


def train(labelled: DataFrame, label: str, limit: int = TRAIN_LIMIT) -> Model | None:
    """Learn P(label = 1) from (text, label) of about `limit` rows at most, chosen by a hash of the text; null texts and labels are
    left out. None if one of the classes is absent. The driver gets at most 2^18 counts a kind of token and COLUMNS numbers a row of the sample."""
    rows = labelled.where(F.col(label).isNotNull())
    total = rows.select(label).count()
    share = min(1.0, limit / max(total, 1))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    chosen = rows.where(F.col("text").isNotNull()).select("text", F.col(label).cast("int").alias("y"), place.alias("p")).where(F.col("p") < int(share * (1 << 20)) + 1)

    def count():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            y = batch.column("y").to_numpy().astype(np.int64)
            slots, _ = _tokens(batch.column("text"))
            keys = [((k * 2 + np.repeat(y, np.diff(first))) << BITS) | slot for k, (slot, first) in enumerate(slots)]
            keys.append((2 * KINDS + y) << BITS)
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

        return f

    def tally(rows: DataFrame):
        counted = map_texts(rows, "text", "key long, n long", count, 1 << 20).groupBy("key").agg(F.sum("n").alias("n")).toPandas()
        key, n = counted["key"].to_numpy(np.int64), counted["n"].to_numpy(float)
        return key, n, np.array([n[key == (2 * KINDS + c) << BITS].sum() for c in (0, 1)])

    key, n, docs = tally(chosen.where("p % 2 = 0"))
    if not docs.all():  # few different texts: one half lacks a class
        key, n, docs = tally(chosen)
    if not docs.all():
        return None
    odds = np.zeros((KINDS, 1 << BITS), np.float32)
    for k in range(KINDS):
        shown = np.zeros((2, 1 << BITS))
        for c in (0, 1):
            m = (key >> BITS) == k * 2 + c
            shown[c][key[m] & ((1 << BITS) - 1)] = n[m]
        value = np.log((shown[1] + 0.5) / (docs[1] + 1)) - np.log((shown[0] + 0.5) / (docs[0] + 1))
        odds[k] = np.where(shown.sum(0) >= LEAST_SHOWN, value, 0)
    model = Model(odds, np.zeros(COLUMNS + 1), np.zeros(COLUMNS), np.ones(COLUMNS), float(docs[1] / docs.sum()))
    handed = labelled.sparkSession.sparkContext.broadcast(model)  # KINDS * 2^18 numbers

    def features():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = handed.value.features(batch.column("text"))
            return pa.RecordBatch.from_arrays([pa.array(list(x)), batch.column("y")], names=["x", "y"])

        return f

    measured = lambda rows: map_texts(rows, "text", "x array<double>, y int", features, 1 << 20).toPandas()
    sample = measured(chosen.where("p % 2 = 1"))
    if sample["y"].nunique() < 2:
        sample = measured(chosen)
    model.weights, model.center, model.scale = _regress(np.stack(sample["x"].to_numpy()), sample["y"].to_numpy(float))
    return model


def strength(rates: DataFrame, n: str, good: str, about: str | None = None) -> float:
    """Prior strength (a number of labels) from the spread of group rates about the column `about`, or else about their common rate:
    moments of a beta-binomial, kept within STRENGTH."""
    center = F.lit(None).cast("double") if about is None else F.col(about)
    rows = rates.select(F.col(n).cast("double").alias("n"), F.col(good).cast("double").alias("g"), center.alias("c"))
    groups, total, hits, squares = (float(x or 0) for x in rows.agg(F.count(F.lit(1)), F.sum("n"), F.sum("g"), F.sum(F.col("n") * F.col("n"))).first())
    if groups < 2 or total <= groups:
        return STRENGTH[1]
    c = F.coalesce("c", F.lit(hits / total))
    between, within = (float(x or 0) for x in rows.agg(F.sum(F.col("n") * F.pow(F.col("g") / F.col("n") - c, 2)), F.sum(F.col("n") * c * (1 - c))).first())
    spread = within / total  # p (1 - p), as the mean over labels
    excess = (between - spread * (groups - 1)) / max(total - squares / total, 1e-9)
    if excess <= 0:
        return STRENGTH[1]
    return float(np.clip(spread / excess - 1, *STRENGTH))


def site_counts(labelled: DataFrame) -> tuple[DataFrame, float, float, float]:
    """labelled (host, path, y) to (host, path: path_n, path_good, host_n, host_good; the global rate; strengths of host and path priors).
    Null labels do not count; null hosts and paths are groups of their own. Summed before the shuffle, so a host with a third of all rows is
    one row a task."""
    counted = stage_table(labelled.where("y is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("path_n"), F.sum(F.col("y").cast("long")).alias("path_good")), "site-counts")
    hosts = counted.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_good").alias("host_good"))
    total, good = counted.agg(F.sum("path_n"), F.sum("path_good")).first()
    rate = ((good or 0) + 0.5) / ((total or 0) + 1.0)
    other = hosts.withColumnRenamed("host", "_host")
    sites = counted.join(other, counted["host"].eqNullSafe(other["_host"])).drop("_host")
    k_host = strength(hosts, "host_n", "host_good")
    return sites, rate, k_host, strength(sites.withColumn("_c", F.col("host_good") / F.col("host_n")), "path_n", "path_good", "_c")


def shrunk(prefix: str, y: Column, rate: float, k_host: float, k_path: float) -> tuple[Column, Column]:
    """(host rate, path rate) from the columns of site_counts under a prefix, the row's own label y left out where it has one."""
    own, hit = F.when(y.isNotNull(), 1).otherwise(0), F.coalesce(y, F.lit(0))
    count = lambda c: F.coalesce(F.col(prefix + c), F.lit(0))
    host = (count("host_good") - hit + F.lit(k_host * rate)) / (count("host_n") - own + F.lit(k_host))
    return host, (count("path_good") - hit + F.lit(k_path) * host) / (count("path_n") - own + F.lit(k_path))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def score(docs: DataFrame, labelled: DataFrame, limit: int = TRAIN_LIMIT, floor: float = 0.5, sample: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, host, path) and labelled (doc_id, text, host, path, quality, toxic: 0 or 1) to a row for each of docs: doc_id,
    evidence, host_rate, path_rate, quality, toxic (probabilities) and keep (quality of at least `floor`, toxic below a half).
    sample (text, quality, toxic): what the evidence is learned from, where that is at hand; labelled then needs no text.

    Null and empty texts have the evidence of a text without words; sites without labels have their host's rate, or the global one; a
    document with a label of its own at its site has the site's rate without it (of several labels of one id, the highest). Long texts are taken whole.
    Without labels of both classes evidence and rates are 0.5. Repeated rows are scored each, and labelled rows that repeat count each;
    nothing is ranked, so there are no ties; an empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    good, bad = (train(labelled if sample is None else sample, c, limit) for c in ("quality", "toxic"))
    handed = spark.sparkContext.broadcast((good, bad))

    def make():
        models = handed.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = batch.column("text")
            cols = [pa.array(np.clip(m.logit(x), -30, 30) if m else np.zeros(len(x))) for m in models]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), *cols], names=["doc_id", "host", "path", "_q", "_t"])

        return f

    site = [F.col(c).cast("string").alias(c) for c in ("host", "path")]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *site)
    scored = map_texts(own, "text", "doc_id long, host string, path string, _q double, _t double", make, 1 << 20)
    labels = labelled.groupBy(F.col("doc_id").cast("long").alias("_id"), *(c.alias(f"_{n}") for c, n in zip((F.col("host").cast("string"), F.col("path").cast("string")), ("host", "path"), strict=True))).agg(F.max(F.col("quality").cast("int")).alias("_yq"), F.max(F.col("toxic").cast("int")).alias("_yt")).where("_id is not null")
    same = (scored["doc_id"] == labels["_id"]) & scored["host"].eqNullSafe(labels["_host"]) & scored["path"].eqNullSafe(labels["_path"])
    scored = scored.join(labels, same, "left").select("doc_id", F.struct("host", "path").alias("site"), "_q", "_t", "_yq", "_yt")
    scored = stage_table(scored, "scored")
    # the sites of docs, each once, with their counts
    sites = scored.groupBy("site").agg(F.count(F.lit(1)).alias("n")).select("site", "site.host", "site.path", "n")
    priors = {}
    for y, name in (("quality", "q_"), ("toxic", "t_")):
        counts, *priors[name] = site_counts(labelled.select(*site, F.col(y).alias("y")))
        hosts = counts.select(F.col("host").alias("_h"), F.col("host_n").alias(name + "host_n"), F.col("host_good").alias(name + "host_good")).distinct()
        paths = counts.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("path_n").alias(name + "path_n"), F.col("path_good").alias(name + "path_good"))
        sites = sites.join(hosts, sites["host"].eqNullSafe(hosts["_h"]), "left").drop("_h")
        sites = sites.join(paths, sites["host"].eqNullSafe(paths["_h"]) & sites["path"].eqNullSafe(paths["_p"]), "left").drop("_h", "_p")
    joined = lookup(scored, stage_table(sites.drop("host", "path"), "sites"), "site")
    found = {}
    for name, y, evidence in (("q_", "_yq", "_q"), ("t_", "_yt", "_t")):
        rate = priors[name][0]
        host, path = shrunk(name, F.col(y), *priors[name])
        found[name] = host, path, 1 / (1 + F.exp(-(F.col(evidence) + _logit(path) - F.lit(float(np.log(rate / (1 - rate)))))))
    out = joined.select("doc_id", (1 / (1 + F.exp(-F.col("_q")))).alias("evidence"), found["q_"][0].alias("host_rate"), found["q_"][1].alias("path_rate"), found["q_"][2].alias("quality"), found["t_"][2].alias("toxic"))
    return out.withColumn("keep", (F.col("quality") >= floor) & (F.col("toxic") < 0.5))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Hosts are sources, paths the languages within a source; a document's labels are its highest ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, TRAIN_LIMIT / max(labels.count(), 1)) * (1 << 20)) + 1)
    chosen = stage_table(chosen, "labels")
    sample = stage_table(only_ids(docs.select("doc_id", "text"), chosen.select("doc_id")).join(chosen, "doc_id").select("text", "quality", "toxic"), "sample")
    return score(docs, docs.select("doc_id", "host", "path").join(labels, "doc_id"), sample=sample)
