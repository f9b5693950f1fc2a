"""Language identification by spans: script ranges narrow the candidate languages of each word, words are scored by byte n-grams and
whole words learned from labelled texts, and a Viterbi pass with a penalty for each switch labels the spans of a text.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwave.llm.common import map_texts, mix, text_bytes, word_bounds, word_hashes

#: Labelled rows that are learned from: about so many in all, but of each language at least about LEAST_OF_LANGUAGE, or all it has.
TRAIN_LIMIT = 16_000
LEAST_OF_LANGUAGE = 200
SWITCH = 9.0
BITS = 16
#: Bytes of text that are scored together, with up to four languages; with more, fewer.
SLICE = 4 << 20
PART = 1 << 19

#: First and last code point of scripts; several ranges may be one script. A letter of none of them is of the last script, 31.
_RANGES = [
    (0, 0x41, 0x24F), (0, 0x1E00, 0x1EFF), (0, 0x2C60, 0x2C7F), (0, 0xFF21, 0xFF5A), (1, 0x370, 0x3FF), (1, 0x1F00, 0x1FFF), (2, 0x400, 0x52F), (2, 0x1C80, 0x1C8F), (2, 0x2DE0, 0x2DFF), (3, 0x530, 0x58F), (4, 0x590, 0x5FF), (5, 0x600, 0x6FF), (5, 0x750, 0x77F), (5, 0x8A0, 0x8FF),
    (5, 0xFB50, 0xFDFF), (5, 0xFE70, 0xFEFF), (6, 0x900, 0x97F), (7, 0x980, 0x9FF), (8, 0xA00, 0xA7F), (9, 0xA80, 0xAFF), (10, 0xB00, 0xB7F), (11, 0xB80, 0xBFF), (12, 0xC00, 0xC7F), (13, 0xC80, 0xCFF), (14, 0xD00, 0xD7F), (15, 0xD80, 0xDFF), (16, 0xE00, 0xE7F), (17, 0xE80, 0xEFF), (18, 0xF00, 0xFFF),
    (19, 0x1000, 0x109F), (20, 0x10A0, 0x10FF), (21, 0x1100, 0x11FF), (21, 0x3130, 0x318F), (21, 0xAC00, 0xD7AF), (22, 0x1200, 0x139F), (23, 0x1780, 0x17FF), (24, 0x1800, 0x18AF), (25, 0x3040, 0x30FF), (25, 0x31F0, 0x31FF), (26, 0x2E80, 0x2FDF), (26, 0x3400, 0x4DBF), (26, 0x4E00, 0x9FFF), (26, 0xF900, 0xFAFF), (26, 0x20000, 0x31FFF),
]
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 1 for letters, 2 for marks, which words may hold, else 0; the bit of its script."""
    if not _TABLES:
        size = 0x32000
        kind = np.zeros(size, np.uint8)
        for i in range(0x20000):
            c = unicodedata.category(chr(i))[0]
            kind[i] = 1 if c == "L" else 2 if c == "M" else 0
        kind[0x20000:] = 1
        script = np.full(size, 1 << 31, np.uint32)
        for bit, a, b in _RANGES:
            script[a : b + 1] = 1 << bit
        script[kind != 1] = 0
        _TABLES.update(kind=kind, script=script)
    return _TABLES["kind"], _TABLES["script"]


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which bytes are in words, the script bit at each letter's first byte, else 0) of UTF-8 bytes."""
    kind, script = _tables()
    inside = (kind[:256] == 1)[data] & (data < 128)
    bits = np.where(inside, script[65], 0).astype(np.uint32)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        x = data[lead].astype(np.int64)
        extra = 1 + (x >= 0xE0) + (x >= 0xF0)
        code = x & np.where(extra == 1, 0x1F, np.where(extra == 2, 0x0F, 0x07))
        for i in (1, 2, 3):
            more = extra >= i
            code[more] = (code[more] << 6) | (data[np.minimum(lead[more] + i, len(data) - 1)] & 0x3F)
        code = np.minimum(code, len(kind) - 1)
        part = kind[code] > 0
        bits[lead] = script[code]
        for i in (0, 1, 2, 3):
            at = lead[part & (extra >= i)] + i
            inside[at[at < len(data)]] = True
    return inside, bits


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: n-gram tables: byte pairs, triples, quadruples, whole words
ORDERS = (2, 3, 4, 0)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (table, slot, language): log-probability, float32
    scripts: np.ndarray  # a bit mask for each language: scripts of at least a hundredth of its letters


def _slots(texts: pa.Array):
    """(bytes, the script bit of each letter, starts and ends of words, first word of each text, the words with a space around each, where
    each of those begins)"""
    data, offsets = text_bytes(texts)
    inside, bits = _letters(data)
    starts, ends, first = word_bounds(data, offsets, inside=inside)
    # one padded buffer: a space before and after each word
    size = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(int(at[-1]), 32, np.uint8)
    if len(starts):
        inner = np.ones(int(at[-1]), bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        where = np.repeat(starts - at[:-1] - 1, size)[inner] + np.flatnonzero(inner)
        flat[inner] = _LOWER[data[where]]
    # upper-case letters of the Latin-1 supplement: C3 80..9E
    high = np.flatnonzero((flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[:-1] == 0xC3)) + 1 if len(flat) else []
    flat[high] += 0x20
    return data, bits, starts, ends, first, flat, at


def _gram(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat[: len(flat) - n + 1].astype(np.uint32)
    for i in range(1, n):
        x = (x << np.uint32(8)) | flat[i : len(flat) - n + 1 + i]
    if n > 2:
        x = (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return x.astype(np.int32)


def _features(flat: np.ndarray, at: np.ndarray, n: int, hashes: np.ndarray):
    """(slot of each gram, first gram of each word, number of grams of each word)"""
    if n == 0:
        return (hashes >> np.uint64(64 - BITS)).astype(np.int64), np.arange(len(hashes)), np.ones(len(hashes), np.int64)
    count = np.maximum(np.diff(at) - n + 1, 0)
    grams = _gram(flat, n) if len(flat) >= n else np.zeros(0, np.int32)
    keep = np.repeat(np.diff(at) - n + 1, np.diff(at)) > (np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at)))
    return grams[keep[: len(grams)]], np.cumsum(count) - count, count


def train(labelled: DataFrame, limit: int = TRAIN_LIMIT) -> Model:
    """Learn from (text, lang) of about `limit` rows, chosen by a hash of the text; of a language with few rows from LEAST_OF_LANGUAGE, or all
    it has. Rows without text or lang are left out; languages without a word in the rows chosen are not learned.

    The driver gets one number for each language and, in all, at most languages * 4 * 2^16 counts. Repeated rows count each; an empty
    table gives a model without languages.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text <> ''")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs, total = sorted(counts), sum(counts.values())
    shares = [(x, min(1.0, max(limit / total, LEAST_OF_LANGUAGE / counts[x]))) for x in langs]
    share = F.broadcast(spark.createDataFrame(shares, "lang string, _share double"))  # a row for each language
    chosen = rows.join(share, "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("_share") * (1 << 20))

    def make():
        index = {x: i for i, x in enumerate(langs)}

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, bits, starts, ends, first, flat, at = _slots(batch.column("text"))
            hashes = word_hashes(data, starts, ends)
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            of_word = np.repeat(lang, np.diff(first))
            keys = []
            for t, n in enumerate(ORDERS):
                slot, _, count = _features(flat, at, n, hashes)
                keys.append(((t * len(langs) + np.repeat(of_word, count)) << BITS) | slot)
            letters = np.flatnonzero(bits)
            of_letter = np.repeat(lang, np.diff(text_bytes(batch.column("text"))[1]))[letters]
            keys.append(((len(ORDERS) * len(langs) + of_letter) << BITS) | np.log2(bits[letters]).astype(np.int64))
            key, count = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], names=["key", "n"])

        return f

    counted = map_texts(chosen.select("text", "lang"), "text", "key long, n long", make, 1 << 20).groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    key, n = counted["key"].to_numpy(np.int64), counted["n"].to_numpy(float)
    table, lang, slot = (key >> BITS) // max(len(langs), 1), (key >> BITS) % max(len(langs), 1), key & ((1 << BITS) - 1)
    # languages with words
    shown = np.unique(lang[table == len(ORDERS) - 1])
    langs = [langs[i] for i in shown.tolist()]
    keep = np.isin(lang, shown)
    table, lang, slot, n = table[keep], np.searchsorted(shown, lang[keep]), slot[keep], n[keep]
    scores = np.zeros((len(ORDERS), 1 << BITS, len(langs)), np.float32)
    for t in range(len(ORDERS)):
        m = table == t
        scores[t] = np.float32(0.1)
        np.add.at(scores[t], (slot[m], lang[m]), n[m])
        scores[t] = np.log(scores[t] / scores[t].sum(0, dtype=np.float64)).astype(np.float32)
    scripts = np.zeros(len(langs), np.uint32)
    for i in range(len(langs)):
        m = (table == len(ORDERS)) & (lang == i)
        for bit, share_of in zip(slot[m].tolist(), n[m] / max(n[m].sum(), 1), strict=True):
            if share_of >= 0.01:
                scripts[i] |= np.uint32(1 << bit)
    return Model(langs, scores, scripts)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word: scores (words, labels), texts at first[i]..first[i + 1], `switch` paid at each change of label.
    All texts advance together, word by word; ties stay with the label at hand, then the lower one. For the way back a word has a bit for
    each label (whether it was come to from the best one) and the best label."""
    k = scores.shape[1]
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    path = np.zeros(len(scores), np.uint16)
    if not len(scores):
        return path
    moves = np.zeros((len(scores), -(-k // 8)), np.uint8)
    source = np.zeros(len(scores), np.uint16)
    live = np.searchsorted(-length, -np.arange(int(length[0]) + 1), side="left")  # texts of over t words
    value = scores[start[: live[0]]].astype(np.float64)
    ending = np.zeros(len(length), np.int64)
    for t in range(1, int(length[0]) + 1):
        m = int(live[t])
        if m < len(value):
            ending[m : len(value)] = np.argmax(value[m:], axis=1)
            value = value[:m]
        if not m:
            break
        best = np.argmax(value, axis=1)
        moved = (value[np.arange(m), best] - switch)[:, None]
        change = moved > value
        at = start[:m] + t
        moves[at] = np.packbits(change, axis=1)
        source[at] = best
        value = np.where(change, moved, value) + scores[at]
    state = np.zeros(0, np.int64)
    for t in range(int(length[0]) - 1, -1, -1):
        m = int(live[t])
        if m > len(state):
            state = np.concatenate([state, ending[len(state) : m]])
        at = start[:m] + t
        path[at] = state
        changed = (moves[at, state >> 3] >> (7 - (state & 7)).astype(np.uint8)) & 1
        state = np.where(changed == 1, source[at].astype(np.int64), state)
    return path


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """docs (doc_id, text, other columns kept unless named as the new ones) with lang_pred, score and n_spans, and `spans` (array of
    start, end (byte places in the UTF-8 text) and lang) if asked for.

    lang_pred has the most letters of the text (words of its language by their letters, each one code point); score is its share of the
    letters. Ties: the first language by name. Null texts, texts without letters, and all texts if no language was learned, are `und`, score 0.
    Long texts are taken whole; repeated rows are labelled each; an empty table gives none. Memory: a slice's words times languages, of
    which slices get smaller as languages get more, or one text's.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "n_spans", "spans", "_has_letter")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double, n_spans int"
    if spans:
        schema += ", spans array<struct<start:long,end:long,lang:string>>"
    ready = docs.select(*names, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_has_letter"))
    handed = docs.sparkSession.sparkContext.broadcast(model)  # one table of numbers for each language

    def make():
        m = handed.value
        k = len(m.langs)

        def score_words(texts: pa.Array):
            data, bits, starts, ends, first, flat, at = _slots(texts)
            hashes = word_hashes(data, starts, ends)
            out = np.zeros((len(starts), k), np.float32)
            for t, n in enumerate(ORDERS):
                slot, begin, count = _features(flat, at, n, hashes)
                if n == 0:
                    out += m.scores[t][slot]
                    continue
                got = np.flatnonzero(count)
                if len(got):
                    out[got] += np.add.reduceat(m.scores[t][slot], begin[got], axis=0) / (2.0 if n > 2 else 1.0)
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(bits > 0, out=total[1:])
            if len(starts):
                script = np.bitwise_or.reduceat(np.concatenate([bits, [np.uint32(0)]]), np.stack([starts, ends], 1).ravel())[::2]
                fits = (script[:, None] & m.scripts[None, :]) != 0
                out[~fits & fits.any(1)[:, None]] -= 50.0
            return out, starts, ends, first, total[ends] - total[starts]

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            from meshwave.llm.common import chunks

            parts, bounds = [], [[0]]
            places = []
            for part in chunks(batch, "text", PART):
                s, a, b, first, c = score_words(part.column("text"))
                parts.append(s)
                places.append((a, b, c))
                bounds.append(first[1:] + bounds[-1][-1])
            scores, first = np.concatenate(parts), np.concatenate(bounds)
            begin, end, size = (np.concatenate([x[i] for x in places]) for i in (0, 1, 2))
            path = viterbi(scores, first, switch).astype(np.int64) if k else np.zeros(len(scores), np.int64)
            n = batch.num_rows
            of = np.repeat(np.arange(n), np.diff(first))
            letters = np.bincount(of * max(k, 1) + path, weights=size, minlength=n * max(k, 1)).reshape(n, max(k, 1)) if k else np.zeros((n, 1))
            best = letters.argmax(1)
            total = letters.sum(1)
            ok = batch.column("_has_letter").to_numpy(zero_copy_only=False) & (total > 0)
            turn = np.full(len(path), k > 0)
            turn[1:] &= (path[1:] != path[:-1]) | (of[1:] != of[:-1])
            cols = [batch.column(c) for c in names] + [
                pa.array([m.langs[b] if o else "und" for b, o in zip(best, ok, strict=True)], pa.string()),
                pa.array(np.where(ok, letters[np.arange(n), best] / np.maximum(total, 1), 0.0)),
                pa.array(np.bincount(of[turn], minlength=n).astype(np.int32)),
            ]
            if spans:
                at = np.flatnonzero(turn)
                last = np.concatenate([at[1:], [len(path)]]) - 1 if len(at) else at
                rows: list[list] = [[] for _ in range(n)]
                for i, j in zip(at, last, strict=True):
                    rows[of[i]].append({"start": int(begin[i]), "end": int(end[j]), "lang": m.langs[path[i]]})
                if len(places) > 1 or n > 1:  # places count from the chunk's first byte
                    shift, done = [], 0
                    for part in chunks(batch, "text", PART):
                        shift += text_bytes(part.column("text"))[1][:-1].tolist()
                        done += part.num_rows
                    for r, d in zip(rows, shift, strict=True):
                        for x in r:
                            x["start"] -= d
                            x["end"] -= d
                cols.append(pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            return pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "score", "n_spans"] + ["spans"] * spans)

        return f

    return map_texts(ready, "text", schema, make, min(SLICE, max(64 << 10, SLICE * 4 // max(len(model.langs), 1))))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def learn_from_documents(docs: DataFrame) -> Model:
    return train(docs.where(~F.coalesce(held_out(), F.lit(False))).select("text", "lang"))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn_from_documents(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans")
