import hashlib
import random
from collections import Counter

from meshwave.llm import fingerprint as P
from pyspark.sql import functions as F


def edited(rows):
    """The contract on (doc_id, text) in order: next document's start in place of the last half."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    return out


def run(spark, rows):
    return P.edited_fingerprints(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, rn int")).collect()


def test_contract_and_edge_cases(spark):
    rng = random.Random(0)
    text = lambda n: " ".join("wörd" + str(rng.randrange(40)) for _ in range(n))
    rows = [(rng.randrange(10**9) - 10**8, text(rng.randrange(60))) for _ in range(80)]
    rows += [(5, None), (6, ""), (7, "𝒳y"), (8, "spam " * 5000), (9, text(8000)), (10, " \n "), (None, "null id"), (None, None), rows[0], rows[0], (rows[3][0], "other text")]
    got = run(spark, rows)
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(edited(rows))
    prints = {}
    by = {(d, len(t or "")): t or "" for d, t in rows}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 256
        assert prints.setdefault(by[r["doc_id"], r["n_chars"]], r["fingerprint"]) == r["fingerprint"]
        if r["fingerprint"] == r["edited_fingerprint"]:
            assert r["near_edited"] == 1
    assert len(set(prints.values())) == len(prints)


def test_next_documents_agree(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in run(spark, rows)}
    ids = sorted(got)
    share = lambda a, b: sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 256, 4)) / 64
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        assert got[a]["near_next"] == share(got[a]["fingerprint"], got[b]["fingerprint"])
        assert got[a]["near_edited"] == share(got[a]["fingerprint"], got[a]["edited_fingerprint"])
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.9 * len(got)


def test_few_rows(spark):
    assert run(spark, []) == []
    (only,) = run(spark, [(1, "alone in the world")])
    assert only["near_next"] == 1 and only["edited_sha256"] == edited([(1, "alone in the world")])[0][2]


def test_order_counts(spark):
    """Moving blocks of words keeps the set of k-mers nearly whole, but not the fingerprint; an edit of one word keeps most of it."""
    rng = random.Random(1)
    w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    blocks = [w[i : i + 20] for i in range(0, 400, 20)]
    rng.shuffle(blocks)
    rows = [("same", " ".join(w)), ("edit", " ".join([*w[:200], "new", *w[201:]])), ("moved", " ".join(x for b in blocks for x in b)), ("other", " ".join(w[::-1]))]
    df = spark.createDataFrame(rows, "k string, text string")
    fp = {r["k"]: r["fingerprint"] for r in P.fingerprints(df.select("k", P.numbered_kmers(F.col("text")).alias("cell")), ["k"]).collect()}
    like = lambda k: sum(fp["same"][i : i + 4] == fp[k][i : i + 4] for i in range(0, 256, 4)) / 64
    assert like("edit") > 0.9 and 0.2 < like("moved") < 0.75 and like("other") < 0.1


def test_occurrences_against_brute_force(spark):
    """Each k-mer's n-th occurrence is an element of its own, equal in all texts; places are the words'."""
    texts = ["a b a b a b c", "a b c a b", "x", "spam " * 50, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", P.numbered_kmers(F.col("text")).alias("cell"))
    names = {}
    for r in df.collect():
        words = texts[r["k"]].strip().split() + ([""] if texts[r["k"]].endswith(" ") or not texts[r["k"]] else [])
        seen, want = Counter(), {}
        for i, pair in enumerate(zip(words, [*words[1:], None], strict=True)):
            want[i] = (pair, seen[pair])
            seen[pair] += 1
        assert sorted(c & ((1 << 27) - 1) for c in r["cell"]) == list(range(len(words)))
        for c in r["cell"]:
            assert names.setdefault(c >> 27, want[c & ((1 << 27) - 1)]) == want[c & ((1 << 27) - 1)]


def test_no_python_on_the_executors(spark, small):
    plan = P.op6_order_minhash(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_edited_text_in_sql(spark, small):
    import oracle

    df = P.op6_order_minhash(spark, small).select("doc_id", "n_chars", "edited_sha256")
    assert not oracle.difference(df, oracle.connect(small), P.EDITED_SQL)


def test_minima_and_tuples_against_brute_force(spark):
    """Each tuple is that of the smallest k-mer of either half, in text order, by the ranks that Spark's hash gives."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (1, 2, 3, 8, 40)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", P.numbered_kmers(F.col("text")).alias("cell"))
    got = {r["k"]: r["fingerprint"] for r in P.fingerprints(df, ["k"], 8).collect()}
    ranks = df.select("k", F.explode("cell").alias("v")).select("k", (F.col("v").bitwiseAND(F.lit((1 << 27) - 1))).alias("at"), F.shiftright("v", 27).alias("kmer")).crossJoin(spark.range(8).select(F.col("id").cast("int").alias("j"))).withColumn("rank", F.xxhash64("j", "kmer")).collect()
    hashes, need = {}, set()
    chosen = {}
    for k in range(len(texts)):
        for j in range(8):
            mine = [(r["rank"] & ((1 << 63) - 1) & ~((1 << 27) - 1), r["at"], r["kmer"], r["rank"] & 1) for r in ranks if (r["k"], r["j"]) == (k, j)]
            two = [min(((a, b, c) for a, b, c, h in mine if h == half), default=(0, 0, 0)) for half in (0, 1)]
            x, y = two
            # what a tuple hashes are the ranks' upper bits; an absent half is 0
            key = ((x[0] >> 27), (y[0] >> 27), None) if x[1] <= y[1] else ((y[0] >> 27), (x[0] >> 27), 1)
            chosen[k, j] = key
            need.add(key)
    plain = spark.createDataFrame([k[:2] for k in need if k[2] is None] or [(0, 0)], "x long, y long").withColumn("h", F.xxhash64("x", "y")).collect()
    turned = spark.createDataFrame([k[:2] for k in need if k[2]] or [(0, 0)], "x long, y long").withColumn("h", F.xxhash64("x", "y", F.lit(1))).collect()
    hashes.update({(r["x"], r["y"], None): r["h"] for r in plain})
    hashes.update({(r["x"], r["y"], 1): r["h"] for r in turned})
    for k in range(len(texts)):
        assert got[k] == "".join(f"{hashes[chosen[k, j]] & 0xFFFF:04X}" for j in range(8))


def test_aggregates_are_compiled(spark, small):
    """No aggregate has over 100 columns: Spark compiles none that has. K-mers of the part that a text and its edited text share are ranked once."""
    df = P.op6_order_minhash(spark, small)
    nodes, widths = [df._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Aggregate":
            widths.append(node.output().size())
    assert widths and max(widths) <= int(spark.conf.get("spark.sql.codegen.maxFields"))


def test_parts_of_two_texts(spark):
    """Fingerprints by parts are those of the whole text and the whole edited text, whatever is at the place where one is cut."""
    rng = random.Random(7)
    texts = ["", "a", " ", "a b", "ab cd ef gh", "  lead ing", "trail ing  ", "x " * 40, "same same same same"] + ["".join(rng.choice("ab  ") for _ in range(n)) for n in range(1, 40)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in run(spark, rows)}
    both = []
    for i, t in rows:
        h = len(t) // 2
        both += [(i, 0, t), (i, 1, t[: len(t) - h] + texts[(i + 1) % len(texts)][:h])]
    df = spark.createDataFrame(both, "k long, v int, text string").select("k", "v", P.numbered_kmers(F.col("text")).alias("cell"))
    want = {(r["k"], r["v"]): r["fingerprint"] for r in P.fingerprints(df, ["k", "v"]).collect()}
    assert all((got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (want[i, 0], want[i, 1]) for i, _ in rows)
