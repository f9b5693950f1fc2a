import base64
import random

import public_tokenizers
import tiktoken
from meshwave.llm import token_counts as T
from tokenizers import Tokenizer


class Whole:
    """Counts of the tokenizers file itself, special strings included."""

    def __init__(self):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def encode_ordinary(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def full():
    return Whole()


def fast():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_edits_against_full_encoding():
    whole, enc, r = full(), T.Encoder(), random.Random(3)
    alpha = ["a", "b", " ", "  ", "\n", "'", "s", "'ll", "1", "é", "!", "word", "   ", "\t", "…", "汉", "don't", "<|endoftext|>", "<|endof", "text|>"]
    text = lambda n: "".join(r.choice(alpha) for _ in range(n))
    for _ in range(400):
        t = text(r.choice([0, 1, 5, 50, 400, 1500]))
        tree = T.SegmentTree(t, enc)
        assert tree.tokens == len(whole.encode_ordinary(t))
        for _ in range(4):
            at, gone, new = r.randrange(len(t) + 2), r.choice([0, 1, 3, len(t) // 3, len(t)]), text(r.choice([0, 1, 3, 200]))
            tree.edit(at, gone, new)
            at = min(at, len(t))
            t = t[:at] + new + t[at + gone :]
            assert tree.text() == t and tree.chars == len(t) and tree.tokens == len(whole.encode_ordinary(t))


def test_only_touched_regions_are_encoded():
    enc = T.Encoder()
    tree = T.SegmentTree("some words in a row, " * 5000, enc)
    before = enc.encoded
    tree.edit(50_000, 4, "other")
    assert enc.encoded - before <= 4 * T.LEAF


def test_sums_are_updated_along_paths(monkeypatch):
    """An insertion makes new leaves, but few new nodes, and the tree stays balanced."""
    tree = T.SegmentTree("some words in a row, " * 20_000, T.Encoder())
    made = []
    first = T.Node.__init__
    monkeypatch.setattr(T.Node, "__init__", lambda self, *a, **k: (made.append(1), first(self, *a, **k))[1])
    r = random.Random(1)
    for _ in range(50):
        made.clear()
        tree.edit(r.randrange(tree.chars), 3, "many new words here " * r.choice([0, 1, 40]))
        assert len(made) < 40 * 14
    assert tree.root.height <= 1.45 * len(tree.leaves).bit_length() + 1


def test_kept_trees(spark):
    """Trees written as a table and edited later are those of the edited texts; only touched pre-tokens are encoded."""
    rows = [(i, "some plain words, 12 of them. " * (i * 20)) for i in range(8)] + [(9, None), (None, "x<|endoftext|>y")]
    e = "array<struct<at:int,remove:int,insert:string>>"
    edits = spark.createDataFrame([(i, [(i * 37, 5, " new<|endoftext|>"), (0, 1, "")]) for i in range(8)], f"_id long, edits {e}")
    trees = T.trees_of(spark.createDataFrame(rows, "doc_id long, text string"))
    got = T.edit_trees(trees.join(edits, trees["doc_id"] == edits["_id"], "left")).collect()
    whole, by = full(), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = by[r["doc_id"]] or ""
        if r["doc_id"] is not None and r["doc_id"] < 8:
            at = min(r["doc_id"] * 37, len(t))
            t = (t[:at] + " new<|endoftext|>" + t[at + 5 :])[1:]
        assert "".join(x["text"] for x in r["leaves"]) == t and (r["tokens"], r["chars"]) == (len(whole.encode_ordinary(t)), len(t))
        assert r["reencoded"] <= 8 * T.LEAF


def test_documents(spark, small):
    whole = fast()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = T.op7_token_counts(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        t = docs[r["doc_id"]]
        n = len(t)
        assert r["tokens_before"] == len(whole.encode_ordinary(t))
        swap = t[n * 3 // 4 : n * 3 // 4 + 5][::-1]
        for at, gone, new in ((n // 4, 7, ""), (n // 2, 0, " [see also: 2nd edition] "), (n * 3 // 4, 5, swap)):
            at = min(at, len(t))
            t = t[:at] + new + t[at + gone :]
        assert (r["tokens_after"], r["chars_after"]) == (len(whole.encode_ordinary(t)), len(t))


def test_edge_cases(spark):
    e = "array<struct<at:int,remove:int,insert:string>>"
    data = [(1, None, [(0, 0, "new text")]), (2, "", None), (None, "abc", [None, (-5, 10**6, None)]), (3, "abc", [(99, 1, "d")]), (3, "abc", [(99, 1, "d")])]
    df = spark.createDataFrame([(*d, 1, 1) for d in data], f"doc_id long, text string, edits {e}, pieces int, reencoded int")
    n = len(full().encode_ordinary("abcd"))
    got = sorted((str(r["doc_id"]), r["tokens_before"], r["tokens_after"], r["chars_after"]) for r in T.count_edits(df).collect())
    assert got == sorted([("1", 0, 2, 8), ("2", 0, 0, 0), ("None", 1, 0, 0), ("3", 1, n, 4), ("3", 1, n, 4)])
    assert T.count_edits(df.limit(0)).count() == 0
