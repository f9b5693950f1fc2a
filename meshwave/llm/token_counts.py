"""Token counts that follow edits: a segment tree over a text's pre-tokens, of which an edit re-encodes only what it touches.

Leaves hold about LEAF pre-tokens with their code points and tokens; inner nodes hold the sums, and the tree is balanced by height. An
edit takes out the leaves it overlaps and enough before them that no earlier pre-token looked at the changed text, splits that piece
anew, and goes on to the right until a new pre-token begins where an old leaf did; from there on the old split holds. The new leaves
are joined with what stands left and right of them: only nodes on the way are summed anew.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwave.llm.common import map_texts

LEAF = 64
TOKENIZER = "byte_bpe_50k"
#: Code points behind a pre-token that its end may depend on, besides special strings.
LOOK = 4
_KNOWN = 300_000


class Encoder:
    """Pre-tokens and their token counts; counts of pre-tokens seen are kept, up to a bound. Special strings are tokens of their own."""

    def __init__(self, tokenizer: str = TOKENIZER):
        import regex
        import tiktoken

        with open(public_tokenizers.path(f"{tokenizer}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{tokenizer}.json"), encoding="utf-8") as f:
            self.special = sorted((t["content"] for t in json.load(f)["added_tokens"]), key=len, reverse=True)
        self.look = LOOK + max(map(len, self.special), default=0)
        self.between = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.plain = regex.compile(public_tokenizers.PATTERN).findall
        self.encoding = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = dict.fromkeys(self.special, 1)
        self.encoded = 0

    def split(self, text: str) -> list[str]:
        if not any(x in text for x in self.special):
            return self.plain(text)
        parts = self.between(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self.plain(part))]

    def count(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        if len(known) > _KNOWN:
            known.clear()
            known.update(dict.fromkeys(self.special, 1))
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = known[p] = len(self.encoding.encode_ordinary(p))
            out.append(n)
        self.encoded += len(pieces)
        return out


class Node:
    """A leaf (with pieces) or the sums of two nodes."""

    __slots__ = ("left", "right", "pieces", "chars", "tokens", "height")

    def __init__(self, left=None, right=None, pieces=None, chars=0, tokens=0):
        self.left, self.right, self.pieces = left, right, pieces
        if pieces is None:
            self.chars, self.tokens = left.chars + right.chars, left.tokens + right.tokens
            self.height = 1 + max(left.height, right.height)
        else:
            self.chars, self.tokens, self.height = chars, tokens, 0


def _balanced(a: Node, b: Node) -> Node:
    """a and b, whose heights differ by two at most, as one balanced node."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Node(a.left, Node(a.right, b))
        return Node(Node(a.left, a.right.left), Node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Node(Node(a, b.left), b.right)
        return Node(Node(a, b.left.left), Node(b.left.right, b.right))
    return Node(a, b)


def joined(a: Node | None, b: Node | None) -> Node | None:
    """All leaves of a, then those of b: as many new nodes as their heights differ."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return _balanced(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return _balanced(joined(a, b.left), b.right)
    return Node(a, b)


def parted(t: Node | None, at: int) -> tuple[Node | None, Node | None]:
    """The leaves before the one that holds code point `at` (the last one for places behind the end), and the others."""
    if t is None or t.pieces is not None:
        return None, t
    if at < t.left.chars:
        a, b = parted(t.left, at)
        return a, joined(b, t.right)
    a, b = parted(t.right, at - t.left.chars)
    return joined(t.left, a), b


def first_off(t: Node) -> tuple[Node, Node | None]:
    if t.pieces is not None:
        return t, None
    leaf, rest = first_off(t.left)
    return leaf, joined(rest, t.right)


def last_off(t: Node) -> tuple[Node | None, Node]:
    if t.pieces is not None:
        return None, t
    rest, leaf = last_off(t.right)
    return joined(t.left, rest), leaf


def first_leaves(t: Node | None) -> Iterator[Node]:
    """Leaves in order, found as they are asked for."""
    todo = [t] if t else []
    while todo:
        t = todo.pop()
        if t.pieces is not None:
            yield t
        else:
            todo += (t.right, t.left)


class SegmentTree:
    """Sums of code points and tokens over leaves of pre-tokens; a leaf's change updates the sums above it."""

    def __init__(self, text: str, encoder: Encoder):
        self.encoder = encoder
        self.root = self._grown(self._leaves(encoder.split(text)))

    @classmethod
    def of_leaves(cls, leaves: list[tuple[list[str], int]], encoder: Encoder) -> SegmentTree:
        """A tree of kept leaves (pre-tokens, tokens): nothing is encoded."""
        tree = cls.__new__(cls)
        tree.encoder = encoder
        tree.root = tree._grown([Node(pieces=list(p), chars=sum(map(len, p)), tokens=n) for p, n in leaves])
        return tree

    def _leaves(self, pieces: list[str]) -> list[Node]:
        if not pieces:
            return []
        cuts = list(range(0, len(pieces), LEAF))
        if len(cuts) > 1 and len(pieces) - cuts[-1] < LEAF // 2:
            cuts.pop()  # no small leaf behind a whole one
        parts = [pieces[i:j] for i, j in zip(cuts, [*cuts[1:], len(pieces)], strict=True)]
        return [Node(pieces=x, chars=sum(map(len, x)), tokens=sum(self.encoder.count(x))) for x in parts]

    @staticmethod
    def _grown(row: list[Node]) -> Node | None:
        while len(row) > 1:
            row = [joined(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return row[0] if row else None

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def leaves(self) -> list[list[str]]:
        return [x.pieces for x in first_leaves(self.root)]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replace `remove` code points from `at` on; both are cut to the text."""
        at = max(0, min(at, self.chars))
        remove = max(0, min(remove, self.chars - at))
        if not remove and not insert:
            return
        left, right = parted(self.root, max(0, at - self.encoder.look))
        old, look = [], self.encoder.look * 4
        if left is not None:  # a boundary that lies so far before the edit
            left, leaf = last_off(left)
            old += leaf.pieces
        start = left.chars if left else 0
        size = sum(map(len, old))
        while right is not None and start + size <= max(at, at + remove - 1):
            leaf, right = first_off(right)
            old += leaf.pieces
            size += leaf.chars
        text = "".join(old)
        new = text[: at - start] + insert + text[at - start + remove :]
        while True:  # until the old split goes on at the start of a leaf
            ahead, behind = first_leaves(right), ""
            for leaf in ahead:
                behind = "".join(leaf.pieces)
                break
            rest = ""
            for leaf in ahead:
                rest += "".join(leaf.pieces)
                if len(rest) >= look:
                    break
            pieces = self.encoder.split(new + behind + rest[:look])
            if not behind:
                break
            ends = list(accumulate(map(len, pieces)))
            if not new or len(new) in set(ends):
                pieces = pieces[: ends.index(len(new)) + 1] if new else []
                break
            new += behind
            _, right = first_off(right)
        # leaves that the edit leaves small are joined with their neighbours' pieces by the next edit there
        self.root = joined(joined(left, self._grown(self._leaves(pieces))), right)


def _edited(tree: SegmentTree, edits: list | None) -> None:
    for e in edits or []:
        if e is not None:
            tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")


def count_edits(docs: DataFrame, edits: str = "edits", tokenizer: str = TOKENIZER) -> DataFrame:
    """docs (doc_id, text, edits: array of (at, remove, insert), in order, each on the text the one before left) to doc_id,
    tokens_before, tokens_after, chars_after, pieces (pre-tokens of the text) and reencoded (those that the edits encoded anew).

    Places are code points; an edit is cut to the text; null texts, edits and inserts are empty. Special strings of the tokenizer count
    one token each. Rows are independent, repeats included; an empty table gives none. A long text's tree is held in its task alone.
    """

    def make():
        encoder = Encoder(tokenizer)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, todo in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                done = encoder.encoded
                tree = SegmentTree(text or "", encoder)
                before, pieces, done = tree.tokens, encoder.encoded - done, encoder.encoded
                _edited(tree, todo)
                rows.append((before, tree.tokens, tree.chars, pieces, encoder.encoded - done))
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "tokens_before", "tokens_after", "chars_after", "pieces", "reencoded"])

        return f

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(edits).alias("edits"))
    return map_texts(own, "text", "doc_id long, tokens_before long, tokens_after long, chars_after long, pieces long, reencoded long", make, 1 << 20)


TREES = "doc_id long, tokens long, chars long, reencoded long, leaves array<struct<text:string,sizes:array<int>,tokens:int>>"


def _kept(rows: list[tuple[int | None, SegmentTree, int]]) -> pa.RecordBatch:
    leaves = [[{"text": "".join(x.pieces), "sizes": [len(p) for p in x.pieces], "tokens": x.tokens} for x in first_leaves(t.root)] for _, t, _ in rows]
    kind = pa.list_(pa.struct([("text", pa.string()), ("sizes", pa.list_(pa.int32())), ("tokens", pa.int32())]))
    cols = [[d for d, *_ in rows], [t.tokens for _, t, _ in rows], [t.chars for _, t, _ in rows], [n for *_, n in rows]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(leaves, kind)], names=["doc_id", "tokens", "chars", "reencoded", "leaves"])


def trees_of(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs (doc_id, text) to their trees, to be written and edited later: doc_id, tokens, chars, reencoded (pre-tokens encoded) and leaves
    (text, sizes of its pre-tokens in code points, tokens). Null texts have no leaves; rows are independent."""

    def make():
        encoder = Encoder(tokenizer)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                done = encoder.encoded
                tree = SegmentTree(text or "", encoder)
                rows.append((doc, tree, encoder.encoded - done))
            return _kept(rows)

        return f

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", TREES, make, 1 << 20)


def edit_trees(trees: DataFrame, edits: str = "edits", tokenizer: str = TOKENIZER) -> DataFrame:
    """trees (doc_id, leaves, edits as in count_edits) to the trees after the edits; reencoded are the pre-tokens that these encoded anew.
    Leaves that no edit touches are neither split nor encoded again."""

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc, leaves, todo = (batch.column(c)[i].as_py() for c in ("doc_id", "leaves", "edits"))
                kept = []
                for leaf in leaves or []:
                    ends = list(accumulate(leaf["sizes"]))
                    kept.append(([leaf["text"][a:b] for a, b in zip([0, *ends], ends, strict=False)], leaf["tokens"]))
                tree, done = SegmentTree.of_leaves(kept, encoder), encoder.encoded
                _edited(tree, todo)
                rows.append((doc, tree, encoder.encoded - done))
            if rows:
                yield _kept(rows)

    return trees.select(F.col("doc_id").cast("long").alias("doc_id"), "leaves", F.col(edits).alias("edits")).mapInArrow(run, TREES)


def stated_edits(text: str = "text"):
    """Three edits of a text of n code points: 7 out at n / 4, a phrase in at n / 2, 5 at 3 n / 4 for their reverse."""
    n = F.char_length(F.coalesce(F.col(text), F.lit("")))
    one = lambda at, remove, insert: F.struct(at.cast("int").alias("at"), F.lit(remove).alias("remove"), insert.alias("insert"))
    third = F.floor(n * 3 / 4)
    return F.array(one(F.floor(n / 4), 7, F.lit("")), one(F.floor(n / 2), 0, F.lit(" [see also: 2nd edition] ")), one(third, 5, F.coalesce(F.reverse(F.substring(F.col(text), third.cast("int") + 1, F.lit(5))), F.lit(""))))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_edits(docs.withColumn("edits", stated_edits()))
