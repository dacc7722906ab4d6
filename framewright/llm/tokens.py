"""Operator 2: token counts that follow edits.

A document's pre-tokens are the leaves of a tree whose nodes hold sums of characters and tokens. An edit finds its first
leaf by descending on characters, steps back over the leaves whose match may have looked at the edited place, and
matches and encodes from there until a match ends where an old one did behind the edit; what follows is the same text
and so keeps its tokens. Only the leaves between are replaced, and only the sums above them change. The trees of a corpus
can be kept as a table; a table of edits is then applied to it, and nothing that no edit touches is matched or encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, loaded, vocabulary
from .secrets import find

#: Leaves in a lowest node at first, and before it is split; pre-tokens before an edit whose match may have looked at it.
LEAVES, BACK = 64, 2


class Edit(NamedTuple):
    """Characters start to end - 1 of the text as it then is become text."""

    start: int
    end: int
    text: str


class TokenTree:
    """Token count of one text under edits."""

    def __init__(self, bpe: Bpe, text: str, leaves: tuple[list[int], list[int]] | None = None):
        """leaves: characters and tokens of each pre-token of the text, where they are known."""
        self.bpe, self.text = bpe, text
        self.encoded = 0  # pre-tokens encoded in all
        sizes, counts = leaves or self._leaves(text)
        self.nodes = [[sizes[k : k + LEAVES], counts[k : k + LEAVES]] for k in range(0, len(sizes), LEAVES)] or [[[], []]]
        self._sum_all()

    def _leaves(self, text: str) -> tuple[list[int], list[int]]:
        pieces = self.bpe.findall(text)
        sizes = list(map(len, pieces))
        if sum(sizes) != len(text):
            raise ValueError("the pattern leaves characters out")
        self.encoded += len(pieces)
        return sizes, list(map(len, map(self.bpe.pieces.__getitem__, pieces)))

    def _sum_all(self) -> None:
        """A binary tree over the lowest nodes: entry 1 is the root, entries wide and up are the lowest nodes."""
        self.wide = 1 << max(0, len(self.nodes) - 1).bit_length()
        self.chars = [0] * self.wide + [sum(a) for a, _ in self.nodes] + [0] * (self.wide - len(self.nodes))
        self.tokens = [0] * self.wide + [sum(b) for _, b in self.nodes] + [0] * (self.wide - len(self.nodes))
        for k in range(self.wide - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _sum_above(self, node: int) -> None:
        k = self.wide + node
        self.chars[k], self.tokens[k] = sum(self.nodes[node][0]), sum(self.nodes[node][1])
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of each pre-token."""
        return [x for a, _ in self.nodes for x in a], [x for _, b in self.nodes for x in b]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(lowest node, leaf in it, the leaf's first character) of the leaf that holds character `at`, or of the last one."""
        k, first = 1, 0
        while k < self.wide:
            k *= 2
            if first + self.chars[k] <= at and self.chars[k + 1]:
                first += self.chars[k]
                k += 1
        node = min(k - self.wide, len(self.nodes) - 1)
        leaf = 0
        sizes = self.nodes[node][0]
        while leaf + 1 < len(sizes) and first + sizes[leaf] <= at:
            first += sizes[leaf]
            leaf += 1
        return node, leaf, first

    def _back(self, node: int, leaf: int, first: int) -> tuple[int, int, int]:
        while leaf == 0:
            if node == 0:
                return 0, 0, 0
            node -= 1
            leaf = len(self.nodes[node][0])
        return node, leaf - 1, first - self.nodes[node][0][leaf - 1]

    def edit(self, edit: Edit) -> None:
        """Apply one edit; places beyond the text count as its end."""
        start = min(max(edit.start, 0), len(self.text))
        end = min(max(edit.end, start), len(self.text))
        new = self.text[:start] + edit.text + self.text[end:]
        node, leaf, first = self._find(start)
        for _ in range(BACK):
            node, leaf, first = self._back(node, leaf, first)
        grown = len(edit.text) - (end - start)
        sizes, counts = [], []
        last, old = node, first  # the lowest node and character up to which old leaves go
        gone = leaf  # leaves of node `last` before the first that stays
        at = first
        for m in self.bpe.finditer(new, first):
            piece = m.group()
            if m.start() != at:
                raise ValueError("the pattern leaves characters out")
            at = m.end()
            sizes.append(len(piece))
            counts.append(len(self.bpe.pieces[piece]))
            if at < start + len(edit.text):
                continue
            while old < at - grown:
                while gone == len(self.nodes[last][0]):
                    last, gone = last + 1, 0
                old += self.nodes[last][0][gone]
                gone += 1
            if old == at - grown and old >= end:
                break
        else:
            last, gone = len(self.nodes) - 1, len(self.nodes[-1][0])
        self.encoded += len(sizes)
        self.text = new
        sizes = self.nodes[node][0][:leaf] + sizes + self.nodes[last][0][gone:]
        counts = self.nodes[node][1][:leaf] + counts + self.nodes[last][1][gone:]
        if last == node and len(sizes) <= 2 * LEAVES:
            self.nodes[node] = [sizes, counts]
            self._sum_above(node)
        else:
            self.nodes[node : last + 1] = [[sizes[k : k + LEAVES], counts[k : k + LEAVES]] for k in range(0, len(sizes), LEAVES)] or [[[], []]]
            self._sum_all()


def redactions(text: str) -> list[Edit]:
    """Edits, last first, that put a mark in the place of every secret."""
    out: list[Edit] = []
    for a, _, z in sorted(find(text), reverse=True):
        if not out or z <= out[-1].start:
            out.append(Edit(a, z, "[REDACTED]"))
        elif a < out[-1].start:
            out[-1] = Edit(a, max(z, out[-1].end), "[REDACTED]")
    return out


def count_tokens(docs: DataFrame, editor: Callable[[str], list[Edit]] = redactions, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_pieces, n_encoded) for every row of docs.

    n_tokens counts the text as it is; n_tokens_edited counts it after the edits that `editor` gives, applied in turn;
    n_pieces counts pre-tokens, n_encoded those that the edits made it encode again. A null text counts as empty.
    Repeated rows and null ids are kept; other columns are ignored; an empty table gives an empty result. One narrow
    pass; memory holds one Arrow batch, one document's tree and bounded memos.
    """
    data = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_pieces", "n_encoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(data.value, pattern)
        for batch in batches:
            rows: list[list[int]] = [[] for _ in names[1:]]
            for text in batch.column(1):
                tree = TokenTree(bpe, text.as_py() or "")
                before, pieces = tree.count, tree.encoded
                edits = editor(tree.text)
                for edit in edits:
                    tree.edit(edit)
                for column, value in zip(rows, (before, len(edits), tree.count, pieces, tree.encoded - pieces), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in rows)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{x} long" for x in names))


TREES = "doc_id long, text string, sizes array<int>, counts array<int>, n_tokens long, n_encoded long"


def _tree_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in TREES.split(", ")])


def trees(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """A tree for every row of docs, as TREES: text, characters and tokens of its pre-tokens, sum of the tokens.

    A null text counts as empty; repeated rows and null ids are kept; other columns are ignored.
    """
    data = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(data.value, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = TokenTree(bpe, text.as_py() or "")
                rows.append((doc, tree.text, *tree.leaves, tree.count, tree.encoded))
            yield _tree_rows(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TREES)


def edited(kept: DataFrame, edits: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The trees of kept (see TREES) after edits (doc_id, seq, start, end, text), as TREES; n_encoded counts pre-tokens encoded anew.

    A document's edits apply in the order of seq, then start, end and text, each to the text as it then is; a null text
    deletes, a null start or end is that of the text, and edits without doc_id or of unknown ones do nothing. Every row
    that repeats a doc_id is edited. Documents without edits pass through. A document's edits meet in one task; edits
    are combined before the trees are joined to them, and the join is one that Spark can split.
    """
    data = kept.sparkSession.sparkContext.broadcast(vocabulary(path))
    said = F.struct(F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = edits.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(said)).alias("edits"))  # of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(data.value, pattern)
        for batch in batches:
            rows = []
            for doc, text, sizes, counts, n_tokens, todo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not todo:
                    rows.append((doc, text, sizes, counts, n_tokens, 0))
                    continue
                tree = TokenTree(bpe, text, (sizes, counts))
                for e in todo:
                    tree.edit(Edit(e["start"] or 0, len(tree.text) if e["end"] is None else e["end"], e["text"]))
                rows.append((doc, tree.text, *tree.leaves, tree.count, tree.encoded))
            yield _tree_rows(rows)

    return kept.join(own, "doc_id", "left").select("doc_id", "text", "sizes", "counts", "n_tokens", "edits").mapInArrow(run, TREES)
