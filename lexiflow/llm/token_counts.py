"""Token counts that survive edits: a segment tree over pre-token segments per document."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import stored, text_batches
from lexiflow.llm.tokens import byte_bpe_encoder, vocab_path

#: Characters of a segment, at least (it ends at the next place where pre-tokens always part).
SEGMENT = 512
#: A space after a character that is not white space: no pre-token spans this place, whatever else the text holds.
_PART = re.compile(r"(?<=\S)(?= )")


def segment_ends(text: str) -> list[int]:
    """Ends of the segments; the last is the length of the text (one empty segment for an empty text)."""
    ends, at = [], 0
    while len(text) - at > SEGMENT:
        m = _PART.search(text, at + SEGMENT)
        if not m:
            break
        at = m.start()
        ends.append(at)
    return [*ends, len(text)]


class SegmentTree:
    """Sums of characters and tokens over segments; node i has the children 2i and 2i + 1, leaves start at ``width``."""

    def __init__(self, chars: Sequence[int], tokens: Sequence[int]):
        self.leaves, self.width = len(chars), 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width:self.width + self.leaves] = np.stack([chars, tokens], axis=1)
        at = self.width
        while at > 1:
            self.sums[at // 2:at] = self.sums[at:2 * at].reshape(-1, 2, 2).sum(axis=1)
            at //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def find(self, offset: int) -> tuple[int, int]:
        """(leaf, its start) that holds the character at ``offset``; beyond the text the last leaf."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if offset >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.width, start

    def update(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def segment_counts(text: str, encode: Callable) -> tuple[list[int], list[int]]:
    """Characters and tokens of each segment: the leaves of the tree, which are what is kept."""
    ends = segment_ends(text)
    starts = [0, *ends[:-1]]
    return [e - s for s, e in zip(starts, ends)], [len(encode(text[s:e])) for s, e in zip(starts, ends)]


def build_tree(text: str, encode: Callable) -> SegmentTree:
    return SegmentTree(*segment_counts(text, encode))


def apply_to_tree(tree: SegmentTree, text: str, edits: Sequence[tuple[int, int, str]], encode: Callable) -> tuple[str, int, int]:
    """Apply edits (start, end, replacement; in order, apart, offsets of ``text``) to the tree.

    Returns the new text, the segments and the characters encoded again.  An edit
    concerns the segments of its characters and of one character on either side: with these
    unchanged at both ends, the places where the region meets its neighbours stay parting places.
    Segments that one region joins keep their leaves; the first takes the region's sums."""
    regions: list[list] = []
    for s, e, r in edits:
        (a, start), (b, last) = tree.find(max(0, s - 1)), tree.find(e)
        if regions and a <= regions[-1][1]:
            regions[-1][1], regions[-1][3] = max(b, regions[-1][1]), max(last, regions[-1][3])
            regions[-1][4].append((s, e, r))
        else:
            regions.append([a, b, start, last, [(s, e, r)]])
    out, at, again, chars = [], 0, 0, 0
    changes = []
    for a, b, start, last, own in regions:
        end = last + int(tree.sums[tree.width + b, 0])
        piece, p = [], start
        for s, e, r in own:
            piece += [text[p:s], r]
            p = e
        new = "".join([*piece, text[p:end]])
        out += [text[at:start], new]
        at, again, chars = end, again + b - a + 1, chars + len(new)
        changes.append((a, b, len(new), len(encode(new))))
    for a, b, n, tokens in changes:
        tree.update(a, n, tokens)
        for leaf in range(a + 1, b + 1):
            tree.update(leaf, 0, 0)
    return "".join([*out, text[at:]]), again, chars


#: What a redaction pass replaces (pattern, replacement).
REDACTIONS = (
    (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<email>"),
    (r"\+?\d[\d() -]{6,}\d", "<phone>"),
    (r"[#*$%&|]{2,}", ""),
)


@lru_cache
def _joined(rules: tuple[tuple[str, str], ...]) -> re.Pattern:
    return re.compile("|".join(f"({p})" for p, _ in rules))


def redactions(text: str, rules: Sequence[tuple[str, str]] = REDACTIONS) -> list[tuple[int, int, str]]:
    """The edits of a redaction pass over a whole text, leftmost first, none overlapping."""
    return [(m.start(), m.end(), rules[m.lastindex - 1][1]) for m in _joined(tuple(rules)).finditer(text)]


def build_trees(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept state, one row per input row: id_col, text, chars and tokens of the segments, n_tokens.

    NULL text counts as empty; repeated rows and NULL ids have rows of their own; an empty table gives
    no rows; other columns are not read.  Each whole text is encoded once, segment by segment."""
    text_batches(docs.sparkSession)
    path = tokenizer or vocab_path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = byte_bpe_encoder(path)
        for b in batches:
            leaves = [segment_counts(t, encode) for t in b["text"]]
            yield pd.DataFrame({id_col: b["id"], "text": b["text"], "chars": [x for x, _ in leaves], "tokens": [x for _, x in leaves],
                                "n_tokens": [sum(x) for _, x in leaves]})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"`{id_col}` {kind}, text string, chars array<int>, tokens array<int>, n_tokens long")


def apply_edits(trees: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = redactions, tokenizer: str | None = None,
                id_col: str = "doc_id") -> DataFrame:
    """The state after edits (columns as ``build_trees``), and n_tokens_before, n_edits, n_segments, segments_encoded, chars_encoded.

    ``edits`` gives a text's edits in order.  Row by row: no shuffle, and rows without an edit keep their state as it is."""
    text_batches(trees.sparkSession)
    path = tokenizer or vocab_path("byte_bpe_50k.json")
    kind = trees.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = byte_bpe_encoder(path)
        for b in batches:
            todo = [edits(t) for t in b["text"]]
            before, leaves = b["n_tokens"].to_numpy(np.int64), b["chars"].map(len).to_numpy(np.int64)
            out = b.assign(n_tokens_before=before, n_edits=[len(x) for x in todo], n_segments=leaves, segments_encoded=0, chars_encoded=0)
            changed = {c: out[c].tolist() for c in ("text", "chars", "tokens", "n_tokens", "segments_encoded", "chars_encoded")}
            for i, own in enumerate(todo):
                if own:
                    tree = SegmentTree(changed["chars"][i], changed["tokens"][i])
                    changed["text"][i], changed["segments_encoded"][i], changed["chars_encoded"][i] = apply_to_tree(tree, changed["text"][i], own, encode)
                    now = tree.sums[tree.width:tree.width + tree.leaves].astype(np.int32)
                    changed["chars"][i], changed["tokens"][i], changed["n_tokens"][i] = now[:, 0], now[:, 1], tree.total
            yield out.assign(**changed)

    return trees.select(id_col, "text", "chars", "tokens", "n_tokens").mapInPandas(
        run, f"`{id_col}` {kind}, text string, chars array<int>, tokens array<int>, n_tokens long, n_tokens_before long, n_edits long, "
             "n_segments long, segments_encoded long, chars_encoded long")


def count_through_edits(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = redactions, tokenizer: str | None = None,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Build the trees, keep them in the shared folder, and apply one round of edits to them."""
    return apply_edits(stored(build_trees(docs, tokenizer, id_col, text_col), "trees"), edits, tokenizer, id_col)
