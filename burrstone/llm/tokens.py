"""Edit-aware token counts.

A document is split once into pre-tokens by the tokenizer's pattern; the merges of byte-pair encoding never cross a
pre-token, so the count of the document is the sum of its pre-tokens' counts. The pre-tokens are the leaves of a
segment tree: blocks of leaves at the bottom, and above them a binary tree whose nodes hold the characters and tokens
of their subtree. An edit (start, end, replacement) descends the tree to the leaves it touches, re-splits from a few
characters before the edit until a new boundary meets an old one, encodes only those pre-tokens, splices their
leaves, and updates the sums on the path to the root.

Cases: null and empty texts have no leaves and count 0; a null replacement is empty; positions are code points,
clamped to the text as it is at that time; edits apply in their given order; a null list is no edits; rows that repeat
are counted each; long texts are whole trees; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Leaves in a block when it is built, and when it is split.
BLOCK, BLOCK_MOST = 64, 256
#: Characters before an edit on which the split of the text before it may depend (contractions look three ahead).
CONTEXT = 4
#: Pre-tokens whose counts a task remembers; a full memory is emptied.
REMEMBERED = 300_000


class Counter:
    """Counts of pre-tokens under a rank file, remembered while they fit."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            encode = self.encoding.encode_ordinary
            for p in set(pieces).difference(known):
                known[p] = len(encode(p))
            return list(map(known.__getitem__, pieces))


class TokenTree:
    """The segment tree of one text. sums[k] holds (characters, tokens) of node k; the leaves of a node are blocks."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        pieces = counter.split(text)
        self.encoded = 0
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        counts = np.array(counter.counts(pieces), dtype=np.int64)
        self.blocks = [(sizes[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(pieces), BLOCK)]
        self._build()

    def _build(self) -> None:
        n = 1
        while n < max(1, len(self.blocks)):
            n *= 2
        self.base = n
        self.chars, self.tokens = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        for k, (s, c) in enumerate(self.blocks):
            self.chars[n + k], self.tokens[n + k] = s.sum(), c.sum()
        while n > 1:
            h = n // 2
            for a in (self.chars, self.tokens):
                a[h:n] = a[n : 2 * n : 2] + a[n + 1 : 2 * n : 2]
            n = h

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def leaves(self) -> int:
        return sum(len(s) for s, _ in self.blocks)

    def _block_at(self, position: int) -> tuple[int, int]:
        """The block that holds the character at a position, and the characters before that block."""
        k, before = 1, 0
        while k < self.base:
            k *= 2
            if position >= before + self.chars[k] and self.chars[k + 1]:
                before += int(self.chars[k])
                k += 1
        return k - self.base, before

    def _boundary_before(self, position: int) -> int:
        """The last leaf boundary at or before a position."""
        if position <= 0 or not self.blocks:
            return 0
        block, before = self._block_at(position)
        ends = before + np.cumsum(self.blocks[block][0])
        k = int(np.searchsorted(ends, position, side="right"))
        return int(ends[k - 1]) if k else before

    def _update(self, block: int) -> None:
        k = self.base + block
        s, c = self.blocks[block]
        self.chars[k], self.tokens[k] = s.sum(), c.sum()
        k //= 2
        while k:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            k //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by new."""
        size = len(self.text)
        start = min(max(0, start), size)
        end = min(max(start, end), size)
        first = self._boundary_before(max(0, start - CONTEXT))
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # Old boundaries at or after the edit, by their places in the new text, block by block as far as needed.
        pieces: list[str] = []
        at, goal = first, start + len(new)
        last = None
        old = self._boundaries_from(end)
        mark = next(old, None)
        for m in self.counter.pattern.finditer(self.text, first):
            pieces.append(m.group())
            at = m.end()
            if at < goal:
                continue
            while mark is not None and mark + shift < at:
                mark = next(old, None)
            if mark is not None and mark + shift == at:
                last = mark
                break
        if last is None:
            last = size
        self.encoded += len(pieces)
        self._splice(first, last, pieces)

    def _boundaries_from(self, position: int) -> Iterator[int]:
        if not self.blocks:
            return
        block, before = self._block_at(position)
        while block < len(self.blocks):
            for s in self.blocks[block][0]:
                if before >= position:
                    yield before
                before += int(s)
            block += 1
        if before >= position:
            yield before

    def _splice(self, first: int, last: int, pieces: list[str]) -> None:
        """Put new leaves in place of those that cover the old characters first to last."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        counts = np.array(self.counter.counts(pieces), dtype=np.int64)
        if not self.blocks:
            self.blocks = [(sizes, counts)]
            self._build()
            return
        a, before_a = self._block_at(first)
        b, before_b = self._block_at(last)
        (sa, ca), (sb, cb) = self.blocks[a], self.blocks[b]
        i = int(np.searchsorted(before_a + np.cumsum(sa), first, side="right"))
        j = int(np.searchsorted(before_b + np.cumsum(sb), last, side="right"))
        s = np.concatenate([sa[:i], sizes, sb[j:]])
        c = np.concatenate([ca[:i], counts, cb[j:]])
        if a == b and 0 < len(s) <= BLOCK_MOST:
            self.blocks[a] = (s, c)
            self._update(a)
            return
        # Whole blocks go or a block overflows: only the blocks between are cut anew, the nodes above are summed again.
        self.blocks[a : b + 1] = [(s[k : k + BLOCK], c[k : k + BLOCK]) for k in range(0, len(s), BLOCK)]
        self._build()


def count_edited(docs: DataFrame, ranks_path: str, pattern: str, edits_col: str = "edits") -> DataFrame:
    """Token counts of each document before and after its edits, an array of struct(start, stop, replacement).

    Returns doc_id, n_tokens, n_pretokens, n_edits, n_tokens_after, n_chars_after, n_reencoded (pre-tokens encoded for
    the edits). A row is worked on where it is read: nothing is shuffled.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        counter = Counter(ranks_path, pattern)
        for b in batches:
            out: dict = {k: [] for k in ("n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_chars_after", "n_reencoded")}
            for text, edits in zip(b["text"], b["edits"], strict=True):
                tree = TokenTree(text or "", counter)
                out["n_tokens"].append(tree.total)
                out["n_pretokens"].append(tree.leaves)
                out["n_edits"].append(len(edits or ()))
                for e in edits or ():
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                out["n_tokens_after"].append(tree.total)
                out["n_chars_after"].append(len(tree.text))
                out["n_reencoded"].append(tree.encoded)
            yield {"doc_id": b["doc_id"]} | out

    return common.arrow_map(
        docs.select("doc_id", "text", F.col(edits_col).alias("edits")), rows,
        "doc_id long, n_tokens long, n_pretokens long, n_edits int, n_tokens_after long, n_chars_after long, n_reencoded long",
    )


def revision_edits(text, key):
    """Three edits of a revision pass, placed by a hash of the id: a replaced phrase, an inserted note and a cut.

    Each position is taken modulo the length of the text, so every part of a corpus is edited.
    """
    size = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("long")
    at = [F.pmod(F.xxhash64(key, F.lit(k)), size) for k in range(3)]
    spans = [(at[0], at[0] + 24, " (revised wording) "), (at[1], at[1], "\nEditor's note: we've checked this.\n"), (at[2], at[2] + 60, "")]
    return F.array(*[
        F.struct(a.alias("start"), b.alias("stop"), F.lit(r).alias("replacement")) for a, b, r in spans
    ])
