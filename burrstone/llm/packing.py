"""Sum-of-squares packing of token sequences into fixed windows.

Each task packs the documents of its input partition online. A document of more than a window gives whole windows
first; its rest is one item. counts[h] is the number of open windows filled to level h, of STEP tokens each. An item goes
to the level whose last window has room for it, or to a new window, so that the sum of squares of counts grows least;
ties go to the fullest level. A window that lacks less than a level is topped up with the first tokens of the next item,
which is cut there. A window that is full is closed and its pieces are given out, so a task holds only its open
windows, a few for each level whatever the size of its partition.

At the end of a task the windows still open are emptied into each other: the tokens of the least filled top up the
fullest. What is left below one window is cut at powers of two, which need no padding by the rule of lengths. So a
partition of any size wastes nothing, and packing needs no shuffle.

Cases: a null text is empty, and any document ends with the end id, so it has at least one token; rows that repeat an
id are packed each; a null id stays null; an empty table gives no rows; long texts are cut, never truncated; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from . import common

WINDOW = 4096
END_ID = 2
#: Tokens of a fill level; a window that lacks fewer is topped up with the head of the next piece.
STEP = 128
#: Pre-tokens whose ids a Python worker remembers; a full memory is emptied.
REMEMBERED = 400_000
#: Letters of extended Latin that are one character in lower case and in composed form.
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f"
#: Texts with a character outside this set, or with the start of a special token, go to the tokenizer whole: beyond
#: extended Latin composed forms may matter, superscripts and fractions are numbers but no digits, the dotted capital I
#: has two characters in lower case, and four control characters are white space to Python only.
_OTHER = re.compile("[^\x00-\x1b\x20-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u024f]")
#: The tokenizer's own split of the other texts, once lower-cased: letters, contractions, single digits, marks.
_CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
_SPLIT = re.compile(rf"[{_LETTERS}]+|{_CONTRACTIONS}|[0-9]|[^\s{_LETTERS}0-9]+")
_SPLIT_ASCII = re.compile(rf"[a-z]+|{_CONTRACTIONS}|[0-9]|[^\sa-z0-9]+")


def split(text: str) -> list[str] | None:
    """The pre-tokens of a text, or None for one that must go to the tokenizer whole."""
    if "<|" in text or _OTHER.search(text):
        return None
    return (_SPLIT_ASCII if text.isascii() else _SPLIT).findall(text.lower())


def _ranges(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[k]:start[k] + size[k]] for each k, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class _Numbers(dict):
    """Pre-tokens numbered as they come; new ones are listed."""

    def __init__(self, new: list[str]):
        super().__init__()
        self.new = new

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        self.new.append(piece)
        return k


class WordIds:
    """Ids of texts. The tokenizer lower-cases, drops white space and never merges across its pre-tokens, so the ids of
    a text are those of its pre-tokens in turn: each new one is numbered and encoded once, its ids are kept in one flat
    array, and the ids of many texts are gathered from there at once. The last id of a run of letters is the only one
    that carries the word end, so many new runs go to the tokenizer in one call, and its ids are cut at word ends.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.new: list[str] = []
        self.number = _Numbers(self.new)
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, "<u4")  # the ids of number k: flat[starts[k]:starts[k + 1]]

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self) -> None:
        """The ids of the pre-tokens numbered since the last time: runs of letters first, many in one call."""
        letters = [k for k, p in enumerate(self.new) if p.isalpha()]
        order, ids, sizes = [], [], []
        for at in range(0, len(letters), 5000):
            part = letters[at : at + 5000]
            made = self._raw("\n".join([self.new[k] for k in part]))
            stops = np.flatnonzero(self.ends[made]) + 1
            if len(stops) == len(part):
                ids.append(made)
                sizes.append(np.diff(stops, prepend=0))
            else:  # not one pre-token each after all
                each = [self._raw(self.new[k]) for k in part]
                ids.extend(each)
                sizes.append(np.array([len(x) for x in each]))
            order.extend(part)
        known = set(order)
        for k in range(len(self.new)):
            if k not in known:
                ids.append(self._raw(self.new[k]))
                sizes.append(np.array([len(ids[-1])]))
                order.append(k)
        # From the order in which they were encoded to the order of their numbers.
        size, flat = np.concatenate(sizes), np.concatenate(ids)
        start = np.cumsum(size) - size
        back = np.argsort(np.array(order), kind="stable")
        self.flat = np.concatenate([self.flat, _ranges(flat, start[back], size[back])])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(size[back])])
        self.new.clear()

    def _gather(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of texts from the numbers of their pre-tokens, for all of them at once."""
        k = np.concatenate(numbers)
        start = self.starts[k]
        size = self.starts[k + 1] - start
        ids = _ranges(self.flat, start, size)
        stops = np.concatenate([[0], np.cumsum(size)])[np.cumsum([len(n) for n in numbers])].tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts are taken in groups of about two million characters, so calls are few."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            if len(self.number) > REMEMBERED:
                self._empty()
            raw: dict[int, np.ndarray] = {}
            numbers: list[np.ndarray] = []
            first, size = at, 0
            while at < len(texts) and (at == first or size < 2_000_000):
                text = texts[at]
                pieces = split(text)
                if pieces is None:
                    raw[at - first] = self._raw(text)
                numbers.append(np.fromiter(map(self.number.__getitem__, pieces or ()), np.int64, len(pieces or ())))
                size += len(text)
                at += 1
            if self.new:
                self._learn()
            out.extend(raw.get(k, ids) for k, ids in enumerate(self._gather(numbers)))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


class Packer:
    """Online sum-of-squares packing. A piece is (document, start, length, bytes of its ids)."""

    def __init__(self, window: int = WINDOW, step: int = STEP):
        self.window, self.step = window, max(1, min(step, window // 2))
        levels = window // self.step + 1
        self.counts = np.zeros(levels, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(levels)]  # of each level its windows: fill and pieces
        self.top = np.zeros(levels, np.int64)  # the fill of each level's last window
        self.short: tuple[int, list] | None = None  # a window less than a step short, that waits for its last tokens

    def add(self, piece: tuple) -> list[list]:
        """Place a piece of at most a window; the windows that became full."""
        if piece[2] == self.window:
            return [[piece]]
        done = []
        if self.short:
            fill, pieces = self.short
            head, rest = _cut(piece, self.window - fill)
            pieces.append(head)
            self.short = (fill + head[2], pieces) if fill + head[2] < self.window else None
            if self.short is None:
                done.append(pieces)
            if rest is None:
                return done
            piece = rest
        size, n = piece[2], self.counts
        # Growth of the sum of squares if the last window of a level takes the piece: the level loses one, the one it
        # comes to, if it stays open, gains one.
        levels = np.flatnonzero((n > 0) & (self.top + size <= self.window))
        best, cost = -1, self._gain(size, -1)
        for level in levels[::-1].tolist():  # ties go to the fullest level
            grow = self._gain(int(self.top[level]) + size, level)
            if grow < cost or grow == cost and best < 0:
                best, cost = level, grow
        fill, pieces = (0, []) if best < 0 else self._pop(best)
        fill, pieces = fill + size, [*pieces, piece]
        if fill == self.window:
            done.append(pieces)
        elif self.window - fill < self.step:
            self.short = (fill, pieces)
        else:
            to = fill // self.step
            self.open[to].append((fill, pieces))
            self.counts[to] += 1
            self.top[to] = fill
        return done

    def _gain(self, fill: int, level: int) -> int:
        """What the sum of squared counts grows by if a window of a level (-1: a new one) comes to a fill."""
        n, to = self.counts, fill // self.step
        if to == level:
            return 0
        lost = 1 - 2 * int(n[level]) if level >= 0 else 0
        return lost + (2 * int(n[to]) + 1 if self.window - fill >= self.step else 0)

    def _pop(self, level: int) -> tuple[int, list]:
        out = self.open[level].pop()
        self.counts[level] -= 1
        self.top[level] = self.open[level][-1][0] if self.open[level] else 0
        return out

    def close(self) -> list[list]:
        """Empty the open windows into each other; the rest is cut at powers of two."""
        left = [self.short] * bool(self.short) + [w for level in reversed(self.open) for w in sorted(level, key=lambda w: -w[0])]
        left = [pieces for _, pieces in left]
        self.__init__(self.window, self.step)
        done, i = [], 0
        spare: list[tuple] = []  # pieces of the least filled windows
        while i < len(left):
            pieces = left[i]
            i += 1
            need = self.window - sum(p[2] for p in pieces)
            while need and (spare or i < len(left)):
                if not spare:
                    spare = left.pop()
                head, rest = _cut(spare.pop(), need)
                pieces.append(head)
                need -= head[2]
                if rest:
                    spare.append(rest)
            if need:
                spare = pieces
                break
            done.append(pieces)
        # Tokens left over when every window taken up was filled, or the last window itself.
        rest = spare[::-1]
        total = sum(p[2] for p in rest)
        while total >= self.window:
            rest, total = self._take(rest, self.window, done), total - self.window
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                rest = self._take(rest, 1 << bit, done)
        return done

    @staticmethod
    def _take(rest: list[tuple], size: int, done: list[list]) -> list[tuple]:
        out = []
        while size:
            head, tail = _cut(rest.pop(), size)
            out.append(head)
            size -= head[2]
            if tail:
                rest.append(tail)
        done.append(out)
        return rest


def _cut(piece: tuple, size: int) -> tuple[tuple, tuple | None]:
    doc, start, length, ids = piece
    if length <= size:
        return piece, None
    return (doc, start, size, ids[: 4 * size]), (doc, start + size, length - size, ids[4 * size :])


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for,
    ids (little-endian 32-bit). A sequence's id is its task's partition in the upper bits and a running number below.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        schema, names = schema + ", ids binary", [*names, "ids"]
    end = np.array([end_id], dtype="<u4")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path).encode_all
        packer, number = Packer(window), TaskContext.get().partitionId() << 40

        def give(full: list[list], out: dict) -> None:
            nonlocal number
            for pieces in full:
                at = 0
                for (doc, total), start, length, ids in pieces:
                    out["doc_id"].append(doc)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(ids))
                    out["doc_tokens"].append(total)
                    out["sequence_id"].append(number)
                    out["offset"].append(at)
                    if with_ids:
                        out["ids"].append(bytes(ids))
                    at += length
                number += 1

        for b in batches:
            out: dict = {n: [] for n in names}
            for doc, raw in zip(b["doc_id"], encode([t or "" for t in b["text"]]), strict=True):
                ids = memoryview(np.append(raw, end).tobytes())
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    part = ids[4 * start : 4 * (start + length)]
                    # An open window keeps its own copy, not the whole document.
                    give(packer.add(((doc, total), start, length, part if length == window else bytes(part))), out)
            yield out
        out = {n: [] for n in names}
        give(packer.close(), out)
        yield out

    return common.arrow_map(docs.select("doc_id", "text"), rows, schema)
