"""Packing documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docframe.llm.bpe import CACHE_PIECES, encoder, slices, vocabulary_path
from docframe.session import ship

WINDOW = 2048
PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
PIECES_SQL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
TEXTS = 64


class Packer:
    """Online packing of one partition.

    levels[h] counts the open windows that are filled to h.  A whole window of a document is a
    sequence of its own; what is left of it goes to the fill level that keeps the sum of the squared
    counts least (a new window is level 0), the fullest of equals.  flush() takes the emptiest open
    windows apart and places their pieces by the same rule, only that a piece may be cut to fill a
    window and none is opened; so one window at most is padded.
    """

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window, self.next = window, first_sequence
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        sequence, offset, out = self.next, 0, []
        self.next += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            out.append((doc, start, n, ids, total, sequence, offset))
            offset += n
        return out

    def level_for(self, size: int) -> int:
        """The fill level to put a piece on."""
        n, w = self.levels, self.window
        best, gain = 0, 2 * n[size] + 1  # a new window: from n to n + 1 at level size
        if size < w:
            fits = np.flatnonzero(n[1 : w - size + 1]) + 1
            if len(fits):
                to = np.where(fits + size < w, 2 * n[np.minimum(fits + size, w)] + 1, 0)
                gains = to - 2 * n[fits] + 1
                k = len(gains) - 1 - int(np.argmin(gains[::-1]))
                if gains[k] <= gain:
                    best = int(fits[k])
        return best

    def add(self, doc, ids: bytes) -> list[tuple]:
        """Pieces of the windows that this document closes."""
        total, step, out = len(ids) // 4, 4 * self.window, []
        whole = total // self.window
        for k in range(whole):
            out += self._close([(doc, k * self.window, ids[k * step : (k + 1) * step], total)])
        rest = total - whole * self.window
        if rest:
            level = self.level_for(rest)
            pieces = self.open[level].pop() if level else []
            self.levels[level] -= level > 0
            pieces.append((doc, whole * self.window, ids[whole * step :], total))
            if level + rest == self.window:
                out += self._close(pieces)
            else:
                self.open.setdefault(level + rest, []).append(pieces)
                self.levels[level + rest] += 1
        return out

    def fill_for(self, size: int) -> int:
        """The fill level to put a piece on if it may be cut to what fits; 0 if no window is open."""
        n, w = self.levels, self.window
        open_ = np.flatnonzero(n)
        if not len(open_):
            return 0
        to = np.where(open_ + size < w, 2 * n[np.minimum(open_ + size, w)] + 1, 0)
        gains = to - 2 * n[open_] + 1
        return int(open_[len(open_) - 1 - int(np.argmin(gains[::-1]))])

    def flush(self) -> list[tuple]:
        out = []
        while self.levels.any():
            least = int(np.flatnonzero(self.levels)[0])
            pieces = self.open[least].pop()
            self.levels[least] -= 1
            while pieces:
                doc, start, ids, total = pieces.pop()
                level = self.fill_for(len(ids) // 4)
                if not level:
                    return out + self._close([*pieces, (doc, start, ids, total)])
                n = min(self.window - level, len(ids) // 4)
                held = self.open[level].pop()
                self.levels[level] -= 1
                held.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.append((doc, start + n, ids[4 * n :], total))
                if level + n == self.window:
                    out += self._close(held)
                else:
                    self.open.setdefault(level + n, []).append(held)
                    self.levels[level + n] += 1
        return out


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), PIECES)], schema=PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, vocabulary: str | None = None, end_id: int = 1, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A document is the ids of its text (null: none) and end_id.  Each partition packs its own rows as
    they come, without a shuffle: memory is one open window per fill level at most a few times over,
    and a lost partition is packed alike again.  Sequence ids are unique, not dense.  Rows that repeat
    an id, and rows whose id is null, are documents of their own; of fill levels that tie the fullest
    takes the piece.  An empty table gives no pieces; other columns of docs, whatever their names, are
    ignored.  A long text is held whole, with its ids, by the task that encodes it.  cache_pieces bounds
    what a worker remembers, which changes its memory and time, not the ids.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary or vocabulary_path(), cache_pieces).encode
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        for batch in batches:
            for part in slices(batch, 1):
                found = list(zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())))
                for at in range(0, len(found), TEXTS):
                    out = []
                    for doc, ids in found[at : at + TEXTS]:
                        out += packer.add(doc, ids + end)
                    if out:
                        yield _batch(out)
        if out := packer.flush():
            yield _batch(out)

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, PIECES_SQL)
