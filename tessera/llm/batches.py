"""Arrow batches of bounded size, and word ids of whole texts, for the operators that run Python on executors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows, and about as many bytes of text, that one step holds in memory.
ROWS, BYTES = 512, 4 << 20
#: Characters of a text that are split into words at once.
PIECE = 1 << 20


def plain(text: Column, kept: str = r"\p{L}\p{N}") -> Column:
    """The text in lower case with one space in place of all runs of other characters than those kept; null stays null."""
    return F.regexp_replace(F.lower(text), f"[^{kept}]+", " ")


def bounded(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has at most ROWS rows and, unless it is one row, about BYTES of text."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (i - start >= ROWS or held + n > BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE characters, cut at white space alone, so that no word depends on what is around it."""
    start = 0
    while len(text) - start > PIECE:
        gap = re.compile(r"\s").search(text, start + PIECE)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end
    yield text[start:] if start else text


class Ids(dict):
    """Ids of words in order of first sight, for rows that `make` computes; starts again when it holds `most` words."""

    def __init__(self, known: list[str], rows: np.ndarray, make: Callable[[list[str]], np.ndarray], most: int = 200_000):
        super().__init__(zip(known, range(len(known)), strict=True))
        self.known, self.first, self.make, self.most = known, rows, make, max(most, 2 * len(known))
        self.rows, self.used, self.new = rows, len(rows), []

    def __missing__(self, word: str) -> int:
        at = self.used + len(self.new)
        self.new.append(word)
        self[word] = at
        return at

    def settle(self) -> np.ndarray:
        """The rows of all ids given so far."""
        if self.new:
            made = self.make(self.new)
            need = self.used + len(made)
            if need > len(self.rows):
                grown = np.empty((max(need, 2 * len(self.rows)), *self.rows.shape[1:]), self.rows.dtype)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : need] = made
            self.used, self.new = need, []
        return self.rows

    def trim(self) -> None:
        """Forgets the words beyond the known ones if there are too many; ids given before are void then."""
        if self.used > self.most:
            self.clear()
            self.update(zip(self.known, range(len(self.known)), strict=True))
            self.rows, self.used = self.first, len(self.first)


#: Words longer than this are cut.
LONGEST = 32


def split_words(piece: str) -> list[str]:
    """The words of a `plain` text; each word alone decides whether it is cut."""
    words = piece.split()
    if max(map(len, words), default=0) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def word_ids(ids: Ids, text: str | None) -> np.ndarray:
    """The ids of all words of a `plain` text, in order."""
    if not text:
        return np.empty(0, np.int32)
    # __getitem__ through map: each word costs one lookup, new ones one call.
    parts = [np.fromiter(map(ids.__getitem__, split_words(p)), np.int32) for p in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
