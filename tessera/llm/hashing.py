"""64-bit hashes of all words of whole texts, without a lookup for each word.

A word is a run of letters and digits, in lower case by code point, cut after every LONGEST characters. Each word alone
decides where it is cut, so a text has the same words whatever stands beside it. A word's hash is a polynomial in its code
points: with running sums over all characters of many texts at once, one subtraction gives the sum of each word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import regex

#: Characters that are hashed at once; characters of a word before it is cut.
PIECE, LONGEST = 1 << 16, 32
#: Code points from here on are no letters or digits.
LAST = 0x32400
_GAP = regex.compile(r"[^\p{L}\p{N}]")
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each code point in lower case (0: none of a word), and the powers of the base and of its inverse."""
    chars = [chr(c) for c in range(LAST)]
    inside = set(regex.findall(r"[\p{L}\p{N}]", "".join(c for c in chars if not 0xD800 <= ord(c) < 0xE000)))
    low = np.array([ord(x) if c in inside and len(x := c.lower()) == 1 else ord(c) if c in inside else 0 for c in chars], np.uint64)
    code = np.append(np.where(low > 0, mixed(low * np.uint64(_BASE)) | np.uint64(1), np.uint64(0)), np.uint64(0))
    powers = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(2 * PIECE + 2, base, np.uint64)
        row[0] = 1
        powers.append(np.multiply.accumulate(row))
    return code, powers[0], powers[1]


def pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE characters, cut beside a character that no word has or where a long word is cut."""
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        gap = _GAP.search(text, end, end + PIECE // 2)
        if gap:
            end = gap.start()
        else:
            before = [m.end() for m in _GAP.finditer(text, max(start, end - 4096), end)][-1:] or [m.end() for m in _GAP.finditer(text, start, end)][-1:] or [start]
            end = before[0] + (end - before[0]) // LONGEST * LONGEST or end
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _hashed(parts: list[str], lines: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes, the number of words of each part, and the line ends before each word (nothing without `lines`)."""
    code, power, inverse = _tables()
    chars = np.frombuffer(" ".join(parts).encode("utf-32-le", "replace"), np.uint32)
    number = code.take(np.minimum(chars, LAST))
    inside = number != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(chars) and inside[0]:
        edge = np.append(0, edge)
    if len(edge) % 2:
        edge = np.append(edge, len(chars))
    start, end = edge[::2], edge[1::2]
    size = end - start
    if len(size) and size.max() > LONGEST:
        n = -(-size // LONGEST)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        last = np.repeat(end, n)
        start = np.repeat(start, n) + within * LONGEST
        end = np.minimum(start + LONGEST, last)
        size = end - start
    upto = np.empty(len(chars) + 1, np.uint64)
    upto[0] = 0
    np.cumsum(number * power[: len(chars)], out=upto[1:])
    found = mixed((upto[end] - upto[start]) * inverse[start] ^ size.astype(np.uint64))
    stops = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.searchsorted(start, stops), prepend=0)
    return found, counts, np.cumsum(chars == 10)[start] if lines else counts[:0]


def word_hashes(texts: list[str | None], lines: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, one after another; the number of words of each text; and, with `lines`, the
    number of line ends (of all texts) before each word."""
    sizes = np.zeros(len(texts), np.int64)
    out, ends, parts, of, held, breaks = [], [], [], [], 0, 0

    def flush() -> None:
        nonlocal parts, of, held, breaks
        found, counts, line = _hashed(parts, lines)
        np.add.at(sizes, of, counts)
        out.append(found)
        if lines:
            ends.append(line + breaks)
            breaks += sum(p.count("\n") for p in parts)
        parts, of, held = [], [], 0

    for k, text in enumerate(texts):
        for p in pieces(text) if text else ():
            if parts and held + len(p) + len(parts) > PIECE:
                flush()
            parts.append(p)
            of.append(k)
            held += len(p)
    if parts:
        flush()
    empty = np.empty(0, np.int64)
    return np.concatenate(out) if out else empty.astype(np.uint64), sizes, np.concatenate(ends) if ends else empty


def words_of(text: str | None) -> list[str]:
    """The words of a text as strings, where `word_hashes` has their hashes."""
    return [w.lower() for w in regex.findall(rf"[\p{{L}}\p{{N}}]{{1,{LONGEST}}}", text or "")]
