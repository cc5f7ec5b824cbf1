"""Splitting of texts into the words of a byte-level BPE vocabulary, vectorised over whole batches.

The rule is the split pattern of the public byte-level vocabularies: a contraction, or a run of letters, of
numbers or of other signs with at most one space before it, or white space, whose last character is left to the
word that follows.  Instead of matching a pattern text by text, the class of every code point of a batch is
looked up in a table and word borders come from comparing neighbouring classes.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE = range(4)
# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.frombuffer(bytes(kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8).copy()
    out[WHITE_SPACE] = SPACE
    return out


def borders(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions at which a word begins.  cp: code points of all texts; starts: first positions of the non-empty texts."""
    n = len(cp)
    kind = classes()[cp]
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[starts] = True
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[starts] = True
    text_start[n] = True
    first = np.flatnonzero(new)  # of each run
    end = np.append(first[1:], n)
    run = kind[first]
    follows = ~text_start[end]  # another run of the same text comes next

    gap = (run == SPACE) & follows
    edge = end[gap] - 1
    new[edge] = True  # the last character of white space before a word stands by itself ...
    joined = edge[cp[edge] == 0x20]
    new[joined + 1] = False  # ... and a blank goes with the word

    quote = np.flatnonzero((run == OTHER) & (end - first == 1) & follows)
    quote = quote[cp[first[quote]] == 0x27]
    at = first[quote]
    bare = text_start[at] | (cp[at - 1] != 0x20)
    quote, at = quote[bare], at[bare]
    letters = run[quote + 1] == LETTER
    at, stop = at[letters], end[quote[letters] + 1]
    if len(at):
        a = cp[at + 1]
        b = np.where(at + 2 < stop, cp[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        size = np.where(one, 2, np.where(two, 3, 0))
        short = size > 0
        at, stop, size = at[short], stop[short], size[short]
        new[at + 1] = False
        rest = at + size
        new[rest[rest < stop]] = True
    return np.flatnonzero(new)


def split(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts in order, and for each text the number of words before it (one entry more than texts).

    Nulls and empty texts have no words.  The words share the texts' memory.
    """
    if texts.offset or texts.null_count:
        texts = pa.concat_arrays([texts.fill_null("")])
        if texts.offset:
            texts = pa.array(texts.to_pylist(), pa.string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1) if len(texts) else np.zeros(1, np.int32)
    total = int(offsets[-1])
    if total == int(offsets[0]):
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, dtype=np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8, count=total)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # byte at which each code point begins
    cp = np.frombuffer(bytes(memoryview(data)[:total]).decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    where = np.searchsorted(lead, offsets)
    begins = np.unique(where[:-1][offsets[1:] > offsets[:-1]])
    word = borders(cp, begins)
    bounds = np.append(lead[word], total).astype(np.int32)
    words = pa.StringArray.from_buffers(len(word), pa.py_buffer(bounds), data)
    return words, np.searchsorted(word, where)
