"""Counts over whole texts, computed for a block of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleanery.llm.common import rolling, split_words, text_bytes

CLASSES = ["lower", "upper", "digit", "space", "sentence", "symbol", "other", "beyond_ascii"]
WINDOW = 8


def _byte_classes() -> np.ndarray:
    """Class of each byte; bytes that continue a character have class -1."""
    classes = np.full(256, CLASSES.index("other"), np.int8)
    classes[np.arange(ord("a"), ord("z") + 1)] = CLASSES.index("lower")
    classes[np.arange(ord("A"), ord("Z") + 1)] = CLASSES.index("upper")
    classes[np.arange(ord("0"), ord("9") + 1)] = CLASSES.index("digit")
    classes[[0x20, *range(0x09, 0x0E)]] = CLASSES.index("space")
    classes[list(b".,;:'\"!?-()")] = CLASSES.index("sentence")
    classes[list(b"#*$%&|<>")] = CLASSES.index("symbol")
    classes[0xC0:] = CLASSES.index("beyond_ascii")
    classes[0x80:0xC0] = -1
    return classes


_CLASS_OF = _byte_classes()


def class_counts(texts: pa.Array) -> np.ndarray:
    """Characters of each class per text: one row per text."""
    data, borders = text_bytes(texts)
    count = len(texts)
    owner = np.repeat(np.arange(count, dtype=np.int64) * 16, np.diff(borders))
    cells = np.bincount(owner + _CLASS_OF[data] + 1, minlength=count * 16)[: count * 16]
    return cells.reshape(count, 16)[:, 1:len(CLASSES) + 1]


def repeated_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: its lines that hold a word, and those of them equal to an earlier line."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = lists.flatten()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    filled = pc.match_substring_regex(lines, r"[^\x09-\x0D\x20]").to_numpy(zero_copy_only=False)
    owner = owner[filled]
    codes = lines.filter(pa.array(filled)).dictionary_encode().indices.to_numpy()
    total = np.bincount(owner, minlength=len(texts))
    distinct = np.unique((owner.astype(np.int64) << 32) | codes)
    return total, total - np.bincount(distinct >> 32, minlength=len(texts))


def repeated_word_mask(codes: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks words inside a window of ``window`` words that its text has twice or more.

    Hashes only pick the windows worth comparing; those are compared word by word.
    """
    covered = np.zeros(len(codes), bool)
    hashes = rolling(codes, window)
    if not len(hashes):
        return covered
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[: len(hashes)] == owner[window - 1:]
    start = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        keys = hashes[start] + owner[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return covered
    marks = np.zeros(1 << 20, bool)
    marks[(twice >> np.uint64(44)).astype(np.int64)] = True
    near = marks[(keys >> np.uint64(44)).astype(np.int64)]
    start, keys = start[near], keys[near]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    start = start[twice[at] == keys]
    rows = np.column_stack([owner[start], *(codes[start + i] for i in range(window))])
    order = np.lexsort(rows.T[::-1])
    rows, start = rows[order], start[order]
    same = (rows[1:] == rows[:-1]).all(axis=1)
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, start[again], 1)
    np.add.at(edges, start[again] + window, -1)
    return np.cumsum(edges[:-1]) > 0


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of word values for each text."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def quality_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words per text, with their parts."""
    words, counts = split_words(texts)
    codes, dictionary = word_codes(words)
    classes = class_counts(texts)
    lines, dup = repeated_lines(texts)
    mask = repeated_word_mask(codes, counts)
    return {
        "n_words": counts,
        "word_chars": classes.sum(axis=1) - classes[:, CLASSES.index("space")],
        "n_symbols": classes[:, CLASSES.index("symbol")],
        "n_dup_lines": dup,
        "n_repeat_words": per_text(mask.astype(np.int64), counts),
        "n_lines": lines,
        "classes": classes,
        "codes": codes,
        "dictionary": dictionary,
    }
