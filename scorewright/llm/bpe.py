"""Merge tables and the rank-synchronous merging of many sequences at once.

A tokenizer file is read from a path given by the caller; nothing of it is
kept in this package.  Sequences are held as one flat symbol array plus
segment ids (a ragged array), so one numpy operation works on every sequence.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import regex

NO_RANK = np.int64(2**62)
_MULT = np.uint64(0x9E3779B97F4A7C15)

#: Splitting patterns of the byte-level and the word-level files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it is printable in
    Latin-1, else the next free letter from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class MergeTable:
    """The merge list of one tokenizer file as an open-addressing hash table.

    ``lookup(left, right)`` gives the rank of each pair (``NO_RANK`` if it has
    none) and ``merged[rank]`` the symbol a merge makes.  The merge list must
    be proper (each part is a base symbol or made by an earlier merge), which
    makes "lowest rank first" equal to one pass per rank; it is checked here.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.size = max(self.tokens) + 1
        letters = byte_letters()
        self.letter_byte = {c: b for b, c in enumerate(letters)}
        self.base = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(self.size, len(pairs), np.int64)
        born[self.base] = born[self.last] = -1
        born[self.merged] = np.arange(len(pairs))
        if (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any() or len(set(self.merged.tolist())) < len(pairs):
            raise ValueError("merge list is not proper: a part is made by a later merge")
        bits = max(4, int(len(pairs) * 4).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, NO_RANK, np.int64)
        keys = left * self.size + right
        todo, slot = np.arange(len(pairs)), self._slot(keys)
        while len(todo):
            free = self._keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self._keys[slot[put]], self._ranks[slot[put]] = keys[todo[put]], todo[put]
            left_over = np.ones(len(todo), bool)
            left_over[put] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & self._mask

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * _MULT) >> self._shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._ranks[slot], NO_RANK)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self._mask
            found = self._keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self._ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Base symbols of the words, flat, and each word's length."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        out = self.base[raw]
        if self.suffix:
            ends = np.cumsum(lens)[lens > 0] - 1
            out[ends] = self.last[raw[ends]]
        return out, lens


def merge_ragged(table: MergeTable, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank-synchronous merging of all sequences.

    Each round finds every sequence's lowest-rank pair and merges all its
    occurrences (left to right where they overlap) in every sequence at once;
    a sequence without a pair leaves the working arrays.  Returns the
    surviving symbols, flat in sequence order, and how many each sequence has.
    Empty sequences have none."""
    seg = np.repeat(np.arange(len(lens)), lens)
    sym = sym.astype(np.int64)
    done_sym, done_seg = [], []
    rank = np.full(len(sym), NO_RANK, np.int64)
    if len(sym) > 1:
        same = np.flatnonzero(seg[1:] == seg[:-1])
        rank[same] = table.lookup(sym[same], sym[same + 1])
    while len(sym):
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        low = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(seg)])
        live = low < NO_RANK
        if not live.all():
            keep = np.repeat(live, sizes)
            done_sym.append(sym[~keep])
            done_seg.append(seg[~keep])
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            low, sizes = low[live], sizes[live]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(low, sizes))
        if len(at) > 1 and (at[1:] == at[:-1] + 1).any():  # a run such as "aaaa": every other one
            run = np.cumsum(np.r_[True, at[1:] != at[:-1] + 1]) - 1
            first = at[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])][run]
            at = at[(at - first) % 2 == 0]
        sym[at] = table.merged[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, seg, rank = sym[keep], seg[keep], rank[keep]
        new = at - np.arange(len(at))
        near = np.zeros(len(sym), bool)
        near[new] = near[new[new > 0] - 1] = True
        again = np.flatnonzero(near)
        rank[again] = NO_RANK
        again = again[again + 1 < len(sym)]
        again = again[seg[again] == seg[again + 1]]
        rank[again] = table.lookup(sym[again], sym[again + 1])
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(len(lens), np.int64)
    sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
    order = np.argsort(seg, kind="stable")
    return sym[order], np.bincount(seg, minlength=len(lens))


@functools.lru_cache(maxsize=4)
def load_table(path: str) -> MergeTable:
    return MergeTable(path)


@functools.lru_cache(maxsize=4)
def splitter(pattern: str):
    return regex.compile(pattern)


@functools.lru_cache(maxsize=1)
def latin_splitter():
    """``WORD_PATTERN`` for texts of Latin-1 alone, whose classes are spelled out
    and need no Unicode tables."""
    import re

    every = "".join(map(chr, range(256)))
    letters, digits, spaces = ("".join(map(re.escape, regex.findall(c, every))) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(WORD_PATTERN.replace(r"\p{L}", letters).replace(r"\p{N}", digits).replace(r"\s", spaces))


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def parts(text: str, special: dict[str, int]):
    """(piece, id of a special string or None) in text order."""
    if not any(s in text for s in special):
        return [(text, None)]
    cut = regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text)
    return [(p, special.get(p) if i % 2 else None) for i, p in enumerate(cut) if p]


def sufficient_lookahead(table: MergeTable) -> int:
    """Bytes after which a token boundary can no longer change.

    Take two texts with a common prefix u and the position d up to which both
    have the same boundaries; at first d = |u|.  A merge (x, y) moves d only
    when it crosses d in one of them, and then to d - |x|.  The next merge that
    crosses has a higher rank, and its right part begins at d - |x|, where one
    text has x and the other x + y, each perhaps grown to the right: so the
    right part starts with x.  The longest such chain, weighted by |x|, bounds
    how far d can move; a boundary further left than that is final.  One pass
    over the ranks from the last to the first, with the best chain kept for
    each prefix of a right part."""
    cut = len(table.suffix)
    text = table.tokens
    best: dict[str, int] = {}
    longest = 0
    for a, b in zip(table.left[::-1].tolist(), table.right[::-1].tolist(), strict=True):
        x, y = text[a], text[b]
        reach = len(x) + best.get(x, 0)
        longest = max(longest, reach)
        if cut and y.endswith(table.suffix):
            y = y[:-cut]
        for k in range(1, len(y) + 1):
            p = y[:k]
            if best.get(p, 0) < reach:
                best[p] = reach
    return longest


@functools.lru_cache(maxsize=4)
def load_lookahead(path: str) -> int:
    return sufficient_lookahead(load_table(path))


@functools.lru_cache(maxsize=1)
def newer_letters():
    """Pattern of the letters and digits that the splitting library may know
    but ``unicodedata`` does not: their class depends on the Unicode version,
    so texts with one of them are split by the tokenizer's own library."""
    import re
    import unicodedata

    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    new = [ord(c) for run in regex.findall(r"[\p{L}\p{N}]+", every) for c in run if unicodedata.category(c) == "Cn"]
    spans, start = [], None
    for i, c in enumerate(new):
        start = c if start is None else start
        if i + 1 == len(new) or new[i + 1] != c + 1:
            spans.append(f"{chr(start)}-{chr(c)}")
            start = None
    return re.compile(f"[{''.join(spans)}]" if spans else r"(?!)")


@functools.lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PreTokenizer:
    """Splits a text as the tokenizer file asks: special strings first, then
    (word files) NFC and lower case, then the pattern."""

    def __init__(self, path: str, table: MergeTable):
        self.path, self.table = path, table
        self.words = bool(table.suffix)
        self.find = splitter(WORD_PATTERN if self.words else BYTE_PATTERN).findall
        self.newer = newer_letters()

    def _has_newer(self, text: str) -> bool:
        # far faster than a search, and enough for most texts
        return not is_latin(text) and self.newer.search(text) is not None

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and self._has_newer(text):
            lib = library(self.path)
            if lib.normalizer is not None:
                text = lib.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)]
        if self.words:
            import unicodedata

            if not text.isascii():  # lower case letter by letter: no final sigma
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
            if is_latin(text):
                return latin_splitter().findall(text)
        return self.find(text)

    def __call__(self, text: str) -> list[str | int]:
        """Pre-tokens in order; a special string is its id."""
        special = self.table.special
        if not any(s in text for s in special):
            return self._plain(text)
        out: list[str | int] = []
        for piece, sid in parts(text, special):
            if sid is None:
                out.extend(self._plain(piece))
            else:
                out.append(sid)
        return out
