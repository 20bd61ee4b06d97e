"""Content of a text without its formatting, over whole Arrow columns.

Code points pass through one lookup table that either skips them (white space,
invisible characters, punctuation) or folds their case.  Signs and dots inside
numbers are content.  In a list of named fields each field is a piece of its
own, and pieces combine without order; any other text is one piece.  Hashes
are polynomials over the kept code points where they stand, and two texts are
compared by two pointers that pass over what is skipped; no canonical string
is ever made.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Classes of code points.
SKIP, INVISIBLE, SPACE, SEPARATOR, MARK = 0, 1, 2, 3, 4
SEPARATORS = ";,|/\n\r{}[]"
MARKS = ":="
SIGNS = "-+\u2212"
INVISIBLES = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁪⁫⁬⁭⁮⁯﻿︎️"

_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(fold: folded code point, 0 to skip; kind: class of what is skipped)."""
    fold = np.zeros(0x10000, np.uint32)
    kind = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if ch in INVISIBLES:
            kind[cp] = INVISIBLE
        elif ch in SEPARATORS:
            kind[cp] = SEPARATOR
        elif ch in MARKS:
            kind[cp] = MARK
        elif ch.isspace() or cat in ("Zs", "Zl", "Zp", "Cc"):
            kind[cp] = SPACE
        elif cat[0] in "LNM" or cat == "So":
            low = unicodedata.normalize("NFKC", ch).lower() if cat[0] in "LN" else ch
            fold[cp] = ord(low) if len(low) == 1 else cp
    return fold, kind


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all values and the offsets of each value among them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cps) != len(raw):
        offsets = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
    return cps, offsets


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a column, folded or 0 where they are skipped, the offset at
    which each piece begins among them, and each piece's row (ascending)."""
    column = column.cast(pa.string())
    if pc.any(pc.match_substring_regex(column, "[ßẞ]")).as_py():
        column = pc.replace_substring_regex(column, "[ßẞ]", "ss")
    fold, kind = tables()
    cps, offsets = code_points(column)
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    low = np.minimum(cps, 0xFFFF)
    seen = kind[low] != INVISIBLE
    if not seen.all():
        cps, rows, low = cps[seen], rows[seen], low[seen]
    n = len(cps)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    codes = np.where(cps > 0xFFFF, cps, fold[low])
    what = kind[low]
    content = codes != 0
    digit = (cps >= 48) & (cps <= 57)
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(rows[1:], rows[:-1], out=begins[1:])
    digit_next = np.zeros(n, bool)
    digit_next[:-1] = digit[1:] & ~begins[1:]
    word_before = np.zeros(n, bool)
    word_before[1:] = content[:-1] & ~begins[1:]
    digit_before = np.zeros(n, bool)
    digit_before[1:] = digit[:-1] & ~begins[1:]
    sign = np.isin(cps, [ord(c) for c in SIGNS]) & digit_next & ~word_before
    dot_before = np.zeros(n, bool)
    dot_before[1:] = (cps[:-1] == 46) & ~begins[1:]
    dot = (cps == 46) & digit_next & (digit_before | ~(word_before | dot_before))
    codes = np.where(sign, np.where(cps == 43, 43, 45), np.where(dot, 46, codes)).astype(np.uint32)

    # Named fields: a mark whose name starts with a letter after a separator.
    at = np.arange(n)
    parts = (what == SEPARATOR) | begins
    last_part = np.maximum.accumulate(np.where(parts, at, 0))
    mark = what == MARK
    first_word = np.where(content, at, n)
    nxt = np.minimum.accumulate(first_word[::-1])[::-1]  # next content at or after
    name_at = nxt[last_part]
    letter = content & ~digit
    named = mark & (name_at < at) & letter[np.minimum(name_at, n - 1)]
    last_mark = np.empty(n, np.int64)
    last_mark[0] = -1
    last_mark[1:] = np.maximum.accumulate(np.where(mark, at, -1))[:-1]
    named &= last_mark < last_part + (begins[last_part] & ~mark[last_part]) * 1
    listed = np.bincount(rows[named], minlength=len(offsets) - 1) >= 2
    named &= listed[rows]
    codes = np.where(named, np.uint32(61), codes)
    cut = begins.copy()
    cut[last_part[named]] = True
    starts = np.flatnonzero(cut)
    return codes, starts, rows[starts]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=8)
def _powers(base: int, length: int) -> np.ndarray:
    out = np.full(length, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def piece_hashes(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each piece over its kept code points, 0 if none."""
    kept = codes != 0
    rank = np.cumsum(kept)
    lengths = np.add.reduceat(kept.astype(np.int64), starts)
    sizes = np.diff(np.append(starts, len(codes)))
    position = np.maximum(rank - 1 - np.repeat(np.cumsum(lengths) - lengths, sizes), 0)
    longest = 1 << max(1, int(lengths.max()).bit_length())
    out = []
    with np.errstate(over="ignore"):
        for base in _LANES:
            terms = _mix(codes.astype(np.uint64) + np.uint64(base)) * _powers(base | 1, longest)[position]
            h = _mix(np.add.reduceat(np.where(kept, terms, np.uint64(0)), starts) + lengths.astype(np.uint64))
            out.append(np.where(lengths > 0, h, np.uint64(0)))
    return out


def column_hashes(column: pa.Array) -> list[np.ndarray]:
    """Two 64-bit hashes of the content of each value (0 for no content)."""
    codes, starts, rows = folded(column)
    n = len(column)
    if not len(codes):
        return [np.zeros(n, np.uint64) for _ in _LANES]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    out = []
    with np.errstate(over="ignore"):
        for h in piece_hashes(codes, starts):
            whole = np.zeros(n, np.uint64)
            whole[rows[first]] = np.add.reduceat(h, first)
            out.append(whole)
    return out


def combined_hashes(columns: list[pa.Array]) -> list[np.ndarray]:
    """Two hashes of several columns together, as int64."""
    out = []
    parts = [column_hashes(c) for c in columns]
    with np.errstate(over="ignore"):
        for lane in range(len(_LANES)):
            h = np.zeros(len(columns[0]), np.uint64)
            for i, p in enumerate(parts):
                h = h + _mix(p[lane] + np.uint64((i + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
            out.append(h.view(np.int64))
    return out


#: Code points of a piece up to which pieces are compared in step.
IN_STEP = 2_000


def _in_step(a: np.ndarray, b: np.ndarray, i: np.ndarray, i_end: np.ndarray, j: np.ndarray, j_end: np.ndarray) -> np.ndarray:
    """Whether pieces a[i:i_end] and b[j:j_end] hold the same kept code points:
    a pointer for each side of each pair, all moved together."""
    same = np.ones(len(i), bool)
    i, j, live = i.copy(), j.copy(), np.arange(len(i))
    while len(live):
        x, y = i[live], j[live]
        left, right = x < i_end[live], y < j_end[live]
        u = np.where(left, a[np.minimum(x, len(a) - 1)], 0)
        v = np.where(right, b[np.minimum(y, len(b) - 1)], 0)
        pass_a, pass_b = left & (u == 0), right & (v == 0)
        met = ~pass_a & ~pass_b
        differ = met & ((left != right) | (u != v))
        same[live[differ]] = False
        i[live] += pass_a | met
        j[live] += pass_b | met
        live = live[~differ & ~(met & ~left)]
    return same


def _by_blocks(a: np.ndarray, b: np.ndarray, size: int = 1 << 16) -> bool:
    """The same for two long pieces: the pointers move from block to block."""
    i = j = 0
    while True:
        x, y = np.flatnonzero(a[i : i + size]), np.flatnonzero(b[j : j + size])
        if not len(x) and i < len(a):
            i += size
        elif not len(y) and j < len(b):
            j += size
        elif i >= len(a) or j >= len(b):
            return not len(x) and not len(y)
        else:
            n = min(len(x), len(y))
            if (a[i + x[:n]] != b[j + y[:n]]).any():
                return False
            i, j = i + int(x[n - 1]) + 1, j + int(y[n - 1]) + 1


def same_content(a: list[pa.Array], b: list[pa.Array]) -> np.ndarray:
    """For each row, whether all columns agree; the pieces of a list meet in the
    order of their hashes and are compared code point by code point."""
    n = len(a[0])
    same = np.ones(n, bool)
    for x, y in zip(a, b):
        equal = pc.equal(pc.fill_null(x.cast(pa.string()), ""), pc.fill_null(y.cast(pa.string()), "")).to_numpy(zero_copy_only=False)
        todo = np.flatnonzero(~equal & same)
        if not len(todo):
            continue
        take = pa.array(todo)
        sides = []
        for col in (x.take(take), y.take(take)):
            codes, starts, rows = folded(col)
            if len(codes):
                h = piece_hashes(codes, starts)[0]
                ends = np.append(starts[1:], len(codes))
                order = np.lexsort((h, rows))
                order = order[h[order] != 0]
                rows, starts, ends = rows[order], starts[order], ends[order]
            else:
                ends = starts
            sides.append((codes, rows, starts, ends))
        (ca, ra, sa, ea), (cb, rb, sb, eb) = sides
        na, nb = np.bincount(ra, minlength=len(todo)), np.bincount(rb, minlength=len(todo))
        good = na == nb
        ka, kb = good[ra], good[rb]
        rows, sa, ea, sb, eb = ra[ka], sa[ka], ea[ka], sb[kb], eb[kb]
        agree = np.ones(len(rows), bool)
        long = np.maximum(ea - sa, eb - sb) > IN_STEP
        short = np.flatnonzero(~long)
        if len(short):
            agree[short] = _in_step(ca, cb, sa[short], ea[short], sb[short], eb[short])
        for k in np.flatnonzero(long):
            agree[k] = _by_blocks(ca[sa[k] : ea[k]], cb[sb[k] : eb[k]])
        good[rows[~agree]] = False
        same[todo[~good]] = False
    return same
