"""NumPy and integer kernels for what SQL expressions can't give: edit scripts, search, seed matches and chains.

Sequences are bytes. In the grid, i counts characters of a and j of b; a deletion consumes a, an insertion b. A script is
a list of (op, count): '=' and 'X' consume both, 'D' a, 'I' b. Other cost models are in wavefront.py.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np

Script = list[tuple[str, int]]


def pushed(script: list, op, count: int = 1) -> None:
    """Adds to a run-length list, merging equal neighbours."""
    if count:
        if script and script[-1][0] == op:
            script[-1] = (op, script[-1][1] + count)
        else:
            script.append((op, count))


# --- unit costs ------------------------------------------------------------------------------------------------------


def _letter_masks(b: bytes) -> dict[int, int]:
    found: dict[int, int] = {}
    for j, c in enumerate(b):
        found[c] = found.get(c, 0) | 1 << j
    return found


def _columns(a: bytes, masks: dict[int, int], n: int, up: int, down: int):
    """For each letter of a: bit masks over j of where the cost rises or falls from j-1 to j, and from i-1 to i; up and down
    are those of the column before.

    Bit-parallel, with integers of n bits, the other side's length: a column takes a fixed number of integer operations.
    """
    full = (1 << n) - 1
    for c in a:
        eq = masks.get(c, 0)
        same = eq | down
        zero = (((same & up) + up) ^ up) | same
        right = down | (full & ~(zero | up))
        left = up & zero
        shifted = (right << 1 | 1) & full
        falls = left << 1 & full
        up, down = falls | (full & ~(zero | shifted)), shifted & zero
        yield up, down, right, left


def distance(a: bytes, b: bytes) -> int:
    cost, top = len(b), 1 << len(b) >> 1
    if not b:
        return len(a)
    for _, _, right, left in _columns(a, _letter_masks(b), len(b), (1 << len(b)) - 1, 0):
        cost += bool(right & top) - bool(left & top)
    return cost


#: Words of the masks of all pairs that are scored together, and pairs at most.
SCORED, LANES = 1 << 20, 2048


def distances(a: list[bytes], b: list[bytes], bound: int | None = None) -> np.ndarray:
    """Distances of many pairs, 64 places of each pair's column to a number. With a bound only numbers are computed that
    hold diagonals within it: distances up to it are exact, others come out larger than it.
    """
    out = np.empty(len(a), np.int64)
    order = sorted(range(len(a)), key=lambda x: (-(-len(b[x]) // 64), len(a[x])))
    e = 0
    while e < len(order):
        s, e = e, e + 1
        words = -(-len(b[order[s]]) // 64)
        while e < len(order) and -(-len(b[order[e]]) // 64) == words and e - s < LANES and (e - s + 1) * (4 * words + len(a[order[e]])) < SCORED:
            e += 1
        rows = order[s:e]
        out[rows] = _scored([a[x] for x in rows], [b[x] for x in rows], max(1, words), bound)
    return out


def _scored(a: list[bytes], b: list[bytes], words: int, bound: int | None) -> np.ndarray:
    """distances() of pairs of so many words. Cells beyond the band are taken to be one more than their neighbours, which
    they are at most. score: each pair's cost at the end of the band's last word."""
    k, n = len(a), max(map(len, a))
    size_a, size_b = (np.array([len(x) for x in y]) for y in (a, b))
    if bound is not None and bound >= max(n, int(size_b.max())):
        bound = None
    text_a, text_b = np.zeros((k, n + 1), np.uint8), np.zeros((k, 64 * words), np.uint8)
    for r in range(k):
        text_a[r, : len(a[r])] = np.frombuffer(a[r], np.uint8)
        text_b[r, : len(b[r])] = np.frombuffer(b[r], np.uint8)
    there = np.arange(64 * words) < size_b[:, None]
    letters = np.flatnonzero(np.bincount(text_b[there], minlength=256))
    masks = np.zeros((words, len(letters) + 1, k), "<u8")  # the last: letters that b lacks
    for x, c in enumerate(letters):
        masks[:, x] = np.packbits((text_b == c) & there, axis=1, bitorder="little").view("<u8").T
    masks = masks.reshape(words, -1)
    code = np.full(256, len(letters))
    code[letters] = np.arange(len(letters))
    at = np.ascontiguousarray((code[text_a] * k + np.arange(k)[:, None]).T)
    one, top = np.uint64(1), np.uint64(63)
    up, down = np.full((words, k), ~np.uint64(0)), np.zeros((words, k), np.uint64)
    last = words - 1 if bound is None else min(words - 1, bound // 64)
    score, out = np.full(k, 64 * (last + 1)), np.zeros(k, np.int64)

    def finished(i: int) -> None:
        own = np.flatnonzero(size_a == i)
        if len(own):
            place = size_b[own]
            w = np.arange(last + 1)[:, None]
            over = ~np.uint64(0) << np.clip(place - 64 * w, 0, 63).astype(np.uint64)
            over[place >= 64 * (w + 1)] = 0
            rest = np.bitwise_count(up[: last + 1, own] & over).astype(np.int64) - np.bitwise_count(down[: last + 1, own] & over)
            # What lies below the band's last word is one more each.
            out[own] = score[own] - rest.sum(axis=0) + np.maximum(0, place - 64 * (last + 1))
            if bound is not None:  # an end outside the band was not computed
                out[own[abs(i - place) > bound]] = bound + 1

    finished(0)
    for i in range(n):
        first = 0
        if bound is not None:
            if last < min(words - 1, (i + 1 + bound) // 64):
                last += 1
                score += 64
            first = min(last, max(0, i - bound) // 64)
        plus, minus = np.ones(k, np.uint64), np.zeros(k, np.uint64)  # what the row below a word's first rises or falls by
        for w in range(first, last + 1):
            p, m, eq = up[w], down[w], masks[w].take(at[i], mode="clip")
            vertical = eq | m
            eq |= minus
            zero = (((eq & p) + p) ^ p) | eq
            right, left = m | ~(zero | p), p & zero
            plus, right = right >> top, right << one | plus
            minus, left = left >> top, left << one | minus
            up[w] = left | ~(vertical | right)
            down[w] = right & vertical
        score += plus.astype(np.int64) - minus.astype(np.int64)
        finished(i + 1)
    return out


def doubled(a: list[bytes], b: list[bytes], low: np.ndarray, bound: int, tries: range = range(7)) -> np.ndarray:
    """distances() by bounds that double from `bound` on until one holds, so that near pairs are told from few diagonals.
    low: lower bounds; bounds below them are passed over. The sixth is the last; then there is none. tries: which of these
    are tried; -1 where none of them holds."""
    out, left = np.full(len(a), -1), np.arange(len(a))
    for t in tries:
        most = bound << t if t < 6 else None
        own = left if most is None else left[low[left] <= most]
        found = distances([a[x] for x in own], [b[x] for x in own], most)
        holds = np.ones(len(own), bool) if most is None else found <= most
        out[own[holds]] = found[holds]
        left = np.setdiff1d(left, own[holds])
    return out


#: Letters of b up to which pairs are traced many at a time, and bytes of their masks.
TOGETHER, MASK_BYTES = 1024, 1 << 25
#: Ops as numbers.
OPS = "=IDX"


@dataclass
class Scripts:
    """Edit scripts of many pairs: the cost of each, and its runs (ops as places in OPS, and counts) up to its end."""

    cost: np.ndarray
    op: np.ndarray
    count: np.ndarray
    end: np.ndarray

    def script(self, k: int) -> Script:
        s, e = self.end[k - 1] if k else 0, self.end[k]
        return [(OPS[o], c) for o, c in zip(self.op[s:e].tolist(), self.count[s:e].tolist(), strict=True)]


def aligns(a: list[bytes], b: list[bytes]) -> Scripts:
    """Distances and scripts. Of equally good scripts: walking back, a match comes first, then I, D, X; so for pairs of any
    length. Pairs of up to TOGETHER letters of b are traced many at a time; of longer ones every so many columns are kept,
    and those between are filled again on the way back, so memory grows with a length's root times the other length.
    """
    order = sorted(range(len(a)), key=lambda x: (-(-len(b[x]) // 64), len(a[x])))
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    e = 0
    while e < len(order):
        s, e = e, e + 1
        words = -(-len(b[order[s]]) // 64)
        if len(b[order[s]]) > TOGETHER:
            op, count = _traced_long(a[order[s]], b[order[s]])
            parts.append((np.zeros(len(op), np.int64) + order[s], op, count))
            continue
        while e < len(order) and -(-len(b[order[e]]) // 64) == words and (e - s + 1) * 16 * max(1, words) * (len(a[order[e]]) + 1) < MASK_BYTES:
            e += 1
        rows = np.array(order[s:e])
        row, op, count = _traced([a[x] for x in rows], [b[x] for x in rows], max(1, words))
        parts.append((rows[row], op, count))
    row, op, count = (np.concatenate([p[c] for p in parts]) for c in range(3)) if parts else (np.zeros(0, np.int64),) * 3
    by_row = np.argsort(row, kind="stable")
    row, op, count = row[by_row], op[by_row], count[by_row]
    return Scripts(np.bincount(row, weights=np.where(op > 0, count, 0), minlength=len(a)).astype(np.int64), op, count, np.cumsum(np.bincount(row, minlength=len(a))))


def _traced(a: list[bytes], b: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all pairs' scripts: pair, op, count. Every number holds 64 places of one pair's column; all pairs' columns
    are filled, and their paths walked back, a step at a time."""
    k, n = len(a), max(map(len, a))
    size_a, size_b = (np.array([len(x) for x in y]) for y in (a, b))
    text_a, text_b = np.zeros((k, n + 1), np.uint8), np.zeros((k, 64 * words), np.uint8)
    for r in range(k):
        text_a[r, : len(a[r])] = np.frombuffer(a[r], np.uint8)
        text_b[r, : len(b[r])] = np.frombuffer(b[r], np.uint8)
    there = np.arange(64 * words) < size_b[:, None]
    letters = np.unique(text_b[there])
    masks = np.zeros((len(letters) + 1, k, words), "<u8")  # the last: letters that b lacks
    for x, c in enumerate(letters):
        masks[x] = np.packbits((text_b == c) & there, axis=1, bitorder="little").view("<u8")
    code = np.full(256, len(letters))
    code[letters] = np.arange(len(letters))
    code, every, one, top = code[text_a], np.arange(k), np.uint64(1), np.uint64(63)
    rises, grows = np.empty((n + 1, k, words), np.uint64), np.empty((n + 1, k, words), np.uint64)
    up, down = np.full((k, words), ~np.uint64(0)), np.zeros((k, words), np.uint64)
    rises[0] = up
    for i in range(n):
        found = masks[code[:, i], every]
        plus, minus = np.ones(k, np.uint64), np.zeros(k, np.uint64)  # what the row below a word's first rises or falls by
        for w in range(words):
            p, m, eq = up[:, w], down[:, w], found[:, w]
            vertical = eq | m
            eq = eq | minus
            zero = (((eq & p) + p) ^ p) | eq
            right, left = m | ~(zero | p), p & zero
            grows[i + 1, :, w] = right
            plus, right = right >> top, right << one | plus
            minus, left = left >> top, left << one | minus
            up[:, w] = left | ~(vertical | right)
            down[:, w] = right & vertical
        rises[i + 1] = up
    i, j, live, steps = size_a.copy(), size_b.copy(), every, []
    while len(live := live[(i[live] > 0) | (j[live] > 0)]):
        x, y = i[live], j[live]
        before = np.maximum(y - 1, 0)
        place, bit = before >> 6, (before & 63).astype(np.uint64)
        match = (x > 0) & (y > 0) & (text_a[live, x - 1] == text_b[live, before])
        inserts = (y > 0) & ((rises[x, live, place] >> bit & one) > 0)
        deletes = (x > 0) & ((y == 0) | ((grows[x, live, place] >> bit & one) > 0))
        op = np.where(match, 0, np.where(inserts, 1, np.where(deletes, 2, 3))).astype(np.uint8)
        steps.append((live, op))
        i[live] -= op != 1
        j[live] -= op != 2
    row = np.concatenate([r for r, _ in reversed(steps)]) if steps else np.zeros(0, np.int64)
    op = np.concatenate([o for _, o in reversed(steps)]) if steps else np.zeros(0, np.uint8)
    return _runs(row, op)


def _runs(row: np.ndarray, op: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal neighbours of each row as one, with their number."""
    by_row = np.argsort(row, kind="stable")
    row, op = row[by_row], op[by_row]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (op[1:] != op[:-1])][: len(row)])
    return row[new], op[new], np.diff(np.r_[new, len(row)])


def _traced_long(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one pair's script: ops and counts."""
    masks, full, step = _letter_masks(b), (1 << len(b)) - 1, max(1, isqrt(len(a)))
    kept = [(full, 0)]
    for s in range(0, len(a), step):
        up, down = kept[-1]
        for up, down, _, _ in _columns(a[s : s + step], masks, len(b), up, down):
            pass
        kept.append((up, down))
    i, j, ops = len(a), len(b), bytearray()
    for s in reversed(range(0, max(1, len(a)), step)):
        block = [(kept[s // step][0], 0, 0, 0), *_columns(a[s : s + step], masks, len(b), *kept[s // step])]
        while i > s or (not s and (i or j)):
            if i and j and a[i - 1] == b[j - 1]:
                ops.append(0)
                i, j = i - 1, j - 1
            elif j and block[i - s][0] >> (j - 1) & 1:
                ops.append(1)
                j -= 1
            elif i and (not j or block[i - s][2] >> (j - 1) & 1):
                ops.append(2)
                i -= 1
            else:
                ops.append(3)
                i, j = i - 1, j - 1
    return _runs(np.zeros(len(ops), np.int64), np.frombuffer(bytes(reversed(ops)), np.uint8))[1:]


def positions(found: Scripts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every position of every script, in order: the pair, i, j, and the cost up to there."""
    pairs = np.arange(len(found.cost))
    run = np.repeat(pairs, np.diff(np.r_[0, found.end]))
    row, op = np.r_[pairs, np.repeat(run, found.count)], np.r_[np.full(len(pairs), -1), np.repeat(found.op, found.count)]
    order = np.argsort(row, kind="stable")  # each pair's start, then its steps
    row, op = row[order], op[order]
    first = np.searchsorted(row, row)
    out = (np.cumsum(step) for step in ((op >= 0) & (op != 1), (op >= 0) & (op != 2), op > 0))
    return row, *(x - x[first] for x in out)


def align(a: bytes, b: bytes) -> tuple[int, Script]:
    """aligns() of one pair."""
    found = aligns([a], [b])
    return int(found.cost[0]), found.script(0)


# --- semi-global search ----------------------------------------------------------------------------------------------

#: Pattern letters that match several text letters, in the order A, C, G, T.
WILDCARDS = {"N": "ACGT", "*": "ACGT", "Y": "CT", "R": "AG"}


def _letters(pattern: str) -> list[str]:
    known = {"A": "A", "C": "C", "G": "G", "T": "T"} | WILDCARDS
    found = [known.get(c.upper()) for c in pattern]
    if None in found:
        raise ValueError(f"pattern letter {pattern[found.index(None)]!r} is not one of ACGT, N, *, Y, R")
    return found


def unmatched(count: int, u: float) -> np.ndarray:
    """Costs of leaving 0..count pattern letters unmatched at an end."""
    if u <= 0:
        return np.zeros(count + 1, np.int64)
    steps = np.ceil(np.arange(count + 1, dtype=np.float32) / np.float32(u)).astype(np.int64)
    return np.array([int((steps < j).sum()) for j in range(count + 1)], np.int64)


def _search_rows(pattern: str, text: str, u: float, inside: bool = False) -> np.ndarray:
    """inside: the text goes on to the left, so that pattern letters unmatched there cost like any others."""
    if not 0 <= u <= 1:
        raise ValueError("the cost of unmatched letters must be from 0 to 1")
    if bad := set(text) - set("acgtACGT"):
        raise ValueError(f"text letter {min(bad)!r} is not one of ACGT")
    sets, n = _letters(pattern), len(pattern)
    unlike = {c: np.array([c not in s for s in sets], np.int64) for c in "ACGT"}
    rows = np.empty((len(text) + 1, n + 1), np.int64)
    rows[0] = np.arange(n + 1) if inside else unmatched(n, u)
    steps = np.arange(n + 1)
    for i, c in enumerate(text.upper()):
        t = np.empty(n + 1, np.int64)
        t[0] = 0
        t[1:] = np.minimum(rows[i, 1:] + 1, rows[i, :-1] + unlike[c])
        rows[i + 1] = np.minimum.accumulate(t - steps) + steps
    return rows


def searches(patterns: list[str], texts: list[str], u: float = 0.0, inside: list[bool] | None = None) -> list[np.ndarray]:
    """search_costs() of each pair."""
    sides = []
    for x in (patterns, texts):
        own = [t.encode() for t in x]
        sides += [np.frombuffer(b"".join(own), np.uint8), np.array([len(t) for t in own], np.int64)]
    found, size = search_costs(*sides, u, None if inside is None else np.array(inside, bool))
    return np.split(found, np.cumsum(size)[:-1]) if len(size) else []


#: Cells of one row of the grids of all pairs that are searched together, and costs that they give.
SEARCHED, SEARCHED_COSTS = 1 << 16, 1 << 21


def _code_table(letters: dict[str, str]) -> np.ndarray:
    """By byte of a letter, or of its small form, a bit for each of A, C, G, T that it stands for; others: none."""
    table = np.zeros(256, np.uint8)
    for c, known in letters.items():
        table[[ord(c), ord(c.lower())]] = sum(1 << "ACGT".index(x) for x in known)
    return table


_TEXT_BITS = _code_table({c: c for c in "ACGT"})
_PATTERN_BITS = _code_table({c: c for c in "ACGT"} | WILDCARDS)


def search_costs(patterns: np.ndarray, pattern_size: np.ndarray, texts: np.ndarray, text_size: np.ndarray, u: float = 0.0, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the cost of the best match of the pattern that ends at each place of the text, then of matches over
    its right end: of all but 1, 2, ... of the pattern's letters. Patterns and texts lie end to end, as bytes, and so do
    the costs; the second result is the number of each pair's. Pairs with patterns of one length are computed together,
    a letter of all their texts at a time, with the pairs side by side.

    inside: texts that are blocks of longer ones, which go on to the left. From 2 * len(pattern) letters on their costs are
    those of the longer text, as no best match spans more.
    """
    if not 0 <= u <= 1:
        raise ValueError("the cost of unmatched letters must be from 0 to 1")
    text, pattern = _TEXT_BITS[texts], _PATTERN_BITS[patterns]
    if not text.all():
        raise ValueError(f"text letter {_first_bad(texts, text)!r} is not one of ACGT")
    if not pattern.all():
        raise ValueError(f"pattern letter {_first_bad(patterns, pattern)!r} is not one of ACGT, N, *, Y, R")
    count = text_size + pattern_size + 1
    first, first_p, first_t = (np.cumsum(x) - x for x in (count, pattern_size, text_size))
    out = np.empty(int(count.sum()), np.int32)
    order = np.lexsort((text_size, pattern_size))
    e = 0
    while e < len(order):
        s, n = e, int(pattern_size[order[e]])
        most = min(int(np.searchsorted(pattern_size[order], n, "right")), s + max(1, SEARCHED // (n + 1)))
        fits = (np.arange(s, most) - s + 1) * count[order[s:most]] <= SEARCHED_COSTS
        e = s + max(1, int(fits.sum()))
        own = order[s:e]
        size = text_size[own]
        letters = text[np.minimum(first_t[own] + np.arange(int(size[-1]))[:, None], max(0, len(text) - 1))] if size[-1] else np.zeros((0, len(own)), np.uint8)
        sets = pattern[first_p[own] + np.arange(n)[:, None]] if n else np.zeros((0, len(own)), np.uint8)
        found = _searched(sets, letters, size, u, np.zeros(len(own), bool) if inside is None else inside[own]).T
        there = np.arange(found.shape[1]) < count[own, None]
        out[(first[own, None] + np.arange(found.shape[1]))[there]] = found[there]
    return out, count


def _first_bad(data: np.ndarray, known: np.ndarray) -> str:
    at = int(np.flatnonzero(known == 0)[0])
    return data[at : at + 4].tobytes().decode("utf-8", "replace")[0]


def _searched(sets: np.ndarray, letters: np.ndarray, size: np.ndarray, u: float, inside: np.ndarray) -> np.ndarray:
    """Costs of pairs in order of their texts' sizes, by place and pair. Letters are bits; sets those that a pattern's letter
    stands for."""
    n = len(sets)
    kind = np.int16 if n < 1 << 14 else np.int32
    rest, steps = unmatched(n, u).astype(kind)[:, None], np.arange(n + 1, dtype=kind)[:, None]
    row = np.where(inside, steps, rest)
    out = np.zeros((len(letters) + n + 1, len(size)), kind)
    cuts = np.searchsorted(size, np.arange(len(letters) + 1), "right").tolist()  # pairs whose text has ended
    done = 0
    for i, ended in enumerate(cuts):
        out[i, done:] = row[n]
        if ended > done:
            out[i + 1 : i + n + 1, done:ended] = (row[:, : ended - done] + rest[-1] - rest)[:n][::-1]
            row, sets, done = row[:, ended - done :], sets[:, ended - done :], ended
        if i < len(letters):
            t = np.zeros(row.shape, kind)
            np.minimum(row[1:] + 1, row[:-1] + ((sets & letters[i, done:]) == 0), out=t[1:])
            t -= steps
            for j in range(n):
                np.minimum(t[j + 1], t[j], out=t[j + 1])
            t += steps
            row = t
    return out


def search(pattern: str, text: str, u: float = 0.0) -> list[int]:
    """searches() of one pair."""
    return searches([pattern], [text], u)[0].tolist()


def index_position(index: int, pattern_length: int, text_length: int) -> tuple[int, int]:
    """Text and pattern letters before that place of search()'s result."""
    return (index, pattern_length) if index <= text_length else (text_length, pattern_length - (index - text_length))


def search_trace(pattern: str, text: str, index: int, u: float = 0.0) -> tuple[int, int, Script]:
    """Of the match at a place of search(): text and pattern letters before its first, and the script, in which D consumes
    text and I the pattern. Walking back, a match comes first, then D, I, X. Only as much of the text is looked at as a best
    match can span: twice the pattern's letters."""
    i, j = index_position(index, len(pattern), len(text))
    skipped = max(0, i - 2 * len(pattern))
    text, i = text[skipped:i], i - skipped
    rows, sets = _search_rows(pattern, text, u, skipped > 0), _letters(pattern)
    script: Script = []
    while j and i:
        if text[i - 1].upper() in sets[j - 1] and rows[i - 1, j - 1] == rows[i, j]:
            pushed(script, "=")
            i, j = i - 1, j - 1
        elif rows[i - 1, j] + 1 == rows[i, j]:
            pushed(script, "D")
            i -= 1
        elif rows[i, j - 1] + 1 == rows[i, j]:
            pushed(script, "I")
            j -= 1
        else:
            pushed(script, "X")
            i, j = i - 1, j - 1
    return skipped + i, j, script[::-1]


# --- chains of matches -----------------------------------------------------------------------------------------------


#: Layers of all pairs that are swept together.
LAYERS = 1 << 21
#: Matches of a pair that are compared with each other, and the cells of pairs and matches that are filled together.
FEW, CELLS = 128, 1 << 16


def chains(n_pairs: int, row: np.ndarray, start: tuple[np.ndarray, np.ndarray], end: tuple[np.ndarray, np.ndarray], score: np.ndarray, at_row: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each place (at, in pair at_row) the largest sum of scores of matches that follow each other from there on: each
    starts at or after the end of the one before, the first at or after the place, in both coordinates. Matches (of pair
    row) end after they start in the first coordinate, and have positive scores.

    Pairs with few matches compare each with all others, the other pairs are swept.
    """
    out = np.zeros(len(at_row), np.int64)
    few = np.bincount(row, minlength=n_pairs) <= FEW
    for which, of in ((few, _compared), (~few, _swept)):
        own, asked = np.flatnonzero(which[row]), np.flatnonzero(which[at_row])
        if len(own) and len(asked):
            out[asked] = of(n_pairs, row[own], *(tuple(c[own] for c in x) for x in (start, end)), score[own], at_row[asked], tuple(c[asked] for c in at))
    return out


def _compared(n_pairs: int, row: np.ndarray, start: tuple[np.ndarray, np.ndarray], end: tuple[np.ndarray, np.ndarray], score: np.ndarray, at_row: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """chains(), match by match from the last start on, for all pairs with about as many matches at once."""
    out = np.zeros(len(at_row), np.int64)
    fits = all(-(1 << 31) <= x.min(initial=0) and x.max(initial=0) < (1 << 31) - 1 for x in (*start, *end))
    kind = np.int32 if fits and int(score.max(initial=0)) * FEW < 1 << 31 else np.int64
    order = _order(row, start[0] - start[0].min(initial=0))
    *sides, score = (x[order].astype(kind) for x in (*start, *end, score))
    count = np.bincount(row, minlength=n_pairs)
    first = np.cumsum(count) - count
    by_count = np.argsort(count, kind="stable")
    count_up = count[by_count]
    at = tuple(np.clip(x, np.iinfo(kind).min, np.iinfo(kind).max).astype(kind) for x in at)
    asks = np.argsort(at_row, kind="stable")
    asked = np.searchsorted(at_row[asks], np.arange(n_pairs + 1))
    s = int(np.searchsorted(count_up, 1))
    while s < n_pairs:
        least = int(count_up[s])
        e = min(s + max(1, CELLS // (least + 3)), int(np.searchsorted(count_up, least + least // 4 + 2, "right")))
        lanes, m = by_count[s:e], int(count_up[e - 1])
        s, turn = e, np.arange(m)[:, None]
        cells = np.minimum(first[lanes] + turn, len(score) - 1)
        sx, sy, ex, ey = (x[cells] for x in sides)
        best = np.where(turn < count[lanes], score[cells], 0)  # cells without a match come last and have a score of 0
        for x in range(m - 2, -1, -1):
            best[x] += (best[x + 1 :] * ((sx[x + 1 :] >= ex[x]) & (sy[x + 1 :] >= ey[x]))).max(axis=0)
        n = asked[lanes + 1] - asked[lanes]
        lane = np.repeat(np.arange(len(lanes)), n)
        places = asks[np.repeat(asked[lanes] - np.cumsum(n) + n, n) + np.arange(len(lane))]
        for f in range(0, len(places), len(lanes)):
            some, z = places[f : f + len(lanes)], lane[f : f + len(lanes)]
            out[some] = (best[:, z] * ((sx[:, z] >= at[0][some]) & (sy[:, z] >= at[1][some]))).max(axis=0)
    return out


def _swept(n_pairs: int, row: np.ndarray, start: tuple[np.ndarray, np.ndarray], end: tuple[np.ndarray, np.ndarray], score: np.ndarray, at_row: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """chains(), all pairs at once, from the largest first coordinate on. What is held of a pair are layers: for each sum v,
    the largest second coordinate at which a chain of v or more starts. These fall as v grows, so the best chain at or
    after a place is the number of layers that reach it; a match's own sum is known from its end before its start comes.
    """
    out = np.zeros(len(at_row), np.int64)
    most = np.bincount(row, weights=score, minlength=n_pairs).astype(np.int64)
    by_most = np.argsort(most, kind="stable")
    e = 0
    while e < n_pairs:
        s, e = e, e + 1
        while e < n_pairs and (e - s + 1) * (most[by_most[e]] + 1) <= LAYERS:
            e += 1
        lane = np.full(n_pairs, -1)
        lane[by_most[s:e]] = np.arange(e - s)
        own, asked = np.flatnonzero(lane[row] >= 0), np.flatnonzero(lane[at_row] >= 0)
        # Events: 0 a match starts, 1 a match ends, 2 a place; by pair and falling first coordinate.
        lanes = lane[np.concatenate([row[own], row[own], at_row[asked]])]
        x, y = (np.concatenate([start[c][own], end[c][own], at[c][asked]]) for c in (0, 1))
        kind = np.repeat([0, 1, 2], [len(own), len(own), len(asked)])
        of = np.concatenate([own, own, asked])
        order = np.lexsort((kind, -x, lanes))
        lanes, y, kind, of = lanes[order], y[order], kind[order], of[order]
        turn = np.arange(len(lanes)) - np.searchsorted(lanes, lanes)
        order = np.argsort(turn, kind="stable")
        lanes, y, kind, of = lanes[order], y[order], kind[order], of[order]
        width = int(most[by_most[e - 1]])
        layers, best = np.full((e - s, width), np.iinfo(np.int64).min), np.zeros(len(row), np.int64)
        level = np.arange(width)
        cuts = np.flatnonzero(np.diff(turn[order], prepend=-1)).tolist() + [len(lanes)]
        for f, t in zip(cuts, cuts[1:], strict=False):
            k, l, m, z = kind[f:t], lanes[f:t], of[f:t], y[f:t]
            asks = k > 0
            found = (layers[l[asks]] >= z[asks, None]).sum(axis=1)
            ends, places = m[k == 1], m[k == 2]
            best[ends] = found[k[asks] == 1] + score[ends]
            out[places] = found[k[asks] == 2]
            begins = k == 0
            if begins.any():
                had = layers[l[begins]]
                layers[l[begins]] = np.where(level < best[m[begins], None], np.maximum(had, z[begins, None]), had)
    return out


# --- seeds and matches of many pairs ---------------------------------------------------------------------------------


def window_codes(data: np.ndarray, k: int) -> np.ndarray:
    """Two bits a letter (0 to 3) of each window of k letters, the first letter highest."""
    n = max(0, len(data) - k + 1)
    out = np.zeros(n, np.int64)
    for x in range(k):
        out = out << 2 | data[x : x + n]
    return out


def _neighbours(code: np.ndarray, k: int) -> list[tuple[int, np.ndarray]]:
    """(length, codes) of all words that one deletion, substitution or insertion makes of each word of k letters."""
    out = []
    for x in range(k):  # letters after place x
        low, high = code & ((1 << 2 * x) - 1), code >> 2 * (x + 1)
        out.append((k - 1, high << 2 * x | low))
        out += [(k, (high << 2 | c) << 2 * x | low) for c in range(4)]
    for x in range(k + 1):
        low, high = code & ((1 << 2 * x) - 1), code >> 2 * x
        out += [(k + 1, (high << 2 | c) << 2 * x | low) for c in range(4)]
    return out


def _edits(x: np.ndarray, k: int, y: np.ndarray, length: int) -> np.ndarray:
    """Edits between words of k letters and of k - 1, k or k + 1, up to 1; 2 stands for more."""
    if length == k:
        unlike = x ^ y
        return np.minimum(np.bitwise_count((unlike | unlike >> 1) & (0x5555555555555555 & ((1 << 2 * k) - 1))).astype(np.int64), 2)
    # One letter left out of the longer word gives the shorter one: all letters that are unlike when both ends are laid upon
    # each other lie before those that are unlike when both beginnings are (in front of all letters is a mark).
    (more, less, m) = (x, y, length) if k > length else (y, x, k)
    odd = 0x5555555555555555 & ((1 << 2 * m) - 1)
    ends, begins = more ^ less, (more >> 2) ^ less
    ends = (ends | ends >> 1) & odd | 1 << 2 * m
    return np.where((begins | begins >> 1) & odd < (ends & -ends), 1, 2)


def _ordered(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both by high, then low (none below 0): as one number each, where they fit in one."""
    bits = int(low.max(initial=0)).bit_length()
    if int(high.max(initial=0)).bit_length() + bits < 63:
        both = np.sort(high << bits | low)
        return both >> bits, both & ((1 << bits) - 1)
    order = np.lexsort((low, high))
    return high[order], low[order]


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Places by high, then low (none below 0), then place."""
    bits = int(low.max(initial=0)).bit_length()
    if int(high.max(initial=0)).bit_length() + bits < 63:
        return _ordered(high << bits | low, np.arange(len(high)))[1]
    return np.lexsort((low, high))


#: Sides b of so many letters are looked through bit by bit, longer ones by codes; seeds and words that are filled together.
NEAR, WORDS = 512, 1 << 15

Hits = list[tuple[np.ndarray, np.ndarray, int, np.ndarray]]


def _hits(a: list[bytes], b: list[bytes], k: int, r: int, places: bool = True) -> tuple[np.ndarray, np.ndarray, Hits]:
    """Seeds of many pairs of A, C, G, T (their pair and start), and where they are found: (seed, place of b, length, cost),
    in no order and some more than once. Without places those of short sides may be wrong, the rest is not."""
    code_of = np.full(256, 4, np.uint8)
    code_of[[65, 67, 84, 71]] = range(4)
    side_a, side_b = (code_of[np.frombuffer(b"".join(x), np.uint8)] for x in (a, b))
    if (side_a > 3).any() or (side_b > 3).any():
        raise ValueError("a sequence has other letters than A, C, G, T")
    size_a, size_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    count = size_a // k
    row = np.repeat(np.arange(len(a)), count)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * k
    at = (np.cumsum(size_a) - size_a)[row] + start
    near = (size_b <= NEAR)[row]
    own, found = np.flatnonzero(near), []
    step = max(1, WORDS // max(1, -(-int(size_b[row[own]].max(initial=0)) // (64 - k))))
    for f in range(0, len(own), step):
        some = own[f : f + step]
        found += [(some[seed], *x) for seed, *x in _by_bits(side_a, at[some], row[some], side_b, size_b, k, r, places)]
    own = np.flatnonzero(~near)
    if len(own):
        found += [(own[seed], *x) for seed, *x in _by_codes(window_codes(side_a, k)[at[own]], row[own], side_b, size_b, k, r)]
    return row, start, found


def _by_bits(side_a: np.ndarray, at: np.ndarray, row: np.ndarray, side_b: np.ndarray, size_b: np.ndarray, k: int, r: int, places: bool) -> Hits:
    """Hits of seeds (at places of side_a, in pairs row): a word has a bit for each of 64 places of b. Bit j of a state stays
    while the seed's letters up to now are those from place j on, without an edit or with one of a kind."""
    # Words of the pairs: a window that starts in the first `step` places of a word ends in it.
    step = 64 - k
    pairs = np.unique(row)
    words = np.maximum(1, -(-(size_b[pairs] - k + 2) // step))
    pair = np.repeat(np.arange(len(pairs)), words)
    first = (np.arange(len(pair)) - (np.cumsum(words) - words)[pair]) * step  # place of a word's bit 0
    left = size_b[pairs][pair] - first
    letters = np.append(side_b, np.full(64, 4, np.uint8))
    base = (np.cumsum(size_b) - size_b)[pairs][pair] + first
    data = letters[np.minimum(base, len(side_b))[:, None] + np.arange(64)]
    masks = np.stack([np.packbits(data == c, axis=1, bitorder="little").view("<u8").ravel() for c in range(4)])
    # Seeds by words.
    own = np.searchsorted(pairs, row)
    n = words[own]
    seed = np.repeat(np.arange(len(row)), n)
    word = np.repeat((np.cumsum(words) - words)[own] - np.cumsum(n) + n, n) + np.arange(len(seed))
    same = np.full(len(seed), ~np.uint64(0))
    other, less, more = np.zeros((3, len(seed)), np.uint64)
    letter = at[seed]
    for t in range(k):
        mask = masks[side_a[letter + t], word]
        here = mask >> np.uint64(t)
        if r > 1:
            other = (other & here) | (same & ~here)
            less = (less & (mask >> np.uint64(t - 1)) | same) if t else same
            more = (more | same) & (mask >> np.uint64(t + 1))
        same = same & here
    kinds = [(same, k, 0)] if r == 1 else [(same, k, 0), (other, k, 1), (less, k - 1, 1), (more | same, k + 1, 1)]
    found = []
    for state, length, cost in kinds:
        if not length:
            continue  # a deletion of all of a seed is found anywhere, and tells nothing
        room = np.minimum(np.maximum(left - length + 1, 0), step).astype(np.uint64)
        state = state & ((np.uint64(1) << room) - np.uint64(1))[word]
        lane = np.flatnonzero(state)
        j = first[word[lane]]
        if places:
            parts = state[lane].astype("<u8").view(np.uint8)
            some = np.flatnonzero(parts)
            bits = np.flatnonzero(np.unpackbits(parts[some], bitorder="little").view(bool))
            bit = (some[bits >> 3] << 3) + (bits & 7)
            lane, j = lane[bit >> 6], j[bit >> 6] + (bit & 63)
        found.append((seed[lane], j, length, np.full(len(lane), cost)))
    return found


def _by_codes(own: np.ndarray, row: np.ndarray, side_b: np.ndarray, size_b: np.ndarray, k: int, r: int) -> Hits:
    """Hits of seeds (their codes and pairs): they and windows are joined on pair and code by sorting."""
    first_b = np.cumsum(size_b) - size_b
    row_b, base, asked = np.repeat(np.arange(len(size_b)), size_b), first_b[row], np.bincount(row, minlength=len(size_b)) > 0

    def joined(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Seeds and places of b: windows of that length with the seed's code."""
        windows = window_codes(side_b, length)
        at = np.flatnonzero((row_b[: len(windows)] == row_b[length - 1 :]) & asked[row_b[: len(windows)]]) if len(windows) else np.zeros(0, np.int64)
        if not len(at):
            return at, at
        there, kinds, words = np.arange(len(codes)), 1 << 2 * length, windows[at]
        if (len(size_b) * kinds).bit_length() > 62:  # words are numbered
            known, words = np.unique(words, return_inverse=True)
            kinds, where = len(known), np.minimum(np.searchsorted(known, codes), len(known) - 1)
            there = np.flatnonzero(known[where] == codes)
            codes = where[there]
        key, place = _ordered(row_b[at] * kinds + words, at)
        want = row[there] * kinds + codes
        low, n = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
        n -= low
        seed = np.repeat(there, n)
        return seed, place[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(seed))] - base[seed]

    def hits(seed: np.ndarray, j: np.ndarray, length: int, cost: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        return seed, j, length, np.full(len(seed), cost)

    if r == 1:
        return [hits(*joined(own, k), k, 0)]
    if k < 4:  # halves of so few letters are found nearly everywhere
        wanted: dict[int, list[tuple[np.ndarray, int]]] = {k: [(own, 0)]}
        for length, codes in _neighbours(own, k):
            wanted.setdefault(length, []).append((codes, 1))
        # A deletion of all of a seed is found anywhere, and tells nothing.
        return [hits(*joined(codes, length), length, cost) for length, lists in wanted.items() if length for codes, cost in lists]
    # An edit leaves one half of the seed as it is: the first, where a match begins, or the last, where it ends.
    half, found = k // 2, []
    first, last = joined(own >> 2 * (k - half), half), joined(own & ((1 << 2 * (k - half)) - 1), k - half)
    seed = np.concatenate([first[0], last[0]])
    code, begin, room = own[seed], base[seed], size_b[row[seed]]
    for length in (k - 1, k, k + 1):
        j = np.concatenate([first[1], last[1] + (k - half) - length])
        inside = np.flatnonzero((j >= 0) & (j + length <= room))
        cost = _edits(code[inside], k, window_codes(side_b, length)[begin[inside] + j[inside]] if len(inside) else code[:0], length)
        near = cost < 2
        inside = inside[near]
        found.append((seed[inside], j[inside], length, cost[near]))
    return found


def batch_matches(a: list[bytes], b: list[bytes], k: int, r: int) -> dict[str, np.ndarray]:
    """Matches of many pairs of A, C, G, T at once: row (the pair), start_i, start_j, end_i, end_j, match_cost, each once, in
    this order."""
    row, start, found = _hits(a, b, k, r)
    found = found or [(start[:0], start[:0], k, start[:0])]
    # Below a place: one more than the length less k, and the cost.
    seed, rest = _ordered(np.concatenate([x[0] for x in found]), np.concatenate([j << 3 | (length - k + 1) << 1 | cost for _, j, length, cost in found]))
    new = np.ones(len(seed), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (rest[1:] >> 1 != rest[:-1] >> 1)  # the least cost of each start and end comes first
    seed, rest = seed[new], rest[new]
    i, j = start[seed], rest >> 3
    return {"row": row[seed], "start_i": i, "start_j": j, "end_i": i + k, "end_j": j + k - 1 + (rest >> 1 & 3), "match_cost": rest & 1}


def seed_costs(a: list[bytes], b: list[bytes], k: int, r: int) -> dict[str, np.ndarray]:
    """Seeds of many pairs and the least cost of their matches (r where there is none): row, start_i, match_cost. The matches
    are neither sorted nor told apart."""
    row, start, found = _hits(a, b, k, r, False)
    least = np.full(len(row), r)
    for most in (1, 0):
        for seed, _, _, cost in found:
            least[seed[cost == most]] = most
    return {"row": row, "start_i": start, "match_cost": least}


def consistent(a: list[bytes], b: list[bytes], found: dict[str, np.ndarray], k: int, r: int) -> dict[str, np.ndarray]:
    """batch_matches() and, of those that may cost one more, the matches with start or end one letter of b earlier or later
    that are missing, as often as they come."""
    near = np.flatnonzero(found["match_cost"] + 1 < r)
    more = []
    for s, e in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        own = {c: v[near] for c, v in found.items()}
        more.append(own | {"start_j": own["start_j"] + s, "end_j": own["end_j"] + e, "match_cost": own["match_cost"] + 1})
    added = {c: np.concatenate([x[c] for x in more]) for c in found}
    base = np.cumsum([0, *map(len, a)])
    most = max(map(len, b), default=0) + 3

    def code(x: dict[str, np.ndarray]) -> np.ndarray:
        place = (base[x["row"]] + x["row"] + x["start_i"]) * most + x["start_j"] + 1
        return (place * (k + 5) + x["end_j"] - x["start_j"] + 2) * (r + 1) + x["match_cost"]

    missing = ~np.isin(code(added), code(found))
    return {c: np.concatenate([v, added[c][missing]]) for c, v in found.items()}


def suffix_arrays(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of many sequences that lie end to end, each with a place behind its end: places of all suffixes, the empty one of each
    included, by sequence and in order within it. Ranks of twice as many letters come from two ranks of as many, until no
    two are equal."""
    lane = np.repeat(np.arange(len(size)), size + 1)
    last = np.cumsum(size + 1) - 1
    letter = np.zeros(len(lane), np.int64)
    inner = np.ones(len(lane), bool)
    inner[last] = False
    letter[inner] = codes + 1
    _, rank = np.unique(lane * 8 + letter, return_inverse=True)
    ahead, places = 1, np.arange(len(lane))
    while len(rank) and rank.max() < len(rank) - 1:
        after = np.minimum(places + ahead, last[lane])  # beyond its end a suffix is empty, and less than all others
        _, rank = np.unique(rank * len(rank) + rank[after], return_inverse=True)
        ahead *= 2
    out = np.empty(len(rank), np.int64)
    out[rank] = places
    return out


def grown_seeds(a: list[bytes], b: list[bytes], most: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Seeds of a that are as short as they can be with at most `most` hits in b: from a's end on, a seed grows to the left
    until it has so few, and the next one ends where it starts; what is left at a's start is no seed. Seeds (row, start,
    end, hits) and their matches (row, start_i, start_j, end_i, end_j), in order.

    The suffixes of all b's are sorted, with a table of how often each letter comes before the first suffixes; so a letter
    more on the left of all pairs' growing seeds is looked up at once.
    """
    code_of = np.full(256, 4, np.int64)
    code_of[[65, 67, 84, 71]] = range(4)
    side_a, side_b = (code_of[np.frombuffer(b"".join(x), np.uint8)] for x in (a, b))
    if (side_a > 3).any() or (side_b > 3).any():
        raise ValueError("a sequence has other letters than A, C, G, T")
    size_a, size_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    first_a, base = np.cumsum(size_a) - size_a, np.cumsum(size_b + 1) - size_b - 1
    order = suffix_arrays(side_b, size_b)
    spread = np.full(len(order), 4)  # letters of b by place, and 4 behind each end
    inner = np.ones(len(order), bool)
    inner[base + size_b] = False
    spread[inner] = side_b
    lane = np.repeat(np.arange(len(b)), size_b + 1)
    before = np.where(order == base[lane], 4, spread[order - 1])
    seen = np.zeros((4, len(order) + 1), np.int64)
    for c in range(4):
        seen[c, 1:] = np.cumsum(before == c)
    count = np.array([np.bincount(lane[spread == c], minlength=len(b)) for c in range(4)]).reshape(4, -1)
    smaller = base + 1 + np.cumsum(count, axis=0) - count  # where each lane's suffixes with that first letter begin
    low, high, end = base.copy(), base + size_b + 1, size_a.copy()
    seeds, ranges = [], []
    for t in range(int(size_a.max(initial=0))):
        own = np.flatnonzero(size_a > t)
        i = size_a[own] - 1 - t
        c = side_a[first_a[own] + i]
        low[own], high[own] = (smaller[c, own] + seen[c, x[own]] - seen[c, base[own]] for x in (low, high))
        few = own[high[own] - low[own] <= most]
        start = size_a[few] - 1 - t
        seeds.append(np.stack([few, start, end[few], high[few] - low[few]]))
        ranges.append(low[few])
        end[few], low[few], high[few] = start, base[few], base[few] + size_b[few] + 1
    row, start, stop, hits = np.concatenate(seeds, axis=1) if seeds else np.zeros((4, 0), np.int64)
    first = np.concatenate(ranges) if ranges else np.zeros(0, np.int64)
    by = np.lexsort((start, row))
    row, start, stop, hits, first = row[by], start[by], stop[by], hits[by], first[by]
    seed = np.repeat(np.arange(len(row)), hits)
    at = order[np.repeat(first - np.cumsum(hits) + hits, hits) + np.arange(len(seed))] - base[row[seed]]
    found = np.stack([row[seed], start[seed], at, stop[seed], at + stop[seed] - start[seed]])
    found = found[:, np.lexsort(found[::-1])]
    return dict(zip(("row", "start", "end", "hits"), (row, start, stop, hits), strict=True)), dict(zip(("row", "start_i", "start_j", "end_i", "end_j"), found, strict=True))


def potential(n: np.ndarray, i: np.ndarray, k: int, r: int) -> np.ndarray:
    return r * np.maximum(0, n // k - -(-i // k))


#: Costs by diagonal of all matches that are looked ahead from together.
AHEAD = 1 << 20


def locally_pruned(a: list[bytes], b: list[bytes], found: dict[str, np.ndarray], k: int, r: int, look_ahead: int) -> dict[str, np.ndarray]:
    """Those of batch_matches() that are worth keeping. A match's window are look_ahead seeds, its own the first. It is kept
    if some path from its end comes to the window's end, or to the start of a match that is kept, for less than the
    potential from the match's start up to there, the match's own cost included.

    Which of these places a match can reach does not depend on what else is kept, so being kept spreads from the matches
    that reach their window's end to those that reach one kept already. A match is first followed only to the nearest
    starts of others that it reaches, mostly the next of its diagonal's; it is kept if one of them is. Those that this
    leaves open are followed through their whole window, all at once.
    """
    row, start, end_j, cost = (found[c] for c in ("row", "start_i", "end_j", "match_cost"))
    n = np.array([len(x) for x in a], np.int64)
    place = (row * (int(n.max(initial=0)) // k + 1) + start // k) * (max(map(len, b), default=0) + 1)
    starts, of_start = np.unique(place + found["start_j"], return_inverse=True)
    keep = np.zeros(len(row), bool)
    reaching, reached = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, AHEAD // (2 * r * look_ahead + 1))
    base_a, base_b = (np.cumsum([0, *(len(x) for x in y[:-1])]) if y else np.zeros(0, np.int64) for y in (a, b))
    text_a, text_b = (np.frombuffer(b"".join(y) + b"?", np.uint8) for y in (a, b))
    size_b = np.array([len(x) for x in b], np.int64)
    offset = np.arange(-r * look_ahead, r * look_ahead + 1, dtype=np.int32)

    def follow(own: np.ndarray, nearest: bool) -> np.ndarray:
        """Marks matches that reach their window's end, and notes the starts that they reach. nearest: only up to the first
        place where they reach any; which ones stopped there."""
        stopped = [own[:0]]
        stop = np.minimum(start[own] // k + look_ahead, n[row[own]] // k) * k
        paths = np.where(offset == 0, cost[own, None], np.where(offset > 0, cost[own, None] + offset, 1 << 20)).astype(np.int32)
        i = start[own] + k
        while len(own):
            j = end_j[own, None] + (i - start[own] - k)[:, None] + offset
            paths[j > size_b[row[own], None]] = 1 << 20
            if not (i[0] - start[own[0]]) % k:  # at a seed's start, all matches at once
                worth = potential(n[row[own]], start[own], k, r) - potential(n[row[own]], i, k, r)
                cheap = paths < worth[:, None]
                last = i >= stop
                keep[own[last]] = cheap[last].any(axis=1)
                x, y = np.nonzero(cheap)
                code = (row[own[x]] * (int(n.max()) // k + 1) + i[x] // k) * (int(size_b.max()) + 1) + j[x, y]
                at = np.minimum(np.searchsorted(starts, code), len(starts) - 1)
                hit = starts[at] == code
                reaching.append(own[x[hit]])
                reached.append(at[hit])
                going = ~last & (paths.min(axis=1) < potential(n[row[own]], start[own], k, r) - potential(n[row[own]], stop, k, r))
                if nearest:
                    stops = np.zeros(len(own), bool)
                    stops[x[hit]] = True
                    stopped.append(own[going & stops])
                    going &= ~stops
                own, i, stop, paths, j = own[going], i[going], stop[going], paths[going], j[going]
            if not len(own):
                break
            letters = text_b[np.minimum(base_b[row[own], None] + np.maximum(j, 0), len(text_b) - 1)]
            unlike = letters != text_a[base_a[row[own]] + i][:, None]
            paths[:, :-1] = np.minimum(paths[:, :-1] + unlike[:, :-1], paths[:, 1:] + 1)
            paths[:, -1] += unlike[:, -1]
            paths[j + 1 > size_b[row[own], None]] = 1 << 20
            paths = np.minimum.accumulate(paths - offset, axis=1) + offset
            i = i + 1
        return np.concatenate(stopped)

    def spread() -> None:
        of, to = np.concatenate(reaching), np.concatenate(reached)
        while True:
            kept_start = np.zeros(len(starts), bool)
            kept_start[of_start[keep]] = True
            more = of[kept_start[to]]
            if keep[more].all():
                return
            keep[more] = True

    left = np.arange(len(row))
    for nearest in (True, False):
        left = np.concatenate([left[:0], *(follow(left[s : s + step], nearest) for s in range(0, len(left), step))])
        spread()
        left = left[~keep[left]]
    return {c: v[keep] for c, v in found.items()}
