"""Edit distance of many pairs of texts at once."""

from __future__ import annotations

import numpy as np

WORD = 64
ALL, ONE = np.uint64(2**64 - 1), np.uint64(1)
# Words of a shorter text up to which pairs are worked on together; the others one by one. So are
# the longest ones, as a step of all costs as much as one of ``ENOUGH`` pairs by themselves.
MOST_BLOCKS, ENOUGH = 64, 16
# Words that the table of matching places may take, and words worked on together.
TABLE_WORDS, TOGETHER = 1 << 21, 4096


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each text begins."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def _one(pattern: str, text: str) -> int:
    """For a pattern of any length: its column of the distance table as two long numbers."""
    n = len(pattern)
    whole, last = (1 << n) - 1, 1 << (n - 1)
    where: dict[str, int] = {}
    places: dict[str, list[int]] = {}
    for i, c in enumerate(pattern):
        places.setdefault(c, []).append(i)
    for c, own in places.items():
        bits = bytearray(n // 8 + 1)
        for i in own:
            bits[i >> 3] |= 1 << (i & 7)
        where[c] = int.from_bytes(bits, "little")
    up, down, distance = whole, 0, n
    for c in text:
        equal = where.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal | down
        rises, falls = down | (whole & ~(across | up)), up & across
        if rises & last:
            distance += 1
        elif falls & last:
            distance -= 1
        rises, falls = (rises << 1 | 1) & whole, (falls << 1) & whole
        vertical = equal | down
        up, down = falls | (whole & ~(vertical | rises)), rises & vertical
    return distance


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _together(codes: np.ndarray, starts, lengths, from_, sizes, alphabet: int) -> np.ndarray:
    """Distances of pairs, whatever their numbers of words; pairs by falling number of steps.

    A column of the distance table is kept as the steps down it: a bit where it rises and
    one where it falls, for every place of the pattern. A pattern's words stand side by side, all
    pairs' in one array. A word is a column behind the one above it, whose last step it takes
    over, so one operation advances every word. Before its first column a word sees a character
    that no pattern has, which changes nothing; what it does after its last isn't looked at.
    """
    n, blocks = len(starts), -(-lengths // WORD)
    first, pair = np.cumsum(blocks) - blocks, np.repeat(np.arange(n), blocks)
    count, below = len(pair), np.arange(len(pair)) - first[pair]
    row, at = np.repeat(np.arange(n), lengths), _spans(np.zeros(n, np.int64), lengths)
    table = np.zeros(count * (alphabet + 1), np.uint64)  # where in each word each character is
    own = (first[row] + at // WORD) * (alphabet + 1) + codes[_spans(starts, lengths)]
    np.bitwise_or.at(table, own, ONE << (at % WORD).astype(np.uint64))
    late = blocks - 1
    begins = np.cumsum(sizes + 2 * late) - (sizes + 2 * late)
    texts = np.full(int((sizes + 2 * late).sum()), alphabet, np.int64)
    texts[_spans(begins + late, sizes)] = codes[_spans(from_, sizes)]
    seen, base = (begins + late)[pair] - below, np.arange(count) * (alphabet + 1)
    last = first + late
    ends, passes = np.zeros(count, np.uint64), np.full(count, ONE)
    ends[last], passes[last] = ONE, np.uint64(0)
    shift = np.full(count, WORD - 1, np.uint64)
    shift[last] = ((lengths - 1) % WORD).astype(np.uint64)
    up, down, gain = np.full(count, ALL), np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    # What a word takes over from the one above it; the topmost ones always a rise.
    rise_in, fall_in = np.zeros(count + 1, np.uint64), np.zeros(count + 1, np.uint64)
    rise_in[first] = ONE
    steps = sizes + late
    active = np.searchsorted(-steps, -np.arange(steps.max(initial=0)), "left")  # pairs with more than j steps
    words = np.append(first, count)[active].tolist()
    places, held = np.empty(count, np.int64), np.empty((5, count), np.uint64)
    size = None
    for w in words:
        if w != size:
            size = w
            u, d, g, rise, fall = up[:w], down[:w], gain[:w], rise_in[:w], fall_in[:w]
            rise_next, fall_next, at, s, own = rise_in[1 : w + 1], fall_in[1 : w + 1], seen[:w], shift[:w], base[:w]
            end, through, place = ends[:w], passes[:w], places[:w]
            equal, vertical, across, rises, falls = (x[:w] for x in held)
        texts.take(at, out=place, mode="clip")
        at += 1
        place += own
        table.take(place, out=equal, mode="clip")
        np.bitwise_or(equal, d, out=vertical)
        equal |= fall
        np.bitwise_and(equal, u, out=across)
        across += u
        across ^= u
        across |= equal
        np.bitwise_and(u, across, out=falls)
        across |= u
        np.invert(across, out=rises)
        rises |= d
        # The last place of a word: what it hands on, and of the last word the change of the distance.
        np.right_shift(rises, s, out=equal)
        equal &= ONE
        np.right_shift(falls, s, out=across)
        across &= ONE
        g += equal
        g -= across
        rises <<= ONE
        rises |= rise
        falls <<= ONE
        falls |= fall
        np.bitwise_or(equal, end, out=rise_next)
        np.bitwise_and(across, through, out=fall_next)
        np.bitwise_and(rises, vertical, out=d)
        vertical |= rises
        np.invert(vertical, out=vertical)
        np.bitwise_or(falls, vertical, out=u)
    return lengths + gain[last].view(np.int64)


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """The number of characters to insert, delete or replace to make each right text of the left one."""
    flat, starts = _codes([*left, *right])
    seen = np.zeros(int(flat.max(initial=0)) + 1, bool)
    seen[flat] = True
    codes = (np.cumsum(seen) - 1)[flat]
    count, size = len(left), np.diff(starts)
    swap = size[:count] > size[count:]
    short = np.where(swap, np.arange(count) + count, np.arange(count))
    long = np.where(swap, np.arange(count), np.arange(count) + count)
    n, m = size[short], size[long]
    found = m.copy()  # right where the shorter text is empty
    blocks = -(-n // WORD)
    rows = np.flatnonzero((blocks > 0) & (blocks <= MOST_BLOCKS))
    rows = rows[np.argsort(-(m + blocks)[rows], kind="stable")]
    steps = (m + blocks)[rows]
    cost = np.concatenate(([0], np.cumsum(steps))) + ENOUGH * np.append(steps, 0)
    apart = int(np.argmin(cost))  # so many of the longest go by themselves
    for row in [*np.flatnonzero(blocks > MOST_BLOCKS).tolist(), *rows[:apart].tolist()]:
        pair = (left[row], right[row])
        found[row] = 0 if pair[0] == pair[1] else _one(*sorted(pair, key=len))
    rows = rows[apart:]
    while len(rows):
        some, own, alphabet = _first(rows, blocks, TOGETHER), codes, int(seen.sum())
        if int(blocks[some].sum()) * (alphabet + 1) > TABLE_WORDS:
            # Many different characters: count those of these pairs alone, and take fewer pairs.
            some = _first(some, blocks, TABLE_WORDS // 256)
            here = np.zeros(alphabet, bool)
            for side in (short, long):
                here[codes[_spans(starts[side[some]], size[side[some]])]] = True
            own, alphabet = (np.cumsum(here) - 1)[codes], int(here.sum())
            some = _first(some, blocks, TABLE_WORDS // (alphabet + 1))
        found[some] = _together(own, starts[short[some]], n[some], starts[long[some]], m[some], alphabet)
        rows = rows[len(some) :]
    return found


def _first(rows: np.ndarray, blocks: np.ndarray, words: int) -> np.ndarray:
    """As many of the first rows as have ``words`` words together, and one at least."""
    return rows[: max(1, int(np.searchsorted(np.cumsum(blocks[rows]), words, "right")))]
