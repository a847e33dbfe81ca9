"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has the bits that are set in over half of its shingles' hashes.
Fingerprints link if at most a few bits differ. Bits are grouped into parts, those that
go together into the same part, so that parts say different things. If a probe may
differ by t1, t2, ... bits in the parts, and the t + 1 add up to the allowed bits and one,
every linked fingerprint is within t of the probe in some part. So each fingerprint is
given its own thresholds, by dynamic programming over how many fingerprints are expected
within each distance of its parts: a part in which it looks like very many others
is not searched at all, and one in which it stands alone is searched wider.

The expected numbers follow from histograms over all fingerprints, of up to eight bits at
once, as if these were independent. Only their cost depends on that, never a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinline.llm.components import components
from twinline.llm.flat import UPPER_TO_LOWER, buckets, dealt, mix, run_lengths, runs, unpacked
from twinline.session import ship, written

BITS, SEED = 64, 42
# Numbers of parts to choose from, and bits of a histogram.
PARTS, ATOM_BITS = (2, 3, 4, 5), 8
# Shingles of a document whose bits are counted at once.
COUNTED = 1 << 16
# What a probe costs, in comparisons of two fingerprints.
PROBE_COST = 8.0
# Rows of a task that meets probes, pairs it compares at once, and probes and entries of a tile.
TASK_ROWS, PAIRS, TILE = 1 << 21, 1 << 21, 1 << 14
# Keys of which more rows than a tile are known to every task, the most frequent ones (24 bytes each).
HOT_KEYS = 1 << 16
# Fingerprints of a tile that others are held against first.
PIVOTS = 16
ENTRY, PROBE = 0, 1

LOWER = UPPER_TO_LOWER.tobytes()


def fingerprint(text: str | None, grams: int) -> int:
    """The fingerprint of a whole text, unsigned."""
    words = (text or "").encode().translate(LOWER).split()  # ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    reach = min(grams, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    places = list(zip(starts[: len(words) - reach].tolist(), stops[reach:].tolist()))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(places), COUNTED):
        some = np.array([digest(joined[a:b], SEED) for a, b in places[at : at + COUNTED]], ">u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(places)).tobytes(), "big")


def fingerprints(docs: DataFrame, grams: int) -> DataFrame:
    """``(doc_id, fingerprint)``, as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), grams) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.mapInArrow(scan, "doc_id long, fingerprint long")


def _bits(prints: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each fingerprint, the lowest first."""
    return np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _prints(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)


def _summed(classes: DataFrame, size: int, count) -> np.ndarray:
    """The sum over all fingerprints of ``count(prints)``, an array of ``size`` longs or doubles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            prints = _prints(batch)
            for at in range(0, len(prints), COUNTED):
                total += count(prints[at : at + COUNTED])
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": place.astype(np.int32), "part": total[place]})

    told = classes.select("fingerprint").mapInArrow(scan, "place int, part double")
    sums = np.zeros(size)
    for place, part in told.groupBy("place").agg(F.sum("part")).collect():
        sums[place] = part
    return sums


def bits_together(classes: DataFrame) -> np.ndarray:
    """How many fingerprints have both of two bits; the last number says how many there are."""

    def count(prints: np.ndarray) -> np.ndarray:
        bits = _bits(prints).astype(np.float32)
        return np.append((bits.T @ bits).ravel(), len(prints))

    return _summed(classes, BITS * BITS + 1, count)


def grouped_bits(together: np.ndarray, parts: int) -> list[list[int]]:
    """All bits in ``parts`` groups of about equal size, those that go together in one.

    A group starts with the pair of free bits most correlated, and takes in the bit that is
    most correlated with those it holds.
    """
    n = max(1.0, together[-1])
    both = together[:-1].reshape(BITS, BITS) / n
    share = np.diag(both)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs(both - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, groups = set(range(BITS)), []
    for left in range(parts, 0, -1):
        size = len(free) // left
        rest = sorted(free)
        pair = np.unravel_index(np.argmax(related[np.ix_(rest, rest)]), (len(rest), len(rest)))
        group = list(dict.fromkeys(rest[int(i)] for i in pair))
        while len(group) < size:
            rest = [b for b in sorted(free) if b not in group]
            group.append(max(rest, key=lambda b: (related[b, group].sum(), -b)))
        free -= set(group)
        groups.append(group)
    return groups


class Part(NamedTuple):
    """Bits of a part, which of a fingerprint they are, and the masks that change 0, 1, ... of them."""

    bits: list[int]
    mask: np.uint64
    flips: list[np.ndarray]


def part_of(bits: list[int], most: int) -> Part:
    flips = [np.array([sum(1 << b for b in some) for some in combinations(sorted(bits), k)], np.uint64) for k in range(min(most, len(bits)) + 1)]
    return Part(bits, np.uint64(sum(1 << b for b in bits)), flips)


def atoms_of(groups: list[list[int]]) -> list[list[list[int]]]:
    return [[g[i : i + ATOM_BITS] for i in range(0, len(g), ATOM_BITS)] for g in groups]


def _values(bits: np.ndarray, atom: list[int]) -> np.ndarray:
    return np.packbits(bits[:, atom], axis=1, bitorder="little")[:, 0]


class Plan:
    """Parts, and what is expected within each distance of a part of a fingerprint."""

    def __init__(self, groups: list[list[int]], histograms: np.ndarray, n: float, most: int):
        self.groups, self.most, self.n = groups, most, n
        self.atoms = atoms_of(groups)
        far = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
        near = np.stack([far == d for d in range(most + 1)]).astype(float)
        shares = iter(histograms / max(1.0, n))
        self.within = [[(near @ next(shares)).T for _ in atoms] for atoms in self.atoms]  # share of all at each distance

    def costs(self, bits: np.ndarray) -> list[np.ndarray]:
        """For each part, the cost of searching it up to -1 (not at all), 0, 1, ... bits."""
        found = []
        for group, atoms, within in zip(self.groups, self.atoms, self.within):
            share = np.zeros((len(bits), self.most + 1))
            share[:, 0] = 1
            for atom, table in zip(atoms, within):
                own, joined = table[_values(bits, atom)], np.zeros_like(share)
                for d in range(self.most + 1):
                    for e in range(self.most + 1 - d):
                        joined[:, d + e] += share[:, d] * own[:, e]
                share = joined
            probes = np.cumsum([comb(len(group), d) for d in range(self.most + 1)])
            found.append(np.hstack([np.zeros((len(bits), 1)), self.n * np.cumsum(share, 1) + PROBE_COST * probes]))
        return found

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(threshold of each fingerprint in each part, its cost), the cheapest that lose no link."""
        budget = self.most + 1  # the thresholds, each and one, add up to this
        best = np.full((len(bits), budget + 1), np.inf)
        best[:, 0] = 0
        taken = []
        for costs in self.costs(bits):
            options = np.full((budget + 1, len(bits), budget + 1), np.inf)  # by units given to this part
            for units in range(budget + 1):
                options[units, :, units:] = best[:, : budget + 1 - units] + costs[:, [units]]
            taken.append(options.argmin(0))
            best = options.min(0)
        units, rows = np.full(len(bits), budget), np.arange(len(bits))
        limits = np.empty((len(bits), len(self.groups)), np.int64)
        for part in range(len(self.groups) - 1, -1, -1):
            given = taken[part][rows, units]
            limits[:, part], units = given - 1, units - given
        return limits, best[:, budget]


def plan_for(classes: DataFrame, most: int) -> tuple[Plan, int]:
    """The number of parts that costs least over all fingerprints, and how many rows it deals."""
    together = bits_together(classes)
    choices = [grouped_bits(together, parts) for parts in PARTS]
    atoms = [a for groups in choices for part in atoms_of(groups) for a in part]

    def count(prints: np.ndarray) -> np.ndarray:
        bits = _bits(prints)
        return np.concatenate([np.bincount(_values(bits, a), minlength=256) for a in atoms])

    histograms = _summed(classes, 256 * len(atoms), count).reshape(-1, 256)
    plans, at = [], 0
    for groups in choices:
        size = sum(map(len, atoms_of(groups)))
        plans.append(Plan(groups, histograms[at : at + size], together[-1], most))
        at += size
    probes = [np.array([[sum(comb(len(g), d) for d in range(t + 1)) for t in range(-1, most + 1)] for g in p.groups]) for p in plans]

    def cost(prints: np.ndarray) -> np.ndarray:
        bits, made = _bits(prints), []
        for plan, each in zip(plans, probes):
            limits, costs = plan.thresholds(bits)
            made += [costs.sum(), sum(each[k][limits[:, k] + 1].sum() for k in range(len(plan.groups)))]
        return np.array(made)

    told = _summed(classes, 2 * len(plans), cost).reshape(-1, 2)
    chosen = int(told[:, 0].argmin())
    return plans[chosen], int(told[chosen, 1] + together[-1] * len(plans[chosen].groups))


def _key(prints: np.ndarray, part: int) -> np.ndarray:
    return mix(prints + np.uint64(part + 1) * np.uint64(0x9E3779B97F4A7C15))


class Hot(NamedTuple):
    """Sorted keys of more rows than a tile, and into how many entry blocks and probe slices each is dealt."""

    keys: np.ndarray
    blocks: np.ndarray
    slices: np.ndarray

    def tiles(self, keys: np.ndarray, prints: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, tile) of each copy of a row: an entry goes to its block in all slices, a probe to its slice in all blocks."""
        rows = np.arange(len(keys))
        if not len(self.keys):
            return rows, np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hot = self.keys[at] == keys
        blocks, slices = np.where(hot, self.blocks[at], 1), np.where(hot, self.slices[at], 1)
        own = mix(prints ^ np.uint64(kind + 1))
        own = (own % np.where(kind == ENTRY, blocks, slices).astype(np.uint64)).astype(np.int64)
        copies = slices if kind == ENTRY else blocks
        rows = np.repeat(rows, copies)
        step = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
        return rows, own[rows] * slices[rows] + step if kind == ENTRY else step * slices[rows] + own[rows]


def filed(prints: np.ndarray, plan: Plan, parts: list[Part]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, keys, fingerprints): an entry for each part, a probe for each value within its threshold."""
    limits, _ = plan.thresholds(_bits(prints))
    for k, part in enumerate(parts):
        own = prints & part.mask
        yield ENTRY, _key(own, k), prints
        for d, flips in enumerate(part.flips):
            asking = np.flatnonzero(limits[:, k] >= d)
            for some in np.array_split(asking, max(1, len(asking) * len(flips) // PAIRS)):
                keys = _key((own[some][:, None] ^ flips).ravel(), k)
                yield PROBE, keys, np.repeat(prints[some], len(flips))


def hot_keys(classes: DataFrame, plan: Plan, most: int, tile: int) -> Hot:
    """Keys with more entries or probes than ``tile``, the HOT_KEYS most frequent ones at most."""
    parts = [part_of(g, most) for g in plan.groups]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, keys, _ in filed(_prints(batch), plan, parts):
                keys = np.sort(keys)
                first = runs(keys)
                n = run_lengths(first, len(keys))
                none = np.zeros(len(n), np.int64)
                both = (n, none) if kind == ENTRY else (none, n)
                yield pa.RecordBatch.from_pydict({"key": keys[first].view(np.int64), "entries": both[0], "probes": both[1]})

    told = classes.select("fingerprint").mapInArrow(scan, "key long, entries long, probes long")
    counts = told.groupBy("key").agg(F.sum("entries").alias("entries"), F.sum("probes").alias("probes"))
    hot = counts.filter(F.greatest("entries", "probes") > tile).filter("entries > 0 and probes > 0")
    top = hot.orderBy(F.desc("entries"), F.desc("probes"), "key").limit(HOT_KEYS).toArrow()
    keys, entries, probes = (top.column(c).to_numpy() for c in ("key", "entries", "probes"))
    order = np.argsort(keys.view(np.uint64))
    return Hot(keys.view(np.uint64)[order], -(-entries[order] // tile), -(-probes[order] // tile))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node it reaches) that connect what the links ``a``-``b`` connect."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = places[: len(a)], places[len(a) :], np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def compared(entries: np.ndarray, asking: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of all ``asking`` to all ``entries``, some at a time."""
    step = max(1, PAIRS // max(1, len(entries)))
    for at in range(0, len(asking), step):
        q, x = np.nonzero(np.bitwise_count(asking[at : at + step, None] ^ entries) <= most)
        yield asking[at + q], entries[x]


def links_in_tile(entries: np.ndarray, asking: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what all links of ``asking`` to ``entries`` connect.

    All are held against a few pivots first, each an entry that none before it links. Two that the
    same pivot links are connected, so they needn't be compared: copies of one text that
    differ a little take time in proportion to their number.
    """
    group_x, group_q = np.full(len(entries), -1), np.full(len(asking), -1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(entries) * len(asking) > PAIRS:
        for nth in range(PIVOTS):
            free = np.flatnonzero(group_x < 0)
            if not len(free):
                break
            pivot = entries[free[0]]
            for values, group in ((entries, group_x), (asking, group_q)):
                near = (np.bitwise_count(values ^ pivot) <= most) & (group < 0)
                group[near] = nth
                found.append((values[near], np.full(near.sum(), pivot)))
    for nth in range(group_q.max(initial=-1) + 1):
        found.extend(compared(entries[group_x != nth], asking[group_q == nth], most))
        found = [forest(*(np.concatenate(side) for side in zip(*found)))]
    held = 0
    for some in compared(entries, asking[group_q < 0], most):
        found.append(some)
        held += len(some[0])
        if held > PAIRS:
            found, held = [forest(*(np.concatenate(side) for side in zip(*found)))], 0
    if not found:
        return entries[:0], entries[:0]
    return forest(*(np.concatenate(side) for side in zip(*found)))


def links_of(classes: DataFrame, most: int, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` between fingerprints that connect just what all pairs within ``most`` bits connect."""
    plan, rows = plan_for(classes, most)
    parts = [part_of(g, most) for g in plan.groups]
    hot = hot_keys(classes, plan, most, tile)
    extra = int((hot.blocks * hot.slices).sum()) * tile
    count = max(buckets(classes), (rows + extra) // TASK_ROWS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, keys, prints in filed(_prints(batch), plan, parts):
                row, tile_of = hot.tiles(keys, prints, kind)
                keys, prints = keys[row], prints[row]
                spread = mix(keys + tile_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                bucket = (spread % np.uint64(count)).astype(np.int32)
                kinds = np.full(len(keys), kind, np.uint8)
                if len(keys):
                    yield dealt(bucket, {"keys": spread, "prints": prints, "kinds": kinds})

    def meet(table: pa.Table) -> pa.Table:
        keys, prints, kinds = unpacked(table, "keys", "u8"), unpacked(table, "prints", "u8"), unpacked(table, "kinds", "u1")
        sides = []
        for kind in (ENTRY, PROBE):
            own = np.flatnonzero(kinds == kind)
            own = own[np.lexsort((prints[own], keys[own]))]
            sides.append((keys[own], prints[own]))
        (entry_keys, entries), (probe_keys, asking) = sides
        first = np.searchsorted(entry_keys, probe_keys, "left")
        size = np.searchsorted(entry_keys, probe_keys, "right") - first
        found = [(entries[:0], entries[:0])]
        start = runs(probe_keys)
        stop = start + run_lengths(start, len(probe_keys))
        large = size[start] * (stop - start) > PAIRS if len(start) else np.zeros(0, bool)
        for a, b in zip(start[large].tolist(), stop[large].tolist()):
            found.append(links_in_tile(entries[first[a] : first[a] + size[a]], asking[a:b], most))
        small = np.flatnonzero(np.repeat(~large, stop - start) & (size > 0)) if len(start) else start
        steps = np.cumsum(size[small]) // PAIRS
        for some in np.split(small, np.flatnonzero(np.diff(steps)) + 1):
            q = np.repeat(some, size[some])
            x = np.arange(len(q)) - np.repeat(np.cumsum(size[some]) - size[some], size[some]) + np.repeat(first[some], size[some])
            near = (np.bitwise_count(asking[q] ^ entries[x]) <= most) & (asking[q] > entries[x])
            found.append(forest(asking[q[near]], entries[x[near]]))
        a, b = forest(*(np.concatenate(side) for side in zip(*found)))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    rows = classes.select("fingerprint").mapInArrow(deal, "bucket int, keys binary, prints binary, kinds binary")
    return rows.groupBy("bucket").applyInArrow(meet, "a long, b long").filter("a <> b")


def near_duplicates(
    df: DataFrame, grams: int = 4, most: int = 4, doc_id: str = "doc_id", text: str = "text", tile: int = TILE
) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row for each row of ``df``.

    Shingles are ``grams`` words (runs without ASCII white space, A-Z lower-cased) joined by a space,
    each as often as it comes; a shorter text is one shingle. A bit of the fingerprint (16
    hexadecimal digits) is 1 if it is in over half of the shingles' XXH64. Null and empty
    texts have fingerprint zero, which links like any other. Fingerprints link if at most
    ``most`` bits differ; component_id is the smallest doc_id that links reach.

    A null doc_id links nothing and has a null component_id. Rows that share a doc_id are
    one document, linked by any of its texts. Other columns are ignored; an empty table
    gives an empty one.
    """
    ship(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = written(fingerprints(docs, grams), "fingerprints")
    known = prints.filter("doc_id is not null")
    classes = written(known.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    own = known.groupBy("doc_id").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("last")).filter("b <> last")
    shared = known.join(own, "doc_id").select(F.col("fingerprint").alias("a"), "b")
    joined = components(links_of(classes, most, tile).union(shared))
    members = classes.join(joined, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    smallest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = members.join(smallest, "component").select("fingerprint", "component_id")
    return prints.join(answers, "fingerprint", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
