"""Benchmark decontamination: the q-gram lemma over diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm.chars import Run, runs
from tidewater.llm.shared import written

_FILTER_BITS = 20


#: Segments of an item have a third of its characters, within these bounds; each overlaps the next by half.
_SEGMENT = 48, 100


@dataclass
class Block:
    """A bounded part of the benchmark: folded items, where each q-gram occurs in them, and their parts: first each
    item whole, then its segments. first[i] is the first of item i's `count[i]` segments, `stride[i]` apart but for the last."""

    ids: list[int]
    parts: list[np.ndarray]
    of: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    budget: np.ndarray
    least: np.ndarray
    first: np.ndarray
    count: np.ndarray
    stride: np.ndarray
    lowest: np.ndarray
    seen: np.ndarray
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    q: int


def _block(rows: list[tuple[int, str]], rate: float, q: int) -> Block:
    run = next(runs([t for _, t in rows], most=1 << 40))
    items = [run.codes[s:e] for s, e in zip(run.starts, run.ends, strict=True)]
    sizes = run.ends - run.starts
    of, begin, size = list(range(len(items))), [0] * len(items), sizes.tolist()
    first, count, stride = (np.zeros(len(items), np.int64) for _ in range(3))
    for i, m in enumerate(sizes.tolist()):
        stride[i] = half = min(max(m // 3, _SEGMENT[0]), _SEGMENT[1]) // 2
        at = [*range(0, m - 2 * half, half), m - 2 * half] if m >= 3 * half else []
        first[i], count[i] = len(of), len(at)
        of, begin, size = of + [i] * len(at), begin + at, size + [2 * half] * len(at)
    of, begin, size = (np.array(x, np.int64) for x in (of, begin, size))
    # e edits spoil q grams each: of m - q + 1, this many stay
    budget = np.maximum(np.minimum((rate * size).astype(np.int64), (size - q) // q), 0)
    least = size - q + 1 - q * budget
    lowest = np.full(len(items), 1 << 40)
    np.minimum.at(lowest, of, least)
    h, inside = run.grams(q) if len(run.codes) >= q else (np.empty(0, np.uint64), np.empty(0, bool))
    at = np.flatnonzero(inside)
    item = np.searchsorted(run.ends, at, side="right")
    order = np.argsort(h[at], kind="stable")
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[h[at] >> np.uint64(64 - _FILTER_BITS)] = True
    parts = [items[i][b : b + m] for i, b, m in zip(of, begin, size, strict=True)]
    return Block([i for i, _ in rows], parts, of, begin, size, budget, least, first, count, stride, lowest, seen, h[at][order], item[order], (at - run.starts[item])[order], q)


def _dense(at: np.ndarray, item: np.ndarray, block: Block) -> np.ndarray:
    """Which hits lie where their item has as many as its least demanding part needs: in two adjacent stretches of text
    that no match is longer than. Stretches share counters, so counts are never too low."""
    mask = (1 << _FILTER_BITS) - 1
    cell = (item * 7_368_787 + at // (block.size + 2 * block.budget + 2)[item]) & mask
    count = np.bincount(cell, minlength=mask + 1)
    near = count + np.maximum(np.roll(count, 1), np.roll(count, -1))
    return near[cell] >= block.lowest[item]


def _parts_at(item: np.ndarray, place: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hit, part) for each part of the item that has the q-gram at place."""
    n, k = block.count[item], place // np.maximum(block.stride[item], 1)
    hits, parts = [np.arange(len(item))], [item]
    # the regular segments that can reach place, and the last one
    for number, ok in ((k, k < n - 1), (k - 1, (k >= 1) & (k - 1 < n - 1)), (n - 1, n > 0)):
        hits.append(np.flatnonzero(ok))
        parts.append((block.first[item] + number)[ok])
    hit, part = np.concatenate(hits), np.concatenate(parts)
    rest = place[hit] - block.begin[part]
    fits = (rest >= 0) & (rest + block.q <= block.size[part])
    return hit[fits], part[fits]


def banded_distance(item: np.ndarray, region: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Least edits that turn item into some stretch of region, within diagonals low to high:
    (edits, start, end of the stretch)."""
    diagonal, big = np.arange(low, high + 1), 1 << 20
    place = np.arange(len(diagonal))
    cost, origin = np.where((diagonal >= 0) & (diagonal <= len(region)), 0, big), diagonal
    for i in range(len(item)):
        at = i + diagonal
        ok = (at >= 0) & (at < len(region))
        best = np.where(ok, cost + (region[np.clip(at, 0, len(region) - 1)] != item[i]), big)
        up = np.append(cost[1:] + 1, big)  # a character of item without counterpart
        came = np.where(up < best, np.append(origin[1:], 0), origin)
        ahead = np.minimum(up, best) - diagonal
        least = np.minimum.accumulate(ahead)  # characters of region without counterpart
        source = np.maximum.accumulate(np.where(ahead == least, place, 0))
        cost, origin = least + diagonal, came[source]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), len(item) + int(diagonal[end])


def _reaches(places: dict[int, int], m: int, region: list[int], most: int) -> bool:
    """Whether some stretch of region is within `most` edits of a part of m characters, whose places of each character
    are bits: a column of the table of distances at a time, by Myers' bit vectors."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for c in region:
        same = places.get(c, 0)
        v, h = same | down, (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(h | up)), up & h
        score += bool(more & top) - bool(less & top)
        if score <= most:
            return True
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(v | more)), more & v
    return False


def _bits(part: np.ndarray) -> dict[int, int]:
    places: dict[int, int] = {}
    for k, c in enumerate(part.tolist()):
        places[c] = places.get(c, 0) | 1 << k
    return places


def _matches(run: Run, block: Block) -> Iterator[tuple[int, int, int, int, int]]:
    """(text of the run, item, start, end, edits)"""
    if len(run.codes) >= block.q and len(block.grams):
        h, inside = run.grams(block.q)
        at = np.flatnonzero(block.seen[h >> np.uint64(64 - _FILTER_BITS)] & inside)
        lo = np.searchsorted(block.grams, h[at], side="left")
        n = np.searchsorted(block.grams, h[at], side="right") - lo
        spread = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        where, item, place = np.repeat(at, n), block.item[spread], block.place[spread]
        dense = _dense(where, item, block)
        where, item, place = where[dense], item[dense], place[dense]
        hit, part = _parts_at(item, place, block)
        diagonal = where[hit] - (place[hit] - block.begin[part])
        # bands as wide as twice the budget, each overlapping the next by half
        band = np.floor_divide(diagonal, block.budget[part] + 1)
        # diagonals are negative where a part would start before the run
        shift = 1 << 39
        key = np.concatenate([part << 40 | (band + shift - 1), part << 40 | (band + shift)])
        # a q-gram that stays is at one place of the part, however often the text has it
        spot = np.tile(place[hit] - block.begin[part], 2)
        order = np.lexsort((spot, key))
        key, spot = key[order], spot[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (spot[1:] != spot[:-1])
        key, count = np.unique(key[new], return_counts=True)
        bits: dict[int, dict[int, int]] = {}
        found: dict[tuple[int, int], list] = {}
        for k in key[count >= block.least[key >> 40]]:
            p, b = int(k >> 40), int(k & ((1 << 40) - 1)) - shift
            i, e, m, whole = int(block.of[p]), int(block.budget[p]), int(block.size[p]), p < len(block.ids)
            lo_d, hi_d = b * (e + 1), (b + 2) * (e + 1)
            for text in range(int(np.searchsorted(run.ends, max(lo_d, 0), side="right")), len(run.ends)):
                if run.starts[text] >= hi_d + m:
                    break
                s, t = max(lo_d - e, int(run.starts[text])), min(hi_d + m + e, int(run.ends[text]))
                if t - s < m - e:
                    continue
                region = run.codes[s:t]
                if p not in bits:
                    bits[p] = _bits(block.parts[p])
                if not _reaches(bits[p], m, region.tolist(), e):
                    continue
                edits, a, z = _exact(block.parts[p], region) or banded_distance(block.parts[p], region, -e, max(t - s - m, 0) + e)
                if edits <= e:
                    spans = found.setdefault((text, i), [])
                    span = (not whole, edits, s - int(run.starts[text]) + a, s - int(run.starts[text]) + z)
                    clash = [x for x in spans if x[2] < span[3] and span[2] < x[3]]
                    if all(span < x for x in clash):
                        spans[:] = [x for x in spans if x not in clash] + [span]
        for (text, i), spans in found.items():
            for _, edits, a, z in spans:
                yield text, i, a, z, edits
    for i, item in enumerate(block.parts[: len(block.ids)]):
        if 0 < len(item) < block.q:  # too short for a gram: the text itself is sought
            needle, hay = item.astype("<u4").tobytes(), run.codes.astype("<u4").tobytes()
            pos = hay.find(needle)
            while pos >= 0:
                if pos % 4 == 0:
                    text = int(np.searchsorted(run.ends, pos // 4, side="right"))
                    a = pos // 4 - int(run.starts[text])
                    yield text, i, a, a + len(item), 0
                pos = hay.find(needle, pos + 1)


def _exact(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int] | None:
    pos = region.astype("<u4").tobytes().find(item.astype("<u4").tobytes())
    return (0, pos // 4, pos // 4 + len(item)) if pos >= 0 and pos % 4 == 0 else None


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    rate: float = 0.1,
    q: int = 7,
    block_chars: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Finds benchmark items inside texts: (id, item_id, start, end, edits), a row
    for each place of a text that some item, or a segment of it, turns into by at most `rate` of its
    length in edits (at most what leaves a q-gram untouched). Segments have a third of the item's characters, but 48 to 100,
    and overlap by half, so any run of half the item (72 to 150 characters) has one. Where the whole item matches,
    none of its segments is given; of overlapping segments the one with the fewest edits; edits are then the segment's. Case and the kind of
    white space don't count; start and end are characters of the given text.

    For each item, shared q-grams are counted in overlapping diagonal bands of it and its segments; bands with at least
    m - q + 1 - q * budget of them are aligned within the band. A text is never shuffled: the benchmark is broadcast, in
    blocks of at most `block_chars` characters or of one longer item, one at a time. If there are several, the corpus is read
    once: a bit for each q-gram of the whole benchmark, in a table of bounded size, first picks the texts that some block could
    match, and the blocks go over these, which were written.

    Null or empty items match nothing, and nothing matches null or empty texts;
    items shorter than q must occur as they are. Very long texts are searched whole, in their task. Repeated items and rows match
    each on their own. Null ids stay null. Extra columns are not read. If both ids have one name, the item's is
    benchmark_<name>. An empty table, of texts or of items, gives an empty one.
    """
    rows = benchmark.select(item_col, item_text_col).filter(F.length(item_text_col) > 0).orderBy(item_col, item_text_col)
    kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    names = id_col, item_col if item_col != id_col else f"benchmark_{item_col}"
    schema = f"`{names[0]}` {kinds[0].simpleString()}, `{names[1]}` {kinds[1].simpleString()}, start long, end long, edits long"
    texts = docs.select(id_col, text_col)
    total, longest = rows.agg(F.coalesce(F.sum(F.length(item_text_col)), F.lit(0)), F.coalesce(F.max(F.length(item_text_col)), F.lit(0))).first()
    found = docs.sparkSession.createDataFrame([], schema)
    several = total > max(block_chars, longest)
    if several:
        texts = written(_possible(texts, _needs(_parts(rows, block_chars), rate, q, total)), "possible")
    for part in _parts(rows, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(_block(part, rate, q))
        hits = _scan(texts, sent, schema, names, to_arrow_type(kinds[1]))
        if several:
            hits = written(hits, "contaminated")
            sent.destroy()
        found = found.unionByName(hits)
    return found


def _parts(rows: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    part, total = [], 0
    for item, text in rows.toLocalIterator():
        if part and total + len(text) > most:
            yield part
            part, total = [], 0
        part.append((item, text))
        total += len(text)
    if part:
        yield part


@dataclass
class Needs:
    """A bit for each q-gram of the benchmark; how many of its q-grams a match has at least, in a stretch of how many characters
    at most; and items that have no q-gram, folded."""

    bits: np.ndarray
    least: int
    stretch: int
    short: list[bytes]
    q: int


#: The table of bits has eight for each q-gram, but no more than so many (a power of two; 128 MB).
_MOST_BITS = 30


def _needs(parts: Iterator[list[tuple[int, str]]], rate: float, q: int, total: int) -> Needs:
    size = min(max((8 * total).bit_length(), _FILTER_BITS), _MOST_BITS)
    out = Needs(np.zeros(1 << (size - 3), np.uint8), 1 << 40, 1, [], q)
    for part in parts:
        block = _block(part, rate, q)
        cell = block.grams >> np.uint64(64 - size)
        np.bitwise_or.at(out.bits, (cell >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8))
        long = block.size >= q
        if long.any():
            out.least = min(out.least, int(block.least[long].min()))
            out.stretch = max(out.stretch, int((block.size + 2 * block.budget)[long].max()))
        out.short += [x.astype("<u4").tobytes() for x in block.parts[: len(block.ids)] if 0 < len(x) < q]
    return out


def _possible(texts: DataFrame, needs: Needs) -> DataFrame:
    """The texts with a stretch that has as many of the benchmark's q-grams as a match needs, or with a short item."""
    sent = texts.sparkSession.sparkContext.broadcast(needs)

    def chosen(batches):
        m = sent.value
        size = len(m.bits).bit_length() + 2
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for run in runs(batch.column(1).to_pylist()):
                if len(run.codes) >= m.q:
                    h, inside = run.grams(m.q)
                    cell = h >> np.uint64(64 - size)
                    hit = (m.bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & inside
                    through = np.append(0, np.cumsum(hit))
                    at = np.flatnonzero(hit)
                    text = np.searchsorted(run.ends, at, side="right")
                    dense = through[np.minimum(at + m.stretch, np.minimum(run.ends[text], len(hit)))] - through[at] >= m.least
                    keep[run.first + text[dense]] = True
                if m.short:
                    for k, (a, z) in enumerate(zip(run.starts, run.ends, strict=True)):
                        whole = run.codes[a:z].astype("<u4").tobytes()
                        keep[run.first + k] |= any(s in whole for s in m.short)
            yield batch.filter(pa.array(keep))

    return texts.mapInArrow(chosen, texts.schema)


def _scan(texts: DataFrame, sent, schema: str, names: tuple[str, str], item_type: pa.DataType) -> DataFrame:
    def scan(batches):
        block = sent.value
        for batch in batches:
            ids, out = batch.column(0), []
            for run in runs(batch.column(1).to_pylist()):
                out += [(run.first + text, block.ids[i], a, z, e) for text, i, a, z, e in _matches(run, block)]
            which, items, starts, ends, edits = list(zip(*out, strict=True)) or [[]] * 5
            columns = [ids.take(pa.array(which, pa.int64())), pa.array(items, item_type), *(pa.array(x, pa.int64()) for x in (starts, ends, edits))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "start", "end", "edits"])

    return texts.mapInArrow(scan, schema)
