"""Visual lines: cells of a page gathered into lines, in one pass from top to bottom.

Whether a cell belongs to a line depends on the cells that the line has got so far, so a
page is a fold over its cells in order.  Spark brings a page's cells together and sorts
them; the fold keeps only the last few lines, so a page may be of any size.  Pages don't
depend on each other, so a task takes their first cells together, then their second ones, and so on.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LineRule:
    """How a cell finds its line among the last `look_back`, the latest first.

    `middle` is what a line's height and place are: `mean` of the middles and greatest height,
    `first` cell's, or `median` of all.  A cell fits within `share` of the lower height, `least` at
    least, and doesn't fit a line that has a cell which it overlaps by more than `overlap` of
    the narrower one.  Cells sort by their top, or by their middle.  `within` names a column with
    the distance that fits, in the place of heights.
    """

    look_back: int
    share: float
    least: float = 0.0
    middle: str = "mean"
    overlap: float | None = None
    by_top: bool = True
    least_height: float = 1.0
    within: str | None = None


#: Lines of text pages, of cells to be searched for private data, and of receipts.
TEXT = LineRule(look_back=4, share=0.65, least=5.0)
PRIVATE = LineRule(look_back=4, share=0.7, least=5.0, middle="first")
RECEIPT = LineRule(look_back=3, share=0.75, middle="median", overlap=0.25, by_top=False, least_height=0.0)


#: Cells and bytes that a task takes at a time, pages below which it goes cell by cell, and cells of a line from which it does so where a rule keeps all of them.
AT_ONCE, AT_ONCE_BYTES, FEW, WIDE = 1 << 17, 1 << 26, 16, 64


class Page:
    """Numbers the lines of a page whose cells come in order.

    A line is a list: number, place, height, cells, and, if the rule needs them, all places and heights in order and the spans.
    Every cell of every page passes here, so what a rule doesn't ask for isn't kept.
    """

    def __init__(self, rule: LineRule):
        self.rule, self.next = rule, 0
        self.lines: deque[list] = deque(maxlen=rule.look_back)

    def line(self, y: float | None, height: float, x0: float | None = None, x1: float | None = None, within: float | None = None) -> int:
        number = self.next
        if y is None:
            self.next += 1
            return number
        rule = self.rule
        share, least, overlap = rule.share, rule.least, rule.overlap
        for line in reversed(self.lines):
            if within is None:
                low = line[2]
                near = (height if height < low else low) * share
                near = near if near > least else least
            else:
                near = within
            if abs(line[1] - y) > near or (overlap is not None and any(min(x1, b) - max(x0, a) > min(x1 - x0, b - a) * overlap for a, b in line[6])):
                continue
            n = line[3] = line[3] + 1
            if rule.middle == "mean":
                line[1] = (line[1] * (n - 1) + y) / n
                if height > line[2]:
                    line[2] = height
            elif rule.middle == "median":
                insort(line[4], y)
                insort(line[5], height)
                i = n // 2
                line[1], line[2] = ((h[i] if n % 2 else (h[i - 1] + h[i]) / 2) for h in line[4:6])
            if overlap is not None:
                line[6].append((x0, x1))
            return line[0]
        self.lines.append([number, y, height, 1, [y], [height], [(x0, x1)]])
        self.next += 1
        return number


def _values(column: pa.Array) -> list:
    """A column's values; numbers without nulls come by NumPy, which is faster."""
    plain = (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)) and not column.null_count
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold `AT_ONCE` rows or `AT_ONCE_BYTES` bytes; empty ones go."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= AT_ONCE or size >= AT_ONCE_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _changes(keys: pa.Array) -> np.ndarray:
    """Whether each key but the first differs from the one before; nulls are equal."""
    if pa.types.is_nested(keys.type):
        held = keys.to_pylist()
        return np.array([a != b for a, b in zip(held, held[1:], strict=False)], bool)
    null = keys.is_null().to_numpy(zero_copy_only=False)
    return pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).fill_null(False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])


def _side_by_side(rule: LineRule, starts: np.ndarray, ends: np.ndarray, columns: list[pa.Array], before: Page | None) -> tuple[np.ndarray, Page]:
    """(lines, state of the last page) of pages given by the places of their cells; `before` is the state that the first page goes on from.

    The i-th cells of all pages are placed together, the longest pages first.  A line is in a column, the latest on top, and
    each number comes by the same steps as in `Page`, which takes what is left of the longest pages, or once a line is wide, and rules by given distances.
    Rules by overlap or medians keep the open lines' cells: tops of a pile of places, heights and ends, without a number where a line has fewer.
    """
    order = np.argsort(starts - ends, kind="stable")
    at, left, pages = starts[order], (ends - starts)[order], len(starts)
    lines = np.empty(len(columns[0]), np.int32)
    place, high = np.zeros((rule.look_back, pages)), np.zeros((rule.look_back, pages))
    size, number = np.zeros((rule.look_back, pages), np.int64), np.zeros((rule.look_back, pages), np.int64)
    made, following = np.zeros(pages, np.int64), np.zeros(pages, np.int64)
    by_cells, crowded = rule.overlap is not None or rule.middle == "median", False
    room = min(WIDE, max(8, *(line[3] for line in before.lines)) if before is not None and before.lines else min(8, int(left[0]))) if by_cells else 0
    piles = [np.full((rule.look_back, pages, room), np.nan) for _ in range(4)]
    if before is not None:
        p = int(np.flatnonzero(order == 0)[0])
        made[p], following[p] = len(before.lines), before.next
        for i, line in enumerate(reversed(before.lines)):
            number[i, p], place[i, p], high[i, p], size[i, p] = line[:4]
            crowded |= by_cells and line[3] >= WIDE
            if by_cells and not crowded:
                for pile, values in zip(piles, (line[4], line[5], *zip(*line[6], strict=True)), strict=True):
                    pile[i, p, : len(values)] = values

    def page(p: int) -> Page:
        if order[p] == 0 and before is not None and step == 0:
            return before
        state = Page(rule)
        state.next = int(following[p])
        for i in reversed(range(min(int(made[p]), rule.look_back))):
            ys, hs, lows, highs = (pile[i, p, : int(size[i, p])].tolist() for pile in piles)
            state.lines.append([int(number[i, p]), float(place[i, p]), float(high[i, p]), int(size[i, p]), sorted(ys), sorted(hs), list(zip(lows, highs, strict=True))])
        return state

    step, alone = 0, bool(rule.within)
    if not alone:
        middle, height = (c.to_numpy(zero_copy_only=False) for c in columns[:2])
        ends_of = [c.to_numpy(zero_copy_only=False) for c in columns[2:4]] if rule.overlap is not None else []
        unplaced = columns[0].is_null().to_numpy(zero_copy_only=False) if columns[0].null_count else None
        age = np.arange(rule.look_back)[:, None]
    while (active := int(np.searchsorted(-left, -step))) >= FEW and not alone and not crowded:
        here = at[:active] + step
        y, h, low = middle[here], height[here], high[:, :active]
        near = np.where(h < low, h, low) * rule.share
        near = np.where(near > rule.least, near, rule.least)
        fits = ~(np.abs(place[:, :active] - y) > near) & (age < made[:active])
        cell = [y, h, *(c[here] for c in ends_of)]
        if rule.overlap is not None:
            most = int(size[:, :active].max())
            (x0, x1), (a, b) = (c[:, None] for c in cell[2:]), (pile[:, :active, :most] for pile in piles[2:])
            fits &= ~(np.minimum(x1, b) - np.maximum(x0, a) > np.minimum(x1 - x0, b - a) * rule.overlap).any(axis=2)
        new = None
        if unplaced is not None:
            fits &= ~unplaced[here]
            new = ~unplaced[here]
        found = fits.any(axis=0)
        p = np.flatnonzero(found)
        i = fits.argmax(axis=0)[p]
        told = following[:active].copy()
        told[p] = number[i, p]
        lines[here] = told
        following[:active] += ~found
        if rule.middle == "mean":
            n = size[i, p] + 1
            place[i, p] = (place[i, p] * (n - 1) + y[p]) / n
            high[i, p] = np.where(h[p] > high[i, p], h[p], high[i, p])
            size[i, p] = n
        if by_cells and len(p):
            n = size[i, p] = (size[i, p] + 1 if rule.middle != "mean" else size[i, p])
            most = int(n.max())
            if most > piles[0].shape[2]:
                piles = [np.concatenate([pile, np.full(pile.shape, np.nan)], axis=2) for pile in piles]
            for pile, values in zip(piles, cell, strict=False):
                pile[i, p, n - 1] = values[p]
            if rule.middle == "median":
                for held, pile in ((place, piles[0]), (high, piles[1])):
                    own, each = np.sort(pile[i, p, :most], axis=1), np.arange(len(p))
                    held[i, p] = (own[each, (n - 1) // 2] + own[each, n // 2]) / 2
            crowded = most >= WIDE
        p = np.flatnonzero(~found if new is None else ~found & new)
        for pile, values in zip(piles if by_cells else [], cell, strict=False):
            pile[1:, p] = pile[:-1, p]
            pile[0, p] = np.nan
            pile[0, p, 0] = values[p]
        for held, value in ((number, told), (place, y), (high, h), (size, np.ones(active))):
            held[1:, p] = held[:-1, p]
            held[0, p] = value[p]
        made[p] += 1
        step += 1
    values = [_values(c) for c in columns] if alone else None
    last, final = None, int(np.flatnonzero(order == pages - 1)[0])
    for p in range(active):
        a, z, state = int(at[p]) + step, int(at[p] + left[p]), page(p)
        lines[a:z] = [state.line(*cell) for cell in zip(*([v[a:z] for v in values] if values else [_values(c.slice(a, z - a)) for c in columns]), strict=True)]
        if p == final:
            last = state
    return lines, last or page(final)


def _numbered(batches: Iterator[pa.RecordBatch], rule: LineRule, key: int, places: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Page, bool]]:
    """(batch, starts of its pages, lines of its cells, state of its last page, whether its first page goes on from the batch before)."""
    before, last = None, None
    for batch in _together(batches):
        keys = batch.column(key)
        starts = np.flatnonzero(np.concatenate([[True], _changes(keys)]))
        first = keys[0].as_py()
        goes_on = last is not None and not (first != before)
        lines, last = _side_by_side(rule, starts, np.append(starts[1:], batch.num_rows), [batch.column(i) for i in places], last if goes_on else None)
        before = keys[len(keys) - 1].as_py()
        yield batch, starts, lines, last, goes_on


def _in_order(cells: DataFrame, page: str, cell: str, rule: LineRule, slope: Column | None, origin: Column | None, names: list[str]) -> tuple[DataFrame, list[int]]:
    """(the columns `names` of cells and what places them, page by page in order; the places of the latter columns, the page's first)."""
    middle = (F.col("y0") + F.col("y1")) / 2
    if slope is not None:
        middle = middle - slope * ((F.col("x0") + F.col("x1")) / 2 - origin)
    placed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    height = F.greatest(F.lit(rule.least_height), F.col("y1") - F.col("y0"))
    held = cells.withColumns({"_y": F.when(placed, middle.cast("double")), "_h": height.cast("double"), "_top": F.when(placed, F.col("y0") if rule.by_top else middle)})
    spans = ["x0", "x1"] if rule.overlap is not None or rule.within else []
    used = [page, "_y", "_h", *spans, *([rule.within] if rule.within else [])]
    held = held.select(*dict.fromkeys([*names, *used, "_top", "x0", cell]))
    sorted_cells = held.repartition(F.col(page)).sortWithinPartitions(F.col(page).asc_nulls_first(), F.col("_top").asc_nulls_last(), F.col("x0").asc_nulls_last(), cell)
    sorted_cells = sorted_cells.select(*dict.fromkeys([*names, *used]))
    return sorted_cells, [sorted_cells.columns.index(c) for c in used]


def visual_lines(cells: DataFrame, page: str, cell: str, rule: LineRule = TEXT, slope: Column | None = None, origin: Column | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Cells with `line`, from 0 down each page.

    Cells have a box x0, y0, x1, y1; those without one (a null side) come last, each on a line of its
    own.  Cells at one place are taken in the order of `cell`, and their rows stay as they are,
    repeated ones too; a null page is a page.  With `slope` and `origin` a page's tilt is taken off first.
    Only the columns `keep` come back, if it is given: others needn't go through the shuffle and Python.
    """
    names = list(keep or cells.columns)
    sorted_cells, (key, *places) = _in_order(cells, page, cell, rule, slope, origin, names)
    kept = [sorted_cells.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, lines, *_ in _numbered(batches, rule, key, places):
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(lines)], names=[*names, "line"])

    kinds = ", ".join(f"`{c}` {sorted_cells.schema[c].dataType.simpleString()}" for c in names)
    return sorted_cells.mapInArrow(run, f"{kinds}, line int")


def line_sizes(cells: DataFrame, page: str, cell: str, rule: LineRule = TEXT) -> DataFrame:
    """(page, line, cells, first_cell): how many cells each line of `visual_lines` has, and the least, null if all are; `cell` is an integer.

    A line is told when no other cell can join it, so lines needn't be dealt out and grouped again; a task keeps those of its last page that are open.
    """
    sorted_cells, (key, *places) = _in_order(cells, page, cell, rule, None, None, [page, cell])
    kind, own = sorted_cells.schema[page].dataType.simpleString(), sorted_cells.columns.index(cell)
    names, most = ["page", "line", "cells", "first_cell"], np.iinfo(np.int64).max

    def told(keys: pa.Array, lines: np.ndarray, sizes: np.ndarray, least: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array(lines, pa.int32()), pa.array(sizes, pa.int64()), pa.array(least, pa.int64(), mask=~known)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch, starts, lines, last, goes_on in _numbered(batches, rule, key, places):
            ids = batch.column(own)
            known = ~ids.is_null().to_numpy(zero_copy_only=False)
            each = [batch.column(key), lines, np.ones(len(lines), np.int64), ids.cast(pa.int64()).fill_null(most).to_numpy(zero_copy_only=False), known]
            number = np.repeat(np.arange(1, len(starts) + 1), np.diff(np.append(starts, len(lines))))
            if held:
                number = np.concatenate([np.full(len(held[1]), 1 if goes_on else 0), number])
                each = [pa.concat_arrays([held[0], each[0]]), *[np.concatenate(pair) for pair in zip(held[1:], each[1:], strict=True)]]
            order = np.lexsort((each[1], number))
            number, line = number[order], each[1][order]
            heads = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (line[1:] != line[:-1])]))
            found = [each[0].take(pa.array(order[heads])), line[heads], *[step.reduceat(values[order], heads) for step, values in zip((np.add, np.minimum, np.logical_or), each[2:], strict=True)]]
            still = (number[heads] == len(starts)) & np.isin(found[1], [open_line[0] for open_line in last.lines])
            held, done = ([found[0].filter(pa.array(which)), *[values[which] for values in found[1:]]] for which in (still, ~still))
            yield told(*done)
        if held:
            yield told(*held)

    return sorted_cells.mapInArrow(run, f"page {kind}, line int, cells long, first_cell long").withColumnRenamed("page", page)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def receipt_lines(cells: pa.Array) -> pa.Array:
    """The lines, by `RECEIPT`, of pages that are held whole: for each line from 0 down the places, from 0, of its cells in the page's array.

    Cells are structs of numbers: level, h, x0, x1 and cell.  Those at one level go by x0, then by cell.
    """
    sizes = pc.list_value_length(cells).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, page = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    level, h, x0, x1, cell = cells.flatten().flatten()
    order = np.lexsort([c.to_numpy(zero_copy_only=False) for c in (cell, x0, level)] + [page])
    some = np.flatnonzero(sizes)
    lines = _side_by_side(RECEIPT, starts[some], (starts + sizes)[some], [c.take(pa.array(order)) for c in (level, h, x0, x1)], None)[0] if len(some) else np.empty(0, np.int32)
    by_line = np.lexsort((lines, page))
    line, own = lines[by_line], page[by_line]
    heads = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (own[1:] != own[:-1])])) if len(own) else np.empty(0, np.int64)
    places = pa.array((order[by_line] - starts[own]).astype(np.int32))
    each = pa.ListArray.from_arrays(pa.array(np.append(heads, len(own)).astype(np.int32)), places)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(own[heads], minlength=len(sizes)))]).astype(np.int32)), each)


def line_texts(lined: DataFrame, page: str, cell: str, text: str = "text", between: str = " | ") -> DataFrame:
    """(page, line, text) of cells with lines: their trimmed texts from left to right, blank ones apart; lines without any go.

    A line's cells are collected, not a page's.
    """
    said = lined.withColumn("_t", F.trim(F.col(text))).where(F.col("_t") != "")
    each = F.struct(F.coalesce(F.col("x0").cast("double"), F.lit(1e9)).alias("x"), F.col(cell).alias("c"), F.col("_t").alias("t"))
    return said.groupBy(page, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda s: s["t"]), between).alias("text"))
