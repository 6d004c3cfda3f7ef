"""Tables written as marked cells: a table function that gives typed cells with their spans, or a reason."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks. Fixed values of the format: a cell, an empty one, one merged with its left neighbour, with the one above, with both.
CELL, EMPTY, LEFT, UP, BOTH = "fcel", "ecel", "lcel", "ucel", "xcel"
_MARK = re.compile(f"<({'|'.join((CELL, EMPTY, LEFT, UP, BOTH))})>")
_MARK_OR_END = re.compile(f"<({'|'.join((CELL, EMPTY, LEFT, UP, BOTH))}|nl)>")
CELLS = "row: int, col: int, text: string, row_span: int, col_span: int, problem: string"
NAMES = tuple(c.split(":")[0] for c in CELLS.split(", "))


class Malformed(ValueError):
    pass


def grid(text: str) -> list[list[tuple[str, str]]]:
    """(mark, text) of every cell of every row; what stands before the first mark is a caption, not a cell."""
    first = _MARK.search(text)
    if first is None:
        raise Malformed("no cell")
    rows, cells = [], []
    parts = _MARK_OR_END.split(text[first.start() :])
    for mark, held in zip(parts[1::2], parts[2::2], strict=True):
        if mark != "nl":
            cells.append((mark, " ".join(held.split()) if held else held))
            continue
        if cells:
            rows.append(cells)
            cells = []
        if held and held.strip():
            raise Malformed(f"text before the first cell of row {len(rows)}")
    if cells:
        rows.append(cells)
    return rows


def spans(rows: list[list[tuple[str, str]]]) -> Iterator[tuple[int, int, str, int, int]]:
    """(row, col, text, row_span, col_span) of the cells that aren't merged into another.

    Each place carries the corner of the cell that covers it: a merge to the left takes the left place's corner, a merge
    upward the upper one's, and a merge of both must find one corner on either side. A corner's spans are its farthest places.
    """
    width = len(rows[0])
    corner: list[list[tuple[int, int]]] = []
    ends: dict[tuple[int, int], tuple[int, int]] = {}  # of cells that others are merged with
    for r, cells in enumerate(rows):
        if len(cells) != width:
            raise Malformed(f"row {r} has {len(cells)} cells, not {width}")
        own: list[tuple[int, int]] = []
        corner.append(own)
        for c, (mark, held) in enumerate(cells):
            if mark in (CELL, EMPTY):
                own.append((r, c))
                continue
            if mark != UP and c == 0 or mark != LEFT and r == 0:
                raise Malformed(f"nothing to merge with at row {r}, column {c}")
            if held:
                raise Malformed(f"text in a merged cell at row {r}, column {c}")
            if mark == LEFT:
                at = own[c - 1]
                if at[0] != r:
                    raise Malformed(f"merged to the left of a cell from above at row {r}, column {c}")
            elif mark == UP:
                at = corner[r - 1][c]
                if at[1] != c:
                    raise Malformed(f"merged below the right part of a cell at row {r}, column {c}")
            else:
                at = corner[r - 1][c]
                if at != own[c - 1]:
                    raise Malformed(f"merged with two cells at row {r}, column {c}")
            own.append(at)
            far = ends.get(at, at)
            ends[at] = (max(far[0], r), max(far[1], c))
    for r, cells in enumerate(rows):
        for c, at in enumerate(corner[r]):
            if at != (r, c):
                continue
            last, right = ends.get(at, at)
            if at in ends and any(corner[i][j] != at for i in range(r, last + 1) for j in range(c, right + 1)):
                raise Malformed(f"the cell at row {r}, column {c} is no rectangle")
            yield r, c, cells[c][1], last - r + 1, right - c + 1


def _found(text: str) -> list[tuple]:
    try:
        return [(*cell, None) for cell in spans(grid(text))]
    except Malformed as reason:
        return [(None, None, None, None, None, str(reason))]


#: Texts that are read before their cells go on.
TEXTS = 500


def read_cells(rows: DataFrame, text: str) -> DataFrame:
    """The columns of rows but `text`, and a row a cell as otsl_cells gives it: cells go on by column and not one by one."""
    others = [c for c in rows.columns if c != text]
    kinds = pa.schema([(n, pa.string() if n in ("text", "problem") else pa.int32()) for n in NAMES])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(begin, TEXTS)
                found = [[] if t is None else _found(t) for t in batch.column(len(others)).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(cells) for cells in found]))
                columns = list(zip(*chain.from_iterable(found), strict=True)) or [()] * len(NAMES)
                cells = [pa.array(c, kind.type) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(others))), *cells], names=[*others, *NAMES])

    kept = rows.select(*others, text)
    schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others), CELLS])
    return kept.mapInArrow(run, schema)


@F.udtf(returnType=CELLS)
class otsl_cells:  # noqa: N801, a function in SQL
    """otsl_cells(text): a row a cell, with its spans; an unreadable text is one row with a problem, a null text none."""

    def eval(self, text: str):
        if text is None:
            return
        yield from _found(text)
