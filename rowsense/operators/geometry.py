"""Positioned cells of a page: columns by overlap, rows by nearness, claims against what stands on the page.

A page's cells are one group: pages are bounded by what fits on paper. A row holds a page, and pages of an Arrow batch are
worked on side by side: each step takes the next cell of every page. Results keep all cells; a cell without a row has a
null anchor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the narrower width that must overlap; shares of a cell's height within which a cell belongs to a row and a column
#: lines up with the first.
OVERLAP, NEAR, ALIGNED = 0.5, 0.4, 0.25


#: Numbers that the steps over pages hold at a time.
HELD = 1 << 18


class Pages:
    """Pages side by side: their cells in the order of page and x, with their fields as arrays."""

    def __init__(self, ids: pa.Array, lists: pa.Array) -> None:
        self.ids, self.size = ids, np.diff(lists.offsets.to_numpy())
        self.start = np.cumsum(self.size) - self.size
        flat = lists.flatten()
        page = np.repeat(np.arange(len(ids)), self.size)
        fields = {n: flat.field(n) for n in ("cell_id", "x", "y", "width", "height")}
        if any(f.null_count for f in fields.values()):
            raise ValueError("a cell without a place or an id")
        at = {n: f.to_numpy() for n, f in fields.items()}
        order = np.lexsort((at["cell_id"], at["x"], page))
        self.page = page[order]
        self.cell_id, self.x, self.y, self.width, self.height = (at[n][order] for n in fields)
        self.texts = flat.field("text").take(pa.array(order)) if "text" in flat.type.names else None
        self.column = self._columns()

    def __len__(self) -> int:
        return len(self.size)

    def steps(self, order: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The first cell of every page, then the second, and so on: pages and their cells."""
        for i in range(int(self.size.max(initial=0))):
            pages = np.flatnonzero(self.size > i)
            at = self.start[pages] + i
            yield pages, at if order is None else order[at]

    def _columns(self) -> np.ndarray:
        """The column of each cell, numbered by the median middle of its cells."""
        low, high = (np.full((len(self), 4), np.nan) for _ in range(2))
        used, of = np.zeros(len(self), np.int64), np.zeros(len(self.page), np.int64)
        for pages, at in self.steps():
            x, w = self.x[at], self.width[at]
            a, b = low[pages], high[pages]
            with np.errstate(invalid="ignore"):
                over = np.minimum(b, (x + w)[:, None]) - np.maximum(a, x[:, None]) > OVERLAP * np.minimum(w[:, None], b - a)
            held = over.any(axis=1)
            k = np.where(held, over.argmax(axis=1), used[pages])
            if k.max() >= low.shape[1]:
                low, high = (np.hstack([z, np.full_like(z, np.nan)]) for z in (low, high))
            low[pages, k] = np.where(held, np.minimum(low[pages, k], x), x)
            high[pages, k] = np.where(held, np.maximum(high[pages, k], x + w), x + w)
            used[pages] += ~held
            of[at] = k
        groups, of_group = np.unique(self.page * low.shape[1] + of, return_inverse=True)
        middle = _medians(of_group, self.x + self.width / 2)
        order = np.lexsort((groups, middle, groups // low.shape[1]))
        place = np.empty(len(groups), np.int64)
        place[order] = np.arange(len(groups)) - np.searchsorted(groups // low.shape[1], groups[order] // low.shape[1])
        return place[of_group]


def _medians(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The median of each group, groups numbered from 0 without gaps."""
    order = np.lexsort((values, group))
    n = np.bincount(group)
    start = np.cumsum(n) - n
    return (values[order[start + (n - 1) // 2]] + values[order[start + n // 2]]) / 2


def _met(away: np.ndarray, near: float) -> tuple[int, float]:
    """How many cells meet rows one to one, nearest first, and their median distance."""
    cells, taken, far = set(), set(), []
    flat = away.ravel()
    close = np.flatnonzero(flat <= near)
    for at in close[np.argsort(flat[close], kind="stable")].tolist():
        cell, row = divmod(at, away.shape[1])
        if cell not in cells and row not in taken:
            cells.add(cell)
            taken.add(row)
            far.append(float(flat[at]))
    return len(far), median(far) if far else float("inf")


def _matches(own: np.ndarray, rows: np.ndarray, shifts: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_met() of columns (a line each) at each of their shifts: at most of them no cell has two rows near it, nor a row two cells."""
    away = np.abs((own[:, None, :] - shifts[:, :, None])[..., None] - rows[:, None, None, :])
    close = away <= near[:, None, None, None]
    matched = close.sum(axis=(2, 3))
    flat = np.sort(np.where(close, away, np.inf).reshape(*matched.shape, -1), axis=2)
    n = np.maximum(matched, 1)[..., None]
    spread = (np.take_along_axis(flat, (n - 1) // 2, 2) + np.take_along_axis(flat, n // 2, 2))[..., 0] / 2
    spread[matched == 0] = np.inf
    for q, i in np.argwhere((close.sum(axis=3) > 1).any(axis=2) | (close.sum(axis=2) > 1).any(axis=2)).tolist():
        matched[q, i], spread[q, i] = _met(away[q, i], near[q])
    return matched, spread


def _offsets(own: np.ndarray, rows: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shift at which most of a column's cells meet rows one to one, and whether all that can do so; of equal shifts that
    with the least median distance, then the smallest. A line is a column of own cells with the rows of its page."""
    n, m = own.shape[1], rows.shape[1]
    shifts = np.concatenate([np.zeros((len(own), 1)), (own[:, :, None] - rows[:, None, :]).reshape(len(own), -1)], axis=1)
    matched, spread = np.zeros(shifts.shape, np.int64), np.zeros(shifts.shape)
    lines = max(1, HELD // (n * m * shifts.shape[1]))
    wide = max(1, HELD // (n * m)) if lines == 1 else shifts.shape[1]
    for q in range(0, len(own), lines):
        for i in range(0, shifts.shape[1], wide):
            part = slice(q, q + lines), slice(i, i + wide)
            matched[part], spread[part] = _matches(own[part[0]], rows[part[0]], shifts[part], near[part[0]])
    may = matched == matched.max(axis=1)[:, None]
    for by in (spread, np.abs(shifts)):
        least = np.where(may, by, np.inf).min(axis=1)
        may &= by == least[:, None]
    best = may.argmax(axis=1)
    every = np.arange(len(own))
    return shifts[every, best], (matched[every, best] >= min(n, m)) & (spread[every, best] <= near)


def _anchors(p: Pages) -> tuple[np.ndarray, np.ndarray]:
    """The cell that is each cell's anchor (-1: none), and the pages without heights or with a column that doesn't line up with
    the first."""
    middle = p.y + p.height / 2
    height = _medians(p.page, p.height)
    refused = height <= 0
    anchor = np.full(len(p.page), -1)
    order = np.lexsort((np.arange(len(p.page)), p.column, p.page))
    of = p.page[order] * (int(p.column.max(initial=0)) + 1) + p.column[order]
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size = np.diff(np.r_[start, len(of)])
    page, first = p.page[order[start]], p.column[order[start]] == 0
    head = np.flatnonzero(first)[page]
    anchor[p.column == 0] = np.flatnonzero(p.column == 0)
    shapes, of_shape = np.unique(np.stack([size, size[head]], axis=1), axis=0, return_inverse=True)
    for shape, (n, m) in enumerate(shapes.tolist()):
        here = np.flatnonzero((of_shape.ravel() == shape) & ~first & ~refused[page])
        if not len(here):
            continue
        own = order[start[here][:, None] + np.arange(n)]
        rows = order[start[head[here]][:, None] + np.arange(m)]
        tall = height[page[here]]
        shift, fits = _offsets(middle[own], middle[rows], ALIGNED * tall)
        refused[page[here[~fits]]] = True
        down = np.take_along_axis(rows, np.argsort(middle[rows], axis=1, kind="stable"), 1)
        nearest = np.full((len(here), m), np.inf)
        taker = np.full((len(here), m), -1)
        every = np.arange(len(here))
        for i in range(n):
            away = np.abs(middle[down] - (middle[own[:, i]] - shift)[:, None])
            row = away.argmin(axis=1)
            far = away[every, row]
            better = (far <= NEAR * tall) & (far < nearest[every, row])
            nearest[every[better], row[better]] = far[better]
            taker[every[better], row[better]] = own[better, i]
        q, row = np.nonzero(taker >= 0)
        anchor[taker[q, row]] = down[q, row]
    anchor[refused[p.page]] = -1
    return anchor, refused


def _by_page(cells: DataFrame, make: Callable[[Pages], list], schema: pa.Schema, ddl: str, text: bool = False) -> DataFrame:
    """make() of pages side by side: those of like sizes together, so that what a step holds is bounded by HELD or one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("page_id"), batch.column("cells")
            sizes = np.diff(lists.offsets.to_numpy())
            order = np.argsort(sizes, kind="stable")
            at = 0
            while at < len(order):
                most = np.maximum.accumulate(sizes[order[at:]]) * np.arange(1, len(order) - at + 1)
                upto = at + max(1, int(np.searchsorted(most, HELD, "right")))
                some = pa.array(order[at:upto])
                yield pa.RecordBatch.from_arrays(make(Pages(ids.take(some), lists.take(some))), schema=schema)
                at = upto

    fields = ["cell_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")), *(["text"] if text else [])]
    return cells.groupBy("page_id").agg(F.collect_list(F.struct(*fields)).alias("cells")).mapInArrow(run, ddl)


def cluster_columns(cells: DataFrame) -> DataFrame:
    """page_id, cell_id, column of cells (page_id, cell_id, x, y, width, height, text)."""
    schema = pa.schema([(x, pa.int64()) for x in ("page_id", "cell_id", "column")])
    return _by_page(cells, lambda p: [p.ids.take(pa.array(p.page)).cast("int64"), pa.array(p.cell_id, pa.int64()), pa.array(p.column)], schema, "page_id long, cell_id long, column long")


def bind_cells(cells: DataFrame) -> DataFrame:
    """page_id, cell_id, column, anchor, refused: the cell of the first column in whose row a cell stands. Each column is first
    shifted by the offset at which most of its cells meet a row; a row takes one cell of a column, the nearest. A page with a
    column that fits no shift is refused: none of its cells has an anchor, as values could meet wrong names."""
    schema = pa.schema([*((x, pa.int64()) for x in ("page_id", "cell_id", "column", "anchor")), ("refused", pa.bool_())])

    def make(p: Pages) -> list:
        anchor, refused = _anchors(p)
        return [p.ids.take(pa.array(p.page)).cast("int64"), pa.array(p.cell_id, pa.int64()), pa.array(p.column), pa.array(p.cell_id[anchor], pa.int64(), mask=anchor < 0), pa.array(refused[p.page])]

    return _by_page(cells, make, schema, "page_id long, cell_id long, column long, anchor long, refused boolean")


#: A table has at least so many rows, such a share of its cells in rows, and of a column's cells that are results.
ROWS, IN_ROWS, RESULTS, SHORT = 3, 0.7, 0.6, 6
FIELDS = ("name", "value", "unit", "printed_range")


def is_result(text: str) -> bool:
    """A short text with a digit."""
    return len(text.strip()) <= 24 and any(c in "0123456789" for c in text)


def _result_column(texts: list[str]) -> bool:
    if sum(map(is_result, texts)) >= RESULTS * len(texts):
        return True
    short = [t.strip() for t in texts if 0 < len(t.strip()) <= SHORT]
    return len(short) >= RESULTS * len(texts) and len(set(short)) <= 0.5 * len(short)


def _structures(p: Pages) -> list[np.ndarray | list]:
    """The columns, aligned rows, whether a column holds results, and the reason of each page."""
    columns = np.zeros(len(p), np.int64)
    np.maximum.at(columns, p.page, p.column + 1)
    half = 0.5 * np.bincount(p.page, p.height, len(p)) / p.size
    middle, wide = p.y + p.height / 2, 4
    lines = np.full((len(p), wide), np.nan)
    last, many = np.full((len(p), wide), -1), np.zeros((len(p), wide), np.int64)
    used = np.zeros(len(p), np.int64)
    for pages, at in p.steps(np.lexsort((np.arange(len(p.page)), p.column, p.page))):
        near = np.abs(lines[pages] - middle[at][:, None]) <= half[pages][:, None]
        held = near.any(axis=1)
        k = np.where(held, near.argmax(axis=1), used[pages])
        if k.max() >= lines.shape[1]:
            lines, last, many = (np.hstack([z, np.full_like(z, empty)]) for z, empty in ((lines, np.nan), (last, -1), (many, 0)))
        lines[pages, k] = np.where(held, lines[pages, k], middle[at])
        used[pages] += ~held
        # A page's cells come by column.
        many[pages, k] += last[pages, k] != p.column[at]
        last[pages, k] = p.column[at]
    aligned, in_rows = (many > 1).sum(axis=1), np.where(many > 1, many, 0).sum(axis=1)
    texts = [t or "" for t in p.texts.to_pylist()]
    most = int(columns.max(initial=1))
    of = p.page * most + p.column
    n = np.bincount(of, minlength=len(p) * most)
    share = np.bincount(of, [is_result(t) for t in texts], len(n)) >= RESULTS * n
    results = (share & (n > 0)).reshape(len(p), most)[:, 1:].any(axis=1)
    rest: dict[int, list[str]] = {}
    for i in np.flatnonzero((p.column > 0) & ~results[p.page]).tolist():
        rest.setdefault(int(of[i]), []).append(texts[i])
    for g, held in rest.items():
        results[g // most] |= _result_column(held)
    why = [
        "one column" if c < 2 else "few rows" if a < ROWS else "scattered" if i < IN_ROWS * s else "" if r else "no results"
        for c, a, i, s, r in zip(columns.tolist(), aligned.tolist(), in_rows.tolist(), p.size.tolist(), results.tolist(), strict=True)
    ]
    one = columns < 2
    return [columns, np.where(one, 0, aligned), results & ~one, why]


def table_structure(cells: DataFrame) -> DataFrame:
    """page_id, columns, aligned_rows, has_results, reason (empty if the page is a table) of each page that has cells."""
    schema = pa.schema([("page_id", pa.int64()), ("columns", pa.int64()), ("aligned_rows", pa.int64()), ("has_results", pa.bool_()), ("reason", pa.string())])
    return _by_page(cells, lambda p: [p.ids.cast("int64"), *(pa.array(x, f.type) for x, f in zip(_structures(p), list(schema)[1:], strict=True))], schema, "page_id long, columns long, aligned_rows long, has_results boolean, reason string", text=True)


def _norm(text: str | None) -> str:
    return "".join(text.lower().split()) if text else ""


def _middle_of(values: list[float]) -> float:
    held, n = sorted(values), len(values)
    return held[n // 2] if n % 2 else (held[n // 2 - 1] + held[n // 2]) / 2


def _claimed(rows: list[tuple], cells: list[tuple[str, float]], heights: list[float]) -> Iterator[tuple[int, str, str]]:
    """ord, field and problem of rows (ord, and a text per field) and cells (text, middle). Each printed text serves as many
    claims as it is printed, the nearest to its row's name first."""
    free: dict[str, list[float]] = {}
    for text, middle in cells:
        key = _norm(text)
        if key:
            free.setdefault(key, []).append(middle)
    found: list[tuple] = []
    for r in rows:
        mine: list[float | None] = [None] * len(FIELDS)
        for i, text in enumerate(r[1:]):
            key = _norm(text)
            if not key:
                continue
            held = free.get(key)
            if not held:
                yield r[0], FIELDS[i], "reused-cell" if key in free else "not-on-page"
                continue
            name = mine[0]
            mine[i] = held.pop(0 if name is None or len(held) == 1 else min(range(len(held)), key=lambda j: abs(held[j] - name)))
        found.append((r[0], mine))
    half = 0.5 * _middle_of(heights)
    for i in range(1, len(FIELDS)):
        both = [(ord_, mine[i] - mine[0]) for ord_, mine in found if mine[i] is not None and mine[0] is not None]
        if both:
            usual = _middle_of([away for _, away in both])
            for ord_, away in both:
                if abs(away - usual) > half:
                    yield ord_, FIELDS[i], "incoherent-band"


def verify_rows(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """page_id, ord, field, problem of claims (page_id, ord, name, value, unit, printed_range) that a page's cells don't bear
    out; a claim on a page without cells is 'unverifiable' (no field)."""
    schema = pa.schema([("page_id", pa.int64()), ("ord", pa.int64()), ("field", pa.string()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            claimed, printed = batch.column("claims"), batch.column("cells")
            rows = list(zip(*(c.to_pylist() for c in claimed.flatten().flatten()), strict=True))
            held = printed.flatten()
            place = [held.field(n).to_numpy(zero_copy_only=False) for n in ("y", "x", "cell_id", "height")]
            n = np.diff(printed.offsets.to_numpy())
            order = np.lexsort((place[2], place[1], place[0], np.repeat(np.arange(len(n)), n)))
            texts, middle, height = held.field("text").take(pa.array(order)).to_pylist(), (place[0] + place[3] / 2)[order].tolist(), place[3][order].tolist()
            ends, row_ends = np.cumsum(n).tolist(), np.cumsum(np.diff(claimed.offsets.to_numpy())).tolist()
            a = b = 0
            for page, c, d in zip(batch.column("page_id").to_pylist(), row_ends, ends, strict=True):
                mine = sorted(rows[a:c], key=lambda r: r[0])
                if d == b:
                    out += [(page, r[0], None, "unverifiable") for r in mine]
                else:
                    out += [(page, *x) for x in _claimed(mine, list(zip(texts[b:d], middle[b:d], strict=True)), height[b:d])]
                a, b = c, d
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    # One grouping of both, so that pages meet their claims without a join; null stands for what the other side brings.
    claim = F.struct(F.col("ord").cast("long").alias("ord"), *(F.col(f).cast("string").alias(f) for f in FIELDS))
    cell = F.struct(*(F.col(c).cast("double").alias(c) for c in ("y", "x", "height")), F.col("cell_id").cast("long").alias("cell_id"), F.col("text").cast("string").alias("text"))
    both = claims.select("page_id", claim.alias("claim")).unionByName(cells.select("page_id", cell.alias("cell")), allowMissingColumns=True)
    pages = both.groupBy("page_id").agg(F.collect_list("claim").alias("claims"), F.collect_list("cell").alias("cells")).filter(F.size("claims") > 0)
    return pages.mapInArrow(run, "page_id long, ord long, field string, problem string")
