"""Places on a page as cells of nested grids, as SQL text.

A box is kept in the grid whose cells are at least as large as the box, so that it lies in
four cells at most, whatever its size; a point is looked up once in every grid. What shares a cell with a
point is as large as the cell or a quarter of it and within its reach, so the number of candidates does not
grow with the number of objects on a page.
"""

#: Edge of the finest cell in points; each grid is STEP times coarser than the one before. Only boxes
#: beyond the last one (262144 points) lie in more cells.
EDGE, STEP, GRIDS = 64, 4, 7


def grid_of(extent: str) -> str:
    """The finest grid whose cells hold this extent."""
    cases = " ".join(f"WHEN {extent} <= {EDGE * STEP ** g} THEN {g}" for g in range(GRIDS - 1))
    return f"CASE {cases} ELSE {GRIDS - 1} END"


def _edge(grid: str) -> str:
    return f"element_at(array({', '.join(f'{EDGE * STEP ** g}D' for g in range(GRIDS))}), {grid} + 1)"


def _covered(grid: str, x0: str, y0: str, x1: str, y1: str) -> str:
    span = lambda a, b: f"sequence(CAST(floor(({a}) / {_edge(grid)}) AS BIGINT), CAST(floor(({b}) / {_edge(grid)}) AS BIGINT))"
    return f"flatten(transform({span(x0, x1)}, cx -> transform({span(y0, y1)}, cy -> struct({grid} AS g, cx AS cx, cy AS cy))))"


def box_cells(x0: str, y0: str, x1: str, y1: str) -> str:
    """Cells of a box in its own grid; none where it has no extent to speak of (x1 < x0 or y1 < y0)."""
    grid = grid_of(f"greatest(({x1}) - ({x0}), ({y1}) - ({y0}))")
    return f"CASE WHEN {x1} >= {x0} AND {y1} >= {y0} THEN {_covered(grid, x0, y0, x1, y1)} END"


def point_cells(x: str, y: str) -> str:
    """A point's cell in every grid."""
    cell = lambda v: f"CAST(floor(({v}) / {_edge('g')}) AS BIGINT)"
    return f"transform(sequence(0, {GRIDS - 1}), g -> struct(g AS g, {cell(x)} AS cx, {cell(y)} AS cy))"


def fine_cells(x0: str, y0: str, x1: str, y1: str) -> str:
    """Cells of a box in the finest grid, to meet other boxes there."""
    return f"CASE WHEN {x1} >= {x0} AND {y1} >= {y0} THEN {_covered('0', x0, y0, x1, y1)} END"
