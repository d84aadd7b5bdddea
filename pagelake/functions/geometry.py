"""SQL text for corner arithmetic; a quad is array<struct<x,y>> in order TL, TR, BR, BL."""


def point(x: str, y: str) -> str:
    return f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"


def rectangle(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"array({point(x0, y0)}, {point(x1, y0)}, {point(x1, y1)}, {point(x0, y1)})"


def ordered(q: str) -> str:
    """Corner order by x+y and x-y: first of equals for minima, last for maxima."""

    def ranked(key: str) -> str:
        return f"array_sort(transform({q}, (p, i) -> named_struct('k', {key}, 'i', i, 'p', p)))"

    by_sum, by_diff = ranked("p.x + p.y"), ranked("p.x - p.y")
    return f"array({by_sum}[0].p, {by_diff}[3].p, {by_sum}[3].p, {by_diff}[0].p)"


def distance(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def shoelace(q: str) -> str:
    """Area of a closed polygon given as an array of points."""
    return (
        f"abs(aggregate(sequence(0, size({q}) - 1), CAST(0 AS DOUBLE), (s, i) -> s +"
        f" {q}[i].x * {q}[(i + 1) % size({q})].y - {q}[(i + 1) % size({q})].x * {q}[i].y)) / 2"
    )
