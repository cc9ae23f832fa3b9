"""Exact predicates on points and edges, as SQL expressions.

Doubles are taken at their exact value.  A product of two doubles is the sum of two doubles, and a
sum of doubles can be kept as an expansion of doubles that do not overlap, so the sign of
a determinant is known exactly; coordinates whose products underflow are out of scope.  The functions
take and return SQL text, which also holds inside lambdas and is planned faster than many small columns.
"""

from __future__ import annotations

#: Relative error of the plain determinant, at most: (3 + 16 u) u with u = 2 ** -53.
PLAIN = "3.3306690738754716e-16D"
#: 2 ** 27 + 1 cuts a double into two halves.
CUT = "134217729e0D"
NONE = "cast(array() as array<double>)"


def sum_sign(terms: str) -> str:
    """Sign (-1, 0 or 1) of the exact sum of an array of doubles.

    Terms are added one by one to an expansion, smallest part first: each part meets the sum so far,
    and what the rounded sum loses stays as a part."""
    lost = "(a.q - ((a.q + v) - ((a.q + v) - a.q))) + (v - ((a.q + v) - a.q))"
    grown = (f"aggregate(parts, named_struct('q', term, 'out', {NONE}), "
             f"(a, v) -> named_struct('q', a.q + v, 'out', concat(a.out, array({lost}))), a -> concat(a.out, array(a.q)))")
    expansion = f"aggregate({terms}, {NONE}, (parts, term) -> filter({grown}, z -> z <> 0))"
    return f"cast(coalesce(sign(try_element_at({expansion}, -1)), 0e0D) as int)"


def products(pairs: list[tuple[str, str]]) -> str:
    """An array of doubles, two for each pair, that add up to the products of the pairs."""
    rows = ", ".join(f"named_struct('a', {a}, 'b', {b})" for a, b in pairs)
    halves = f"transform(array({rows}), t -> named_struct('a', t.a, 'b', t.b, 'c', {CUT} * t.a - ({CUT} * t.a - t.a), 'd', {CUT} * t.b - ({CUT} * t.b - t.b)))"
    rest = "((t.c * t.d - t.a * t.b) + t.c * (t.b - t.d) + (t.a - t.c) * t.d) + (t.a - t.c) * (t.b - t.d)"
    return f"flatten(transform({halves}, t -> array({rest}, t.a * t.b)))"


def orientation(x1: str, y1: str, x2: str, y2: str, x: str, y: str) -> str:
    """1 where (x, y) lies left of the edge from (x1, y1) to (x2, y2), -1 right of it, 0 on its line: exactly."""
    left, right = f"(({x1} - {x}) * ({y2} - {y}))", f"(({y1} - {y}) * ({x2} - {x}))"
    exact = sum_sign(products([(x1, y2), (f"-{x1}", y), (f"-{x}", y2), (f"-{y1}", x2), (y1, x), (y, x2)]))
    return (f"(case when {left} - {right} > {PLAIN} * (abs({left}) + abs({right})) then 1 "
            f"when {right} - {left} > {PLAIN} * (abs({left}) + abs({right})) then -1 else {exact} end)")


def is_left(x1: str, y1: str, x2: str, y2: str, x: str, y: str) -> str:
    """Whether the point, moved right by an infinitely small step and up by one smaller still, lies left of the edge.

    No point lies on an edge then, and all answers agree with one position of the point.
    """
    tie = f"(case when {y2} < {y1} or ({y2} = {y1} and {x2} > {x1}) then 1 else -1 end)"
    return f"(2 * {orientation(x1, y1, x2, y2, x, y)} + {tie} > 0)"
