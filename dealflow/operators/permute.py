"""Permutations computed position by position: no sort, no rank, no table of the permutation.

A position below n is a cell of an a x b rectangle that holds n cells and fewer than a
more.  Rounds of a keyed Feistel network on row and column map the rectangle onto
itself one to one; a position that lands on one of the surplus cells goes through the
network again until it is below n, which keeps the map one to one.  All arithmetic is on
longs, so any engine that has them computes the same permutation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
ROUNDS = 4
#: Walks from surplus cells back; a position that needs more is an error (the odds are below n ** -8).
WALKS = 16


def round_keys(*parts) -> list[list[int]]:
    """Coefficients of each round's cubic polynomial, from a digest of what names the permutation."""
    out = []
    for k in range(ROUNDS):
        digest = hashlib.sha256(":".join(map(str, (*parts, k))).encode()).digest()
        out.append([int.from_bytes(digest[4 * i:4 * i + 4], "big") % PRIME for i in range(4)])
    return out


def rectangle(n: int) -> tuple[int, int]:
    """Rows and columns of the rectangle."""
    rows = math.isqrt(max(n - 1, 0)) + 1
    return rows, max(1, -(-n // rows))


def _poly(c: Column, x: Column) -> Column:
    p = F.lit(PRIME)
    return (((c[3] * x + c[2]) % p * x + c[1]) % p * x + c[0]) % p


def permuted(position: Column, n: int, keys: Column) -> Column:
    """Where ``position`` (from 0, below n) goes; ``keys`` is an array of arrays of longs from ``round_keys``.

    The first pass through the network, which brings almost all positions below n, is plain
    arithmetic that Spark compiles; only walks from surplus cells are a loop.
    """
    rows, columns = rectangle(n)
    a, b = F.lit(rows).cast("bigint"), F.lit(columns).cast("bigint")

    def turn(s: tuple[Column, Column], c: Column, even: bool) -> tuple[Column, Column]:
        # the even rounds move the row, the odd ones the column
        left, right = s
        return ((left + _poly(c, right)) % a, right) if even else (left, (right + _poly(c, left)) % b)

    def once(x: Column) -> Column:
        s = (F.floor(x / b).cast("bigint"), x % b)
        for k in range(ROUNDS):
            s = turn(s, F.get(keys, F.lit(k)), k % 2 == 0)
        return s[0] * b + s[1]

    first = once(position.cast("bigint"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)),
                       lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a position did not come back to the table")).cast("bigint")))
    return F.when(first < n, first).otherwise(walk)


def keys_literal(keys: Sequence[Sequence[int]]) -> Column:
    return F.array(*[F.array(*[F.lit(x).cast("bigint") for x in row]) for row in keys])


def permuted_sql(position: str, n: str, keys: str) -> str:
    """The same in DuckDB SQL; ``n`` is an expression, ``keys`` a list of lists of BIGINT."""
    rows = f"(CAST(floor(sqrt(greatest({n} - 1, 0))) AS BIGINT) + 1)"
    columns = f"greatest(1, ({n} + {rows} - 1) // {rows})"

    def poly(x: str) -> str:
        return f"((((c[4] * {x} + c[3]) % {PRIME} * {x} + c[2]) % {PRIME} * {x} + c[1]) % {PRIME})"

    def once(x: str) -> str:
        turn = (f"CASE WHEN i % 2 = 1 THEN [(s[1] + {poly('s[2]')}) % {rows}, s[2]] ELSE [s[1], (s[2] + {poly('s[1]')}) % {columns}] END")
        return (f"list_transform([list_reduce(list_transform({keys}, lambda c, i: [c[1], c[2], c[3], c[4], i]), "
                f"lambda s, c: {turn.replace('i % 2', 'c[5] % 2')}, [{x} // {columns}, {x} % {columns}])], "
                f"lambda f: f[1] * {columns} + f[2])[1]")

    return f"list_reduce(range(0, {WALKS}), lambda x, w: CASE WHEN x < {n} THEN x ELSE {once('x')} END, {once(position)})"
