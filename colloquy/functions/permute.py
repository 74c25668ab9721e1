"""A shuffled order without a sort: a keyed permutation of 0 to n - 1, each way, as Column expressions.

A number is split into a row and a column of the smallest near-square table that holds n; rounds add a keyed hash of
the one to the other, which turns the table's places around without collisions. A place beyond n is turned again, until
it isn't; a walk meets no place twice, so it ends. The k-th row of an epoch, and the place of a row in an epoch, are
known at once, wherever the row is stored.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, FACTOR, WORD = 6, 73_244_475, 1 << 32
#: Turns after which a walk is an error; the table has at most sqrt(n) + 1 places beyond n, so it is shorter than that for
#: small n, and for larger n longer walks have a chance below 1e-100.
WALK = 64


def table(n: int) -> tuple[int, int]:
    """Rows and columns."""
    rows = isqrt(max(n, 1) - 1) + 1
    return rows, -(-max(n, 1) // rows)


def keys(seed: int | str) -> list[int]:
    return [int(hashlib.sha256(f"{seed}|{r}".encode()).hexdigest()[:8], 16) for r in range(ROUNDS)]


def _hash(x: Column, key: Column) -> Column:
    h = ((x + key) % WORD) * FACTOR % WORD
    return h.bitwiseXOR(F.shiftright(h, 16))


def _turned(v: Column, n: int, seed: int | str, back: bool) -> Column:
    """One pass of the rounds over the table, or of their inverses in falling order."""
    rows, columns = table(n)
    each = [F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(r % 2 == 0).alias("row")) for r, k in enumerate(keys(seed))]

    def step(acc, round_):
        # The hash of the coordinate that stays is added to the other, or taken off.
        h = _hash(F.when(round_["row"], acc["c"]).otherwise(acc["r"]), round_["k"])
        moved = lambda x, size: F.pmod(x - h if back else x + h, F.lit(size))
        return F.struct(F.when(round_["row"], moved(acc["r"], rows)).otherwise(acc["r"]).alias("r"), F.when(round_["row"], acc["c"]).otherwise(moved(acc["c"], columns)).alias("c"))

    start = F.struct(F.floor(v / columns).cast("bigint").alias("r"), F.pmod(v, F.lit(columns)).cast("bigint").alias("c"))
    return F.aggregate(F.array(*(each[::-1] if back else each)), start, step, lambda a: a["r"] * columns + a["c"])


def _walked(v: Column, n: int, seed: int | str, back: bool) -> Column:
    rows, columns = table(n)
    most = min(rows * columns - n, WALK)
    first = _turned(v.cast("bigint"), n, seed, back)
    if not most:
        return first
    end = F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, lambda a, _: F.when(a >= n, _turned(a, n, seed, back)).otherwise(a))
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("a walk didn't end")).cast("bigint"))


def place(row: Column, n: int, seed: int | str) -> Column:
    """The place in the shuffled order of row number ``row`` (0 to n - 1)."""
    return _walked(row, n, seed, False)


def row_at(k: Column, n: int, seed: int | str) -> Column:
    """The number of the row at place ``k`` of the shuffled order."""
    return _walked(k, n, seed, True)


def sql_turned(v: str, n: str, seed: int | str) -> str:
    """One pass of the rounds in DuckDB; ``n`` is an expression. Passes go on while the result is ``n`` or more."""
    rows = f"ceil(sqrt({n}))::BIGINT"
    columns = f"(({n} + {rows} - 1) // {rows})"
    r, c = f"({v} // {columns})", f"({v} % {columns})"
    for i, k in enumerate(keys(seed)):
        h = f"((({c if i % 2 == 0 else r} + {k}) % {WORD}) * {FACTOR} % {WORD})"
        h = f"xor({h}, {h} >> 16)"
        if i % 2 == 0:
            r = f"(({r} + {h}) % {rows})"
        else:
            c = f"(({c} + {h}) % {columns})"
    return f"({r} * {columns} + {c})"
