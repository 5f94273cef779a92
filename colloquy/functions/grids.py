"""Small grids (boards, pictures) as nested arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def as_rows(flat: Column, side: int) -> Column:
    """A flat array as rows of `side` cells."""
    return F.transform(F.sequence(F.lit(0), F.lit(side - 1)),
                       lambda r: F.slice(flat, r * side + 1, F.lit(side)))


def mirror(rows: Column | str) -> Column:
    return F.transform(rows, lambda row: F.reverse(row))


def encode_grid(rows: Column, aux: list[Column], n_cells: int, aux_dims: list[int]) -> Column:
    """Cells with a separator after each row, auxiliary ids at their offsets, an end id."""
    row_sep, end, offset = n_cells, n_cells + 1, n_cells + 2
    cells = F.flatten(F.transform(rows, lambda r: F.concat(r, F.array(F.lit(row_sep)))))
    tail = []
    for dim, value in zip(aux_dims, aux):
        tail.append((value + offset).cast("int"))
        offset += dim
    return F.concat(cells, F.array(*tail, F.lit(end)))


def pool_factor(side: int, limit: int = V.MAX_SIDE) -> int:
    return -(-side // limit)


def mean_pool(rows: Column, side: int, factor: int) -> Column:
    """Means of factor x factor squares."""
    steps = F.sequence(F.lit(0), F.lit(side // factor - 1))

    def square(i: Column, j: Column) -> Column:
        cells = F.flatten(F.transform(F.slice(rows, i * factor + 1, F.lit(factor)),
                                      lambda r: F.slice(r, j * factor + 1, F.lit(factor))))
        return F.aggregate(cells, F.lit(0.0), lambda a, v: a + v) / float(factor * factor)

    return F.transform(steps, lambda i: F.transform(steps, lambda j: square(i, j)))


def glyph(r: Column, g: Column, b: Column) -> Column:
    """A grey ramp character, or a hue letter when the channels differ clearly."""
    lum = 0.299 * r + 0.587 * g + 0.114 * b
    top = F.greatest(r, g, b)
    spread = top - F.least(r, g, b)
    by = F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    hue = (F.when(top == r, F.pmod((g - b) / by, F.lit(6.0)))
           .when(top == g, (b - r) / by + 2).otherwise((r - g) / by + 4))
    letter = F.substring(F.lit(V.HUES), F.bround(hue).cast("int") % 6 + 1, F.lit(1))
    level = F.least(F.greatest(F.floor(lum * len(V.GLYPHS) / 256), F.lit(0)),
                    F.lit(len(V.GLYPHS) - 1)).cast("int")
    return (F.when(spread < V.CHROMA_MIN, F.substring(F.lit(V.GLYPHS), level + 1, F.lit(1)))
            .when(lum >= 128, F.upper(letter)).otherwise(letter))


def glyph_text(r: str, g: str, b: str) -> Column:
    """Three pooled channels as lines of glyphs."""
    def line(row: Column) -> Column:
        pairs = F.zip_with(row[r], row[g], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return F.array_join(F.zip_with(pairs, row[b], lambda p, z: glyph(p["x"], p["y"], z)), "")

    return F.array_join(F.transform(F.arrays_zip(r, g, b), line), "\n")
