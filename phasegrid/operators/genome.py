"""Region lookup in a genome stored as fixed tiles (chr, tile, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement

# (start, end, strand) of a region: 1-based inclusive bounds on the row's ``chr``
Region = tuple[Column, Column, Column]


def fetch_regions(rows: DataFrame, tiles: DataFrame, tile_size: int, key: list[str], wanted: dict[str, Region]) -> DataFrame:
    """Attach one sequence column per wanted region; rows lacking any of them are dropped.

    A region meets few tiles, so one equi-join on (chr, tile) replaces random
    access for all regions of a row at once; ``key`` identifies the row, which
    travels along. A region that leaves the chromosome is cut at its end, one
    that meets no tile is missing. Strand ``C`` is reverse-complemented, ``W``
    and ``B`` are not.
    """
    names = list(wanted)
    asked = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.greatest(start.cast("long"), F.lit(1)).alias("lo"),
                end.cast("long").alias("hi"),
                strand.alias("strand"),
            )
            for i, (start, end, strand) in enumerate(wanted.values())
        ]
    )
    first, last = F.floor((F.col("_w.lo") - 1) / tile_size), F.floor((F.col("_w.hi") - 1) / tile_size)
    spread = (
        rows.select(F.struct("*").alias("_row"), F.col("chr").alias("_chr"), F.explode(asked).alias("_w"))
        .withColumn("_tile", F.explode(F.sequence(first, last)))
    )
    genome = tiles.select(F.col("chr").alias("_chr"), F.col("tile").alias("_tile"), F.col("seq").alias("_seq"))
    piece = F.expr(
        f"substring(_seq, cast(greatest(_w.lo - _tile * {tile_size}, 1) as int),"
        f" cast(least(_w.hi, (_tile + 1) * {tile_size}) - greatest(_w.lo, _tile * {tile_size} + 1) + 1 as int))"
    )
    parts = spread.join(genome, ["_chr", "_tile"]).withColumn("_piece", piece)

    def collected(i: int) -> Column:
        mine = F.when(F.col("_w.i") == i, F.struct("_tile", "_piece"))
        return F.array_sort(F.collect_list(mine)).alias(f"_p{i}")

    strands = [F.max(F.when(F.col("_w.i") == i, F.col("_w.strand"))).alias(f"_s{i}") for i in range(len(names))]
    grouped = parts.groupBy(*[F.col(f"_row.{k}").alias(f"_k_{k}") for k in key]).agg(
        F.any_value("_row").alias("_row"), *[collected(i) for i in range(len(names))], *strands
    )
    complete = F.lit(True)
    columns = []
    for i, name in enumerate(names):
        complete = complete & (F.size(f"_p{i}") > 0)
        seq = F.upper(F.array_join(F.transform(f"_p{i}", lambda x: x["_piece"]), ""))
        columns.append(F.when(F.col(f"_s{i}") == "C", reverse_complement(seq)).otherwise(seq).alias(name))
    return grouped.filter(complete).select("_row.*", *columns)
