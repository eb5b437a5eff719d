"""Periodicity of positioned reads.

Reads are first summed per (library, chr, tile, position, strand). From there
every window of a position is expressed as a RANGE frame; all frames partition
by the contig, or by the contig and more, so that one shuffle of the summed
positions serves them all. A contig holds at most a few thousand positions
however many reads it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..params import CONTIG_KEYS, CYCLE, DICER, DRIFT
from .tiling import shifted_position


def times(condition: Column, weight: str | None) -> Column:
    """How many reads meet a condition: rows, or the sum of what they stand for."""
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight)).otherwise(0)), F.lit(0)).cast("long")


def position_frequency(contig_reads: DataFrame, dicer: int = DICER, weight: str | None = None) -> DataFrame:
    """Counts per contig and shifted position: reads of ``dicer`` bases and of any length.

    Reads whose flag gives no strand appear with a NULL position, so that the
    sum of ``n_reads`` over a contig is its number of reads. A row stands for
    ``weight`` equal reads, none if that is NULL or less than one.
    """
    placed = contig_reads.withColumn("p", shifted_position(F.col("flag"), F.col("pos")))
    watson, crick, exact = F.col("flag") == 0, F.col("flag") == 16, F.col("len") == dicer
    if weight:
        placed = placed.filter(F.col(weight) >= 1)
    return placed.groupBy(*CONTIG_KEYS, F.col("p").alias("pos")).agg(
        times(watson & exact, weight).alias("w"),
        times(crick & exact, weight).alias("c"),
        times(watson, weight).alias("w_all"),
        times(crick, weight).alias("c_all"),
        times(F.lit(True), weight).alias("n_reads"),
    )


def _contig() -> Window:
    return Window.partitionBy(*CONTIG_KEYS)


def _ahead(cycle: int, dicer: int):
    return _contig().orderBy("pos").rangeBetween(0, dicer * (cycle - 1))


def _near(drift: int):
    return _contig().orderBy("pos").rangeBetween(-drift, drift)


def _in_phase(cycle: int, dicer: int):
    return Window.partitionBy(*CONTIG_KEYS, "phase").orderBy("pos").rangeBetween(0, dicer * (cycle - 1))


def _present(x: str) -> Column:
    return (F.col(x) > 0).cast("long")


def window_totals(pos_freq: DataFrame, cycle: int = CYCLE, dicer: int = DICER) -> DataFrame:
    """n, u (exact length), n_all, u_all (any length) and the strand totals of the window ahead."""
    ahead = _ahead(cycle, dicer)
    sums = {
        "n": F.sum(_present("w") + _present("c")).over(ahead),
        "n_all": F.sum(_present("w_all") + _present("c_all")).over(ahead),
        "u": F.sum(F.col("w") + F.col("c")).over(ahead),
        "Wfreq": F.sum("w_all").over(ahead),
        "Cfreq": F.sum("c_all").over(ahead),
    }
    return pos_freq.withColumns(sums).withColumn("u_all", F.col("Wfreq") + F.col("Cfreq"))


def strand_dominance(df: DataFrame, watson: str = "Wfreq", total: str = "u_all") -> DataFrame:
    ratio = F.round((F.col(watson) + 0.00001) / (F.col(total) + 0.00001), 2)
    label = F.when(F.col("ratio") > 0.8, "Watson").when(F.col("ratio") < 0.2, "Crick").otherwise("both")
    return df.withColumn("ratio", ratio).withColumn("dominant_strand", label)


def effector_coordinate(pos_freq: DataFrame, drift: int = DRIFT) -> DataFrame:
    """Strongest nearby place per strand, and the sum of the neighbours without the place itself."""
    near = _near(drift)

    def best(count: str) -> Column:
        return F.max(F.when(F.col(count) > 0, F.struct(F.col(count).alias("q"), (-F.col("pos")).alias("neg")))).over(near)

    qw, qc = F.coalesce(F.col("_bw.q"), F.lit(0)), F.coalesce(F.col("_bc.q"), F.lit(0))
    pw, pc = F.coalesce(-F.col("_bw.neg"), F.lit(0)), -F.col("_bc.neg")
    total = F.col("w") + F.col("c")
    return (
        pos_freq.withColumn("f", total)
        .withColumns({"_near": F.sum("f").over(near), "_bw": best("w"), "_bc": best("c")})
        .withColumns(
            {
                "drift": F.col("_near") - F.col("f"),
                "eff_strand": F.when(qw > qc, "W").when(qw == qc, "B").otherwise("C"),
                "eff_pos": F.when(qw >= qc, pw).otherwise(pc - 2),
                "eff_frq": F.greatest(qw, qc),
            }
        )
        .drop("_near", "_bw", "_bc")
    )


def phase_slots(pos_freq: DataFrame, cycle: int = CYCLE, dicer: int = DICER) -> DataFrame:
    """p, k and the peak of the in-phase places ahead; needs the columns of ``effector_coordinate``.

    Only positions with reads of the exact length open a window. The peak is
    the strongest place, the first one on ties; its neighbours count for p and maxf.
    """
    slots = _in_phase(cycle, dicer)
    peak = F.max(
        F.struct("f", (-F.col("pos")).alias("neg"), "drift", "eff_strand", "eff_pos", "eff_frq")
    ).over(slots)
    return (
        pos_freq.filter(F.col("f") > 0)
        .withColumn("phase", F.pmod("pos", F.lit(dicer)))
        .withColumns(
            {"_peak": peak, "slot_sum": F.sum("f").over(slots), "k": F.count(F.lit(1)).over(slots)}
        )
        .withColumns(
            {
                "p": F.col("slot_sum") + F.col("_peak.drift"),
                "maxf": F.col("_peak.f") + F.col("_peak.drift"),
                "pos_of_maxf": -F.col("_peak.neg"),
                "peak_strand": F.col("_peak.eff_strand"),
                "peak_eff_pos": F.col("_peak.eff_pos"),
                "peak_eff_frq": F.col("_peak.eff_frq"),
            }
        )
        .drop("_peak")
    )


def phase_window_join(pos_freq: DataFrame, cycle: int = CYCLE, dicer: int = DICER) -> DataFrame:
    """The pairs behind ``phase_slots``: every expressed place with the expressed places in its slots.

    Each place is spread over its slots and joined by equality, at most
    ``cycle`` rows per place.
    """
    placed = pos_freq.withColumn("f", F.col("w") + F.col("c")).filter(F.col("f") > 0)
    slot = F.explode(F.array(*[F.col("pos") + i * dicer for i in range(cycle)]))
    left = placed.select(*CONTIG_KEYS, "pos", slot.alias("q"))
    right = placed.select(*CONTIG_KEYS, F.col("pos").alias("q"), F.col("f").alias("q_freq"))
    return left.join(right, [*CONTIG_KEYS, "q"]).select(*CONTIG_KEYS, "pos", "q", "q_freq")


def high_potential(min_k: int = 3, min_maxf: int = 4) -> Column:
    return (F.col("k") >= min_k) & (F.col("maxf") >= min_maxf)


def having_min_windows(df: DataFrame, keep: Column, at_least: int = 10) -> DataFrame:
    """Drop whole contigs with fewer than ``at_least`` kept windows; all rows of the others stay."""
    counted = df.withColumn("_kept", F.count_if(keep).over(_contig()))
    return counted.filter(F.col("_kept") >= at_least).drop("_kept")


def extend_blocks(windows: DataFrame, keep: Column, carried: list[str], cycle: int = CYCLE, dicer: int = DICER) -> DataFrame:
    """Extend every kept window by whole blocks to the right and to the left.

    A block counts while it holds more than one expressed in-phase place. Every
    place belongs to one block in each of ``cycle`` alignments; the blocks of an
    alignment that count form islands, and the island around a window's own
    block is its segment. So each place is laid out ``cycle`` times and grouped,
    instead of being paired with every other place of its phase.

    The peak of the segment is the strongest place; ties prefer the window's own
    block, then blocks to the right, nearest first, then to the left.
    """
    span = cycle * dicer
    own = F.col("_a") == 0
    peak = F.struct("f", (-F.col("pos")).alias("neg"), "eff_strand", "eff_pos", "eff_frq")
    blocks = (
        windows.withColumn("_keep", keep)
        .withColumn("_a", F.explode(F.array(*[F.lit(i) for i in range(cycle)])))
        .withColumn("_x", F.col("pos") - F.col("_a") * dicer)
        .groupBy(*CONTIG_KEYS, "_x")
        .agg(
            F.count(F.lit(1)).alias("_cnt"),
            F.min("pos").alias("_lo"),
            F.max("pos").alias("_hi"),
            F.max(peak).alias("_best"),
            F.max(F.when(own & F.col("_keep"), F.struct(*carried))).alias("_core"),
        )
        .filter(F.col("_cnt") > 1)
        .withColumn("_r", F.pmod("_x", F.lit(span)))
    )
    line = Window.partitionBy(*CONTIG_KEYS, "_r").orderBy("_x")
    island = Window.partitionBy(*CONTIG_KEYS, "_r", "_isl")
    right = island.orderBy("_x").rowsBetween(1, Window.unboundedFollowing)
    left = island.orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)

    def nearest(sign: int, frame) -> Column:
        ranked = F.struct(
            F.col("_best.f").alias("f"),
            (F.col("_x") * sign).alias("near"),
            F.col("_best").alias("best"),
        )
        return F.max(ranked).over(frame)

    rf, lf = F.coalesce(F.col("_right.f"), F.lit(0)), F.coalesce(F.col("_left.f"), F.lit(0))
    chosen = (
        F.when(F.col("_best.f") >= F.greatest(rf, lf), F.col("_best"))
        .when(rf >= lf, F.col("_right.best"))
        .otherwise(F.col("_left.best"))
    )
    joined = (
        blocks.withColumn("_isl", F.floor(F.col("_x") / span) - F.row_number().over(line))
        .withColumns(
            {
                "ext_k": F.sum("_cnt").over(island),
                "_first": F.min("_lo").over(island),
                "_last": F.max("_hi").over(island),
                "_right": nearest(-1, right),
                "_left": nearest(1, left),
            }
        )
        .filter(F.col("_core").isNotNull())
        .withColumn("_peak", chosen)
    )
    return joined.select(
        *CONTIG_KEYS,
        "_core.*",
        "ext_k",
        F.greatest(F.col("_first") - dicer, F.lit(0)).alias("L_bound"),
        (F.col("_last") + dicer).alias("R_bound"),
        (-F.col("_peak.neg")).alias("pos_of_maxf"),
        F.col("_peak.eff_strand").alias("eff_strand"),
        F.col("_peak.eff_pos").alias("eff_pos"),
        F.col("_peak.eff_frq").alias("eff_frq"),
    ).withColumn("length", F.col("R_bound") - F.col("L_bound") + 1)


def scored(df: DataFrame, table: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """Add the four score families to windows that have p, k, u, u_all, maxf, n and n_all."""
    k, p, maxf = F.col("k"), F.col("p"), F.col("maxf")
    out = (
        df.withColumn("Howell", scores.howell_xia(p, F.col("u"), k))
        .withColumn("Howellb", scores.howell_2007(p, k))
        .withColumn("Guo", scores.guo(F.col("u"), k, p, maxf))
        .withColumn("Guo_b", scores.guo(F.col("u_all"), k, p, maxf))
    )
    out = scores.with_chen(out, table, "k", "n", "pval", cycle)
    return scores.with_chen(out, table, "k", "n_all", "pval_b", cycle)
