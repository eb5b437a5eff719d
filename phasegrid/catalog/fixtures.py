"""Stand-in inputs derived from the star-schema tables, for Spark and for the SQL oracle.

Each stand-in uses its base table whole: documents are laid end to end into
chromosomes, and cut into consecutive precursors, so that every letter is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import text

# How letters become nucleotides, and the sizes of the stand-ins.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
N_CHROM = 5
TILE = 1000
PRECURSOR = 125
QUERY = 21
DOC_BUCKET = 4096


def pieces(s, size: int):
    """Consecutive pieces of ``size`` letters, the last one shorter, in one pass over the text."""
    return F.regexp_extract_all(s, F.lit(f".{{1,{size}}}"), F.lit(0))


class Tables:
    """Lazy access to the tables of one folder, and the stand-ins built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def _nucleotides(text):
        return F.translate(F.regexp_replace(F.lower(text), "[^a-z]+", ""), LETTERS, BASES)

    def docseq(self) -> DataFrame:
        s = self._nucleotides(F.col("text"))
        docs = self.read("documents").select("doc_id", "text")
        # texts are costly and a file may be one split: deal them out whatever its splits are
        docs = docs.repartition("doc_id")
        # two steps, or the letters would be made once for the test and again for the result
        made = docs.select("doc_id", s.alias("s"))
        return made.select("doc_id", F.when(F.length("s") == 0, "ACGT").otherwise(F.col("s")).alias("s"))

    def genome_tiles(self, only: DataFrame | None = None) -> DataFrame:
        """(chr, tile, seq): the documents of a chromosome end to end, cut every 1000 bases; ``only`` names the (chr, tile) asked for."""
        docs = self.docseq().select(
            F.concat(F.lit("chr"), (F.col("doc_id") % N_CHROM + 1).cast("string")).alias("chr"),
            "doc_id",
            "s",
            F.length("s").cast("long").alias("n"),
            F.floor(F.col("doc_id") / DOC_BUCKET).alias("bucket"),
        )
        # offsets in two levels, so that no task ever sees a whole chromosome
        lengths = docs.select("chr", "bucket", "doc_id", "n")
        per_bucket = lengths.groupBy("chr", "bucket").agg(F.sum("n").alias("bucket_n"))
        before = Window.partitionBy("chr").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        bases = per_bucket.select(
            "chr", "bucket", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("base")
        )
        inside = (
            Window.partitionBy("chr", "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
        )
        placed = docs.join(bases, ["chr", "bucket"]).withColumn(
            "off", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
        )
        # the piece that fills the tile it begins in, then whole tiles
        head = F.expr(f"cast({TILE} - off % {TILE} as int)")
        cut = F.concat(F.array(F.substring("s", F.lit(1), head)), pieces(F.substring("s", head + 1, F.col("n").cast("int")), TILE))
        tile = F.floor(F.col("off") / TILE) + F.col("at")
        found = placed.select("chr", "off", F.posexplode(cut).alias("at", "piece")).select(
            "chr", tile.alias("tile"), F.greatest("off", tile * TILE).alias("place"), "piece"
        )
        if only is not None:
            found = found.join(only, ["chr", "tile"], "left_semi")
        ordered = F.array_sort(F.collect_list(F.struct("place", "piece")))
        return found.groupBy("chr", "tile").agg(
            F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("seq")
        )

    def fasta_tiles(self) -> DataFrame:
        """The same tiles, written as sequence text and read again."""
        path = scratch_path(self.spark, "genome")
        text.write_genome(self.genome_tiles(), path)
        return text.fasta_tiles(self.spark, path, TILE)

    def reads(self) -> DataFrame:
        base = (F.col("l_partkey") * 21) % 30000
        phased = F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey") % 5).otherwise(F.lit(2))
        spread = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 21
        shift = F.when(F.floor(base / 1000) % 3 == 0, phased).otherwise(spread)
        return self.read("lineitem").select(
            F.concat(F.lit("lib"), (F.col("l_orderkey") % 3).cast("string")).alias("library"),
            F.concat(F.lit("chr"), (F.col("l_suppkey") % N_CHROM + 1).cast("string")).alias("chr"),
            (1 + base + shift).cast("long").alias("pos"),
            F.when(F.col("l_returnflag") == "R", 16).otherwise(0).alias("flag"),
            F.when(F.col("l_quantity") <= 30, 21)
            .otherwise(18 + F.col("l_quantity").cast("int") % 8)
            .cast("int")
            .alias("len"),
        )

    def alignments(self, genome: DataFrame | None = None) -> DataFrame:
        """Reads with their sequence, from ``genome`` if the tiles are at hand."""
        reads = self.reads().withColumn("tile", F.floor((F.col("pos") - 1) / TILE))
        # tiles without reads are not put together
        used = reads.select("chr", "tile").distinct()
        only = used.select("chr", F.explode(F.array(F.col("tile"), F.col("tile") + 1)).alias("tile")).distinct()
        tiles = self.genome_tiles(only) if genome is None else genome.join(only, ["chr", "tile"], "left_semi")
        a = tiles.select("chr", "tile", F.col("seq").alias("sa"))
        b = tiles.select("chr", (F.col("tile") - 1).alias("tile"), F.col("seq").alias("sb"))
        return (
            reads.join(a.join(b, ["chr", "tile"]), ["chr", "tile"])
            .withColumn(
                "seq",
                F.expr(f"substring(concat(sa, sb), cast((pos - 1) % {TILE} + 1 as int), len)"),
            )
            .select("library", "flag", "chr", "pos", "len", "seq")
        )

    def queries21(self) -> DataFrame:
        """Benchmark texts cut into consecutive 21-base queries; the ordinal is the file order."""
        s = self._nucleotides(F.col("text"))
        cut = self.read("benchmark").select("item_id", s.alias("s")).select(
            "item_id", "s", F.explode(F.expr(f"sequence(0, greatest(length(s) div {QUERY} - 1, 0))")).alias("piece")
        )
        ordinal = F.col("item_id") * 100 + F.col("piece")
        return cut.select(
            ordinal.alias("ordinal"),
            F.concat(
                F.when(F.col("item_id") % 4 == 3, "oth-").otherwise("ath-"), ordinal.cast("string")
            ).alias("name"),
            F.expr(
                f"case when piece = length(s) div {QUERY} - 1 then substring(s, cast(piece * {QUERY} + 1 as int))"
                f" else substring(s, cast(piece * {QUERY} + 1 as int), {QUERY}) end"
            ).alias("seq"),
        )

    def folds(self) -> DataFrame:
        """Consecutive 125-base precursors with a balanced one- or two-stem fold and an effector."""
        cut = self.docseq().select("doc_id", F.posexplode(pieces(F.col("s"), PRECURSOR)).alias("piece", "part"))
        pre = cut.select((F.col("doc_id") * 10000 + F.col("piece")).alias("seq_id"), "part").select(
            "seq_id",
            F.expr(f"substring(repeat(part, cast(ceil({PRECURSOR}.0 / length(part)) as int)), 1, {PRECURSOR})").alias(
                "precursor"
            ),
        )
        return pre.select(
            "seq_id",
            "precursor",
            F.expr(FOLD_SQL).alias("fold"),
            F.expr(
                "case when seq_id % 50 = 7 then reverse(translate(substring(precursor,"
                " cast(20 + seq_id % 60 as int), 21), 'ACGT', 'TGCA'))"
                " else substring(precursor, cast(20 + seq_id % 60 as int), 21) end"
            ).alias("eff_seq"),
        )

    def features(self) -> DataFrame:
        gc = F.length("s") - F.length(F.translate("s", "GC", ""))
        return (
            self.read("documents")
            .join(self.read("labels"), "doc_id")
            .join(self.docseq(), "doc_id")
            .select(
                "doc_id",
                "lang",
                "source",
                F.col("n_chars").cast("double").alias("n_chars"),
                F.length("s").cast("double").alias("n_letters"),
                gc.cast("double").alias("n_gc"),
                (F.col("quality") == 1).alias("consistent"),
                (F.col("toxic") == 1).alias("toxic"),
            )
        )

    def indications(self) -> DataFrame:
        return self.read("events").select(
            F.col("user_id").alias("precursor_id"),
            (F.col("event_id") % 40).cast("int").alias("pos"),
            (19 + F.col("event_id") % 5).cast("int").alias("len"),
            F.col("event_id").alias("ordinal"),
            F.col("value").alias("score"),
        )

    def ref_loci(self) -> DataFrame:
        start = 5000 * (F.col("n_nationkey") % 4)
        return self.read("nation").select(
            F.concat(
                F.lit("chr"),
                (F.col("n_nationkey") % N_CHROM + 1).cast("string"),
                F.lit("__"),
                start.cast("string"),
                F.lit("_"),
                (start + 5250).cast("string"),
            ).alias("CONTIG_literature_seen"),
            F.col("n_name").alias("locus"),
        )


# two stems of 29 when seq_id leaves 2 modulo 3, else one stem of 60
FOLD_SQL = """
case when seq_id % 3 = 2 then
  concat(translate(substring(precursor, 1, 29), 'ACGT', '(((.'), '....',
         reverse(translate(translate(substring(precursor, 1, 29), 'ACGT', '(((.'), '(', ')')),
         translate(substring(precursor, 63, 29), 'ACGT', '((.('), '....',
         reverse(translate(translate(substring(precursor, 63, 29), 'ACGT', '((.('), '(', ')')), '.')
else
  concat(translate(substring(precursor, 1, 60), 'ACGT', '(((.'), '.....',
         reverse(translate(translate(substring(precursor, 1, 60), 'ACGT', '(((.'), '(', ')')))
end
"""

# the same stand-ins for the oracle: name -> (names it needs, SQL)
SQL: dict[str, tuple[list[str], str]] = {
    "docseq": (
        [],
        f"""SELECT doc_id, CASE WHEN length(s0) = 0 THEN 'ACGT' ELSE s0 END AS s
FROM (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS s0
      FROM documents)""",
    ),
    "genome": (
        ["docseq"],
        f"""SELECT chr, tile, string_agg(piece, '' ORDER BY place) AS seq
FROM (SELECT chr, tile, greatest(off, tile * {TILE}) AS place,
        substr(s, CAST(greatest(tile * {TILE} - off, 0) + 1 AS INT),
               CAST((tile + 1) * {TILE} - greatest(off, tile * {TILE}) AS INT)) AS piece
      FROM (SELECT chr, off, s, unnest(range(off // {TILE}, (off + length(s) - 1) // {TILE} + 1)) AS tile
            FROM (SELECT 'chr' || (doc_id % {N_CHROM} + 1) AS chr, s,
                    CAST(sum(length(s)) OVER (PARTITION BY doc_id % {N_CHROM} ORDER BY doc_id) - length(s)
                         AS BIGINT) AS off
                  FROM docseq)))
GROUP BY chr, tile""",
    ),
    "reads": (
        [],
        f"""SELECT 'lib' || (l_orderkey % 3) AS library, 'chr' || (l_suppkey % {N_CHROM} + 1) AS chr,
  CAST(1 + base + CASE WHEN (base // 1000) % 3 = 0
         THEN CASE WHEN l_orderkey % 4 = 0 THEN l_orderkey % 5 ELSE 2 END
         ELSE (l_orderkey * 7 + l_linenumber) % 21 END AS BIGINT) AS pos,
  CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END AS flag,
  CASE WHEN l_quantity <= 30 THEN 21 ELSE 18 + CAST(l_quantity AS INT) % 8 END AS len
FROM (SELECT *, (l_partkey * 21) % 30000 AS base FROM lineitem)""",
    ),
    "alignments": (
        ["genome", "reads"],
        f"""SELECT r.library, r.flag, r.chr, r.pos, r.len,
  substr(a.seq || b.seq, CAST((r.pos - 1) % {TILE} + 1 AS INT), r.len) AS seq
FROM reads r JOIN genome a ON a.chr = r.chr AND a.tile = (r.pos - 1) // {TILE}
JOIN genome b ON b.chr = r.chr AND b.tile = a.tile + 1""",
    ),
    "queries21": (
        [],
        f"""SELECT item_id * 100 + piece AS ordinal,
  CASE WHEN item_id % 4 = 3 THEN 'oth-' ELSE 'ath-' END || (item_id * 100 + piece) AS name,
  CASE WHEN piece = length(s) // {QUERY} - 1 THEN substr(s, CAST(piece * {QUERY} + 1 AS INT))
       ELSE substr(s, CAST(piece * {QUERY} + 1 AS INT), {QUERY}) END AS seq
FROM (SELECT item_id, s, unnest(range(0, greatest(length(s) // {QUERY}, 1))) AS piece
      FROM (SELECT item_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') AS s
            FROM benchmark))""",
    ),
    "folds": (
        ["docseq"],
        f"""SELECT seq_id, precursor, {FOLD_SQL.strip()} AS fold,
  CASE WHEN seq_id % 50 = 7
       THEN reverse(translate(substr(precursor, CAST(20 + seq_id % 60 AS INT), 21), 'ACGT', 'TGCA'))
       ELSE substr(precursor, CAST(20 + seq_id % 60 AS INT), 21) END AS eff_seq
FROM (SELECT seq_id, substr(repeat(part, CAST(ceil({PRECURSOR}.0 / length(part)) AS INT)), 1, {PRECURSOR}) AS precursor
      FROM (SELECT doc_id * 10000 + piece AS seq_id, substr(s, CAST(piece * {PRECURSOR} + 1 AS INT), {PRECURSOR}) AS part
            FROM (SELECT doc_id, s, unnest(range(0, (length(s) - 1) // {PRECURSOR} + 1)) AS piece FROM docseq)))""",
    ),
    "features": (
        ["docseq"],
        """SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars,
  CAST(length(s.s) AS DOUBLE) AS n_letters,
  CAST(length(s.s) - length(translate(s.s, 'GC', '')) AS DOUBLE) AS n_gc,
  l.quality = 1 AS consistent, l.toxic = 1 AS toxic
FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN docseq s ON s.doc_id = d.doc_id""",
    ),
    "indications": (
        [],
        """SELECT user_id AS precursor_id, CAST(event_id % 40 AS INT) AS pos, CAST(19 + event_id % 5 AS INT) AS len,
  event_id AS ordinal, value AS score FROM events""",
    ),
    "ref_loci": (
        [],
        f"""SELECT 'chr' || (n_nationkey % {N_CHROM} + 1) || '__' || (5000 * (n_nationkey % 4)) || '_'
  || (5000 * (n_nationkey % 4) + 5250) AS CONTIG_literature_seen, n_name AS locus FROM nation""",
    ),
}


def with_views(sql: str, needs: list[str], extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """Prefix a query with the common table expressions it needs, in dependency order."""
    defined = {**SQL, **(extra or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in defined[name][0]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{defined[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{sql}"
