"""Text sources and sinks: alignments, sequence files, feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of an alignment line that are used, counted from 0.
FLAG, REF, POS, SEQ = 1, 2, 3, 9


# a library is a file x.sam, or a folder x.sam (also library=x.sam) of part files
_LIBRARY = r"(?:/|^)(?:library=)?([^/=]+)\.sam(?:/|$)"


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of all libraries below ``path``; header lines start with ``@``.

    ``library`` is the base name of the ``.sam`` file or folder. Other files,
    backups such as ``x.sam~`` among them, are passed over; an empty file gives
    no rows. All libraries are one table, and the library is a grouping key.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .select("value", F.regexp_extract(F.col("_metadata.file_path"), _LIBRARY, 1).alias("library"))
    )
    f = F.split("value", "\t")
    kept = (F.col("library") != "") & (F.col("value") != "") & ~F.col("value").startswith("@")
    return lines.filter(kept).select(
        "library",
        F.get(f, F.lit(FLAG)).cast("int").alias("flag"),
        F.get(f, F.lit(REF)).alias("chr"),
        F.get(f, F.lit(POS)).cast("long").alias("pos"),
        F.length(F.get(f, F.lit(SEQ))).alias("len"),
        F.get(f, F.lit(SEQ)).alias("seq"),
    )


def write_alignments(reads: DataFrame, path: str) -> None:
    """Alignment text with eleven fields, one folder per library, a header line in each."""
    star = F.lit("*")
    line = F.concat_ws(
        "\t",
        F.lit("r"), F.col("flag").cast("string"), F.col("chr"), F.col("pos").cast("string"), F.lit("255"),
        F.concat(F.col("len").cast("string"), F.lit("M")), star, F.lit("0"), F.lit("0"), F.col("seq"), star,
    )
    folder = F.concat(F.col("library"), F.lit(".sam")).alias("library")
    heads = reads.select("library").distinct().select(folder, F.lit("@HD\tVN:1.0").alias("value"))
    heads.unionByName(reads.select(folder, line.alias("value"))).write.partitionBy("library").text(path)


def expand_counts(counted: DataFrame, seq: str = "seq", count: str = "n") -> DataFrame:
    """One row per occurrence from (sequence, count)."""
    times = F.explode(F.sequence(F.lit(1), F.col(count)))
    return counted.filter(F.col(count) > 0).withColumn("_i", times).drop("_i", count)


def read_fasta(spark: SparkSession, path: str, species: str | None = None) -> DataFrame:
    """(name, seq, file, ordinal) of every record.

    A record starts with ``>`` at the head of a line; its sequence lines are
    joined. The name is the first word of the header. The ordinal rises with the
    order of records inside a file.
    """
    records = (
        spark.read.option("lineSep", "\n>")
        .text(path)
        .select(
            F.regexp_replace("value", "^>", "").alias("r"),
            F.col("_metadata.file_name").alias("file"),
            F.monotonically_increasing_id().alias("ordinal"),
        )
        .filter(F.trim("r") != "")
    )
    header = F.trim(F.substring_index("r", "\n", 1))
    body = F.regexp_replace(F.substring(F.col("r"), F.length(F.substring_index("r", "\n", 1)) + 1, F.length("r")), r"\s", "")
    out = records.select(F.regexp_extract(header, r"^(\S+)", 1).alias("name"), body.alias("seq"), "file", "ordinal")
    return out.filter(F.col("name").startswith(species)) if species else out


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, off, seq) of every sequence line: its record, and the bases of the record before it.

    A file is read line by line by as many tasks as it has splits, and no record is
    ever one row. Inside a split, places are running sums. Of every split the last
    header and the bases after it are passed on, one row per split; from those the
    later splits learn which record they begin in, and where. Lines before any
    header belong to no record and go; so do empty ones.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").startswith(">").alias("head"),
        F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("title"), F.regexp_replace("value", r"\s", "").alias("seq"),
    )
    upto = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = lines.withColumn("n", F.when(F.col("head"), 0).otherwise(F.length("seq")).cast("long")).withColumns({
        "heads": F.sum(F.col("head").cast("long")).over(upto),
        "name": F.last(F.when(F.col("head"), F.col("title")), ignorenulls=True).over(upto),
    })
    section = Window.partitionBy("file", "split", "heads").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("inside", F.coalesce(F.sum("n").over(section), F.lit(0)))
    ends = placed.groupBy("file", "split").agg(
        F.max_by(F.struct("heads", "name", (F.col("inside") + F.col("n")).alias("tail")), "at").alias("e")).select("file", "split", "e.*")
    earlier = Window.partitionBy("file").orderBy("split")
    groups = ends.withColumn("g", F.sum((F.col("heads") > 0).cast("long")).over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("file", "g").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    carried = groups.withColumn("sum", F.sum("tail").over(run)).select(
        F.col("file").alias("f"), F.col("split").alias("s"),
        F.last("name", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("from_name"),
        F.coalesce(F.lag("sum").over(earlier), F.lit(0)).alias("from_off"),
    )
    joined = placed.join(carried, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    own = F.col("heads") > 0
    return joined.filter(~F.col("head") & (F.col("n") > 0)).select(
        "file", F.when(own, F.col("name")).otherwise(F.col("from_name")).alias("name"),
        (F.col("inside") + F.when(own, 0).otherwise(F.col("from_off"))).alias("off"), "seq",
    ).filter(F.col("name").isNotNull())


def fasta_tiles(spark: SparkSession, path: str, tile_size: int) -> DataFrame:
    """(chr, tile, seq): the records of a genome cut every ``tile_size`` bases, the last tile shorter.

    ``chr`` is the first word of a record's header, which names one record only.
    """
    lines = fasta_lines(spark, path)
    first, last = F.floor(F.col("off") / tile_size), F.floor((F.col("off") + F.length("seq") - 1) / tile_size)
    pieces = lines.select("name", "off", "seq", F.explode(F.sequence(first, last)).alias("tile")).select(
        F.col("name").alias("chr"), "tile", F.greatest("off", F.col("tile") * tile_size).alias("place"),
        F.expr(f"substring(seq, cast(greatest(tile * {tile_size} - off, 0) + 1 as int),"
               f" cast((tile + 1) * {tile_size} - greatest(off, tile * {tile_size}) as int))").alias("piece"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("place", "piece")))
    return pieces.groupBy("chr", "tile").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("seq"))


def write_genome(tiles: DataFrame, path: str) -> None:
    """Tiles (chr, tile, seq) as sequence text, a file per chromosome or more of them, a line per tile.

    The lines of a record have an order, so one task writes it, line by line.
    """
    heads = tiles.select("chr").distinct().select("chr", F.lit(-1).cast("long").alias("tile"), F.concat(F.lit(">"), F.col("chr")).alias("value"))
    lines = heads.unionByName(tiles.select("chr", F.col("tile").cast("long").alias("tile"), F.col("seq").alias("value")))
    lines.repartition("chr").sortWithinPartitions("chr", "tile").select("value").write.text(path)


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", width: int = 60) -> None:
    wrapped = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped).alias("value")).write.text(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Tab-separated table with a header line."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.option("sep", "\t").option("header", True)
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def drop_malformed(spark: SparkSession, path: str, header_prefix: str) -> DataFrame:
    """Lines of a tab-separated file with as many fields as its header line; ``value`` and ``n_fields``.

    The header is the line that starts with ``header_prefix``, or the first line
    where none does; the expected number is one value, looked up once and kept
    as a literal. Of a file without lines nothing is kept.
    """
    lines = spark.read.text(path).withColumn("n_fields", F.size(F.split("value", "\t", -1)))
    head = lines.filter(F.col("value").startswith(header_prefix)).select("n_fields").first()
    head = head or lines.select("n_fields").first()
    expected = head["n_fields"] if head else None
    return lines.filter(F.col("n_fields") == F.lit(expected).cast("int"))


def write_stage(df: DataFrame, path: str, partition_by: str = "library") -> None:
    """Columnar stage table, one folder per library, ordered by contig inside each file."""
    order = [c for c in (partition_by, "chr", "tile", "pos") if c in df.columns]
    df.sortWithinPartitions(*order).write.partitionBy(partition_by).parquet(path)
