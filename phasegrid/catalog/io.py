"""Sources and sinks, each over a text copy that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import text
from .fixtures import Tables
from .registry import query

READ_COLS = "library string, flag int, chr string, pos long, len int, seq string"


def _written(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "alignments")
    text.write_alignments(t.alignments(), path)
    return text.read_alignments(t.spark, path)


@query("scan_alignments", READ_COLS, ["alignments"], "SELECT * FROM alignments")
def _(t: Tables) -> DataFrame:
    return _written(t)


@query("scan_library_folder", "library string, n_reads long, n_bases long", ["alignments"],
       "SELECT library, count(*) AS n_reads, sum(len) AS n_bases FROM alignments GROUP BY library")
def _(t: Tables) -> DataFrame:
    return _written(t).groupBy("library").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("len").alias("n_bases"))


@query("merge_libraries", "chr string, pos long, n_libraries long", ["alignments"],
       "SELECT chr, pos, count(DISTINCT library) AS n_libraries FROM alignments GROUP BY chr, pos")
def _(t: Tables) -> DataFrame:
    return _written(t).groupBy("chr", "pos").agg(F.count_distinct("library").alias("n_libraries"))


@query("scan_fasta", "name string, seq string", ["queries21"], "SELECT * FROM queries21 WHERE name LIKE 'ath%'")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "fasta")
    text.write_fasta(t.queries21(), path, width=10)
    return text.read_fasta(t.spark, path, "ath")


@query("fasta_tiles", "chr string, tile long, seq string", ["genome"], "SELECT * FROM genome")
def _(t: Tables) -> DataFrame:
    return t.fasta_tiles()


@query("scan_feature_table", "doc_id long, lang string, source string, n_chars double, n_letters double, n_gc double, "
       "consistent boolean, toxic boolean", ["features"], "SELECT * FROM features")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "features")
    table = t.features()
    text.write_table(table, path)
    return text.read_table(t.spark, path, table.schema)


@query("expand_readcount", "seq string", ["alignments"], "SELECT seq FROM alignments")
def _(t: Tables) -> DataFrame:
    return text.expand_counts(t.alignments().groupBy("seq").agg(F.count(F.lit(1)).alias("n")))


@query("write_stage_tables", "library string, chr string, pos long, n long", ["reads"],
       "SELECT library, chr, pos, count(*) AS n FROM reads GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "stage")
    counts = t.reads().groupBy("library", "chr", "pos").agg(F.count(F.lit(1)).alias("n"))
    text.write_stage(counts, path)
    return t.spark.read.parquet(path)


@query("drop_malformed_rows", "value string", ["features"], """
SELECT 'doc_id' || chr(9) || 'lang' || chr(9) || 'source' AS value
UNION ALL SELECT doc_id || chr(9) || lang || chr(9) || source FROM features WHERE NOT toxic""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "lines")
    extra = F.when(F.col("toxic"), "\tstray").otherwise("")
    body = t.features().select(F.concat(F.concat_ws("\t", "doc_id", "lang", "source"), extra).alias("value"))
    head = t.spark.createDataFrame([("doc_id\tlang\tsource",)], "value string")
    head.unionByName(body).write.text(path)
    return text.drop_malformed(t.spark, path, "doc_id\t")
