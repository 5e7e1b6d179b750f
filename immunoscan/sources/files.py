"""Text formats: FASTA, assay dumps by position or by header, score tables, nested predictions.

Writers go to a new folder in the shared place and return its path; Spark writes and reads the files in parallel.
"""

from __future__ import annotations

import io
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import METHODS
from ..operators import tracks as T
from ..operators.arrays import half_up
from ..operators.settle import new_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

# Places of columns in the positional dump, from 0, and its width.
COLUMNS = {"peptide": 11, "assay": 91, "qual": 94, "inequality": 95, "quant": 96, "allele": 107}
WIDTH = 108
# Names that a column may have, the first that is filled counts.
ALIASES = {"peptide": ["Description", "Epitope", "peptide"], "ic50": ["Quantitative measurement", "IC50", "ic50_nM"], "allele": ["Allele Name", "MHC Allele", "allele"]}
CODEC = "gzip"  # a row a residue as text is some thirty times the documents' own size
LEVEL = 4  # of the score tables: a tenth more bytes than the usual level, in a third of its time
SCORE_ROWS = 4_000_000  # rows of a score file at most
HEADERS = [["Epitope"] * WIDTH, ["Name"] * WIDTH]


def write_fasta(seqs: DataFrame, width: int = 60) -> str:
    path = new_folder(seqs.sparkSession, "fasta")
    body = F.regexp_replace("seq", f"(.{{{width}}})", "$1\n")
    seqs.select(F.concat(F.lit(">"), "name", F.lit(" "), F.coalesce("organism", F.lit("")), F.lit("\n"), body)).write.text(path)
    return path


FASTA_BREAK = "\n>"  # a record starts at a mark at the start of a line; a mark within a line is text


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, reason of ``records`` of all files."""
    return records(spark.read.option("lineSep", FASTA_BREAK).text(path).select("value", F.col("_metadata.file_path").alias("file")))


def records(raw: DataFrame) -> DataFrame:
    """name, seq, reason: one record a row of ``raw`` (value, file), which holds whole files split at FASTA_BREAK. The name is the header's first
    word; blanks and empty lines go. A file without a header is one record, Sequence_1. A header without a name, or nothing
    under one, gets a reason."""
    raw = raw.select(F.regexp_replace("value", "\r", "").alias("value"), "file")
    marked = F.startswith("value", F.lit(">"))
    files = raw.groupBy("file").agg(((F.count("*") == 1) & ~F.bool_or(marked)).alias("bare"))
    rows = raw.where(F.trim(F.regexp_replace("value", "\n", "")) != "").join(files, "file").withColumn("value", F.when(marked, F.substr("value", F.lit(2))).otherwise(F.col("value")))
    head = F.substring_index("value", "\n", 1)
    text = F.when(F.col("bare"), F.col("value")).otherwise(F.substr("value", F.length(head) + 1))
    name = F.when(F.col("bare"), "Sequence_1").otherwise(F.regexp_extract(head, r"^\s*(\S*)", 1))
    out = rows.select(name.alias("name"), F.regexp_replace(text, r"\s", "").alias("seq"))
    return out.select("name", "seq", F.when(F.col("name") == "", "no name").when(F.col("seq") == "", "no letters").alias("reason"))


def write_positional(assays: DataFrame) -> str:
    """``assays`` as rows of WIDTH columns under two header rows; every 17th record is cut short."""
    path = new_folder(assays.sparkSession, "positional")
    filled = {COLUMNS["peptide"]: F.col("peptide"), COLUMNS["assay"]: F.col("rec_id").cast("string"), COLUMNS["qual"]: F.col("qual"), COLUMNS["quant"]: F.col("quant"), COLUMNS["allele"]: F.col("allele")}
    cells = [filled.get(i, F.lit("")) for i in range(WIDTH)]
    lines = assays.select(F.when(F.col("rec_id") % 17 == 0, F.concat_ws(",", *cells[:20])).otherwise(F.concat_ws(",", *cells)).alias("value"))
    heads = assays.sparkSession.createDataFrame([(",".join(h),) for h in HEADERS], "value string")
    lines.unionByName(heads).write.text(path)
    return path


def read_positional(spark: SparkSession, path: str) -> DataFrame:
    """The columns of COLUMNS, trimmed. Header rows, and rows too short to have an allele or without a peptide, are left out."""
    schema = ", ".join(f"c{i} string" for i in range(WIDTH))
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    out = raw.select(*[F.trim(f"c{i}").alias(name) for name, i in COLUMNS.items()])
    return out.where(F.col("allele").isNotNull() & F.col("peptide").isNotNull() & ~F.col("peptide").isin(*[h[0] for h in HEADERS]))


def write_keyed(assays: DataFrame) -> str:
    path = new_folder(assays.sparkSession, "keyed")
    assays.select(F.col("organism").alias("Source"), F.col("peptide").alias("Epitope"), F.col("quant").alias("IC50"), F.col("allele").alias("MHC Allele")).write.csv(path, sep="\t", header=True)
    return path


def read_keyed(spark: SparkSession, path: str, allele: str | None = None, shortest: int = 8, longest: int = 11) -> DataFrame:
    """peptide, allele, ic50 of the rows with standard peptides and a number. The delimiter is a tab if the header has one."""
    head = spark.read.text(path).first()
    raw = spark.read.csv(path, sep="\t" if head and "\t" in head[0] else ",", header=True)

    def named(kind):
        there = [F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")) for c in ALIASES[kind] if c in raw.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    out = raw.select(F.upper(F.trim(named("peptide"))).alias("peptide"), named("allele").alias("allele"), named("ic50").try_cast("double").alias("ic50"))
    out = out.where(F.col("peptide").rlike(f"^[ACDEFGHIKLMNPQRSTVWY]{{{shortest},{longest}}}$") & F.col("ic50").isNotNull())
    return out if allele is None else out.where(F.col("allele").isNull() | F.contains(F.replace("allele", F.lit("HLA-"), F.lit("")), F.lit(allele.replace("HLA-", ""))))


WRITTEN = "rows long"


def _scores_writer(path: str, rows: int = SCORE_ROWS):
    """Writes batches of scores as compressed CSV files of so many rows with a header; gives how many rows. Files have the task's number and get their
    names when the task is done, so a task that runs again replaces what it wrote."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        task, mark = TaskContext.get().partitionId(), uuid.uuid4().hex
        made, out, packer, size, total = [], None, None, 0, 0

        def closed():
            out.write(packer.flush())
            out.close()

        for batch in batches:
            cells = [half_up(np.rint(pc.fill_null(c, 0.0).to_numpy() * 1e6).astype(np.int64), 100) / 1e4 for c in batch.columns[3:]]
            cells = [pa.array(v, mask=pc.is_null(c).to_numpy(zero_copy_only=False)) for v, c in zip(cells, batch.columns[3:], strict=True)]
            table = pa.RecordBatch.from_arrays([*batch.columns[:3], *cells], names=batch.schema.names)
            at = 0
            while at < table.num_rows:
                if out is None:
                    store.create_dir(root, recursive=True)
                    made.append(f"part-{task:05d}-{len(made):05d}.csv.gz")
                    out, packer, size = store.open_output_stream(f"{root}/.{mark}-{made[-1]}", compression=None), zlib.compressobj(LEVEL, wbits=31, memLevel=9), 0
                part = table.slice(at, rows - size)
                text = io.BytesIO(b"" if size else (",".join(table.schema.names) + "\n").encode())
                text.seek(0, io.SEEK_END)
                csv.write_csv(part, text, csv.WriteOptions(include_header=False, quoting_style="none", batch_size=1 << 16))
                out.write(packer.compress(text.getbuffer()))
                at, size, total = at + part.num_rows, size + part.num_rows, total + part.num_rows
                if size == rows:
                    closed()
                    out = None
        if out is not None:
            closed()
        for name in made:
            if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                store.delete_file(f"{root}/{name}")
            store.move(f"{root}/.{mark}-{name}", f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["rows"])

    return run


def write_scores(wide: DataFrame) -> str:
    """seq_id, pos, aa and a column a method, given with six decimals, as CSV with four, missing as empty."""
    path = new_folder(wide.sparkSession, "scores")
    wide.mapInArrow(_scores_writer(path), WRITTEN).agg(F.sum("rows")).first()
    return path


def write_aligned(seqs: DataFrame) -> str:
    """``write_scores`` of all tracks of the sequences; rows are made and written in the same tasks."""
    path = new_folder(seqs.sparkSession, "scores")
    T.aligned(seqs, then=_scores_writer(path), gives=WRITTEN).agg(F.sum("rows")).first()
    return path


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all files of a folder of ``write_scores``; each is read and parsed in blocks."""
    names = ["seq_id", "pos", "aa", *[m.replace("-", "_") for m in METHODS]]
    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.float64() for _ in METHODS]]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{file}", compression="gzip") as source:
                    options = csv.ConvertOptions(column_types=schema, include_columns=names)
                    yield from csv.open_csv(source, csv.ReadOptions(use_threads=False, block_size=1 << 22), csv.ParseOptions(quote_char=False), options)

    ddl = ", ".join(f"{n} {'string' if k == pa.string() else 'long' if k == pa.int64() else 'double'}" for n, k in zip(names, kinds, strict=True))
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], ddl)  # no rows were written
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"))  # names only
    return files.mapInArrow(run, ddl)


PREDICTION = "seq_id long, name string, methods array<struct<method:string,threshold:double,positions:array<bigint>,scores:array<double>,epitopes:array<struct<start:bigint,end:bigint,sequence:string,score:double>>>>"


def write_predictions(seqs: DataFrame, methods: list[str]) -> str:
    """One object a sequence: for each method its threshold, positions, scores and epitopes."""
    path = new_folder(seqs.sparkSession, "predictions")
    kept = seqs.select("seq_id", "name", "n", "seq")
    T.predicted(kept, methods).select("seq_id", "name", F.array(*[F.struct(F.lit(m).alias("method"), *[F.col(f"{c}_{i}").alias(c) for c in ("threshold", "positions", "scores", "epitopes")]) for i, m in enumerate(methods)]).alias("methods")).write.json(path, compression=CODEC)
    return path


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).json(path)
