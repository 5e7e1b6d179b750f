"""Views over the given tables that have the schemas of sequences, peptides, assays and structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import AA, NAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores is dealt out anew; one of more splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clean(text: Column, letters: str = AA) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), f"[^{letters}]", "")


def all_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    out = docs.select(F.col("doc_id").alias("seq_id"), F.concat(F.lit("doc_"), "doc_id").alias("name"), F.col("source").alias("organism"), "lang", clean(F.col("text")).alias("seq"))
    # one row each: a generator, which filters and projections of the views above don't move across, so texts are cleaned once
    out = out.select("seq_id", "name", "organism", "lang", F.explode(F.array("seq")).alias("seq"))
    return out.withColumn("n", F.length("seq").cast("long"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at least one letter."""
    return all_sequences(spark, sf_dir).where("n > 0")


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of the lengths that antigen sets are curated from."""
    return all_sequences(spark, sf_dir).where("n between 60 and 1800")


def nucleic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), clean(F.col("text"), "ACGT").alias("seq"))


def ref_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", clean(F.col("text")).alias("pep"))
    cut = items.where("length(pep) >= 12").select("item_id", "pep", F.explode(F.expr("sequence(0, cast(length(pep) div 12 as int) - 1)")).alias("i"))
    # from the 100th on, item_id * 100 + i would be an id of the next item
    pep_id = F.when(F.col("i") < 100, F.col("item_id") * 100 + F.col("i")).otherwise(-(F.col("item_id") * 1_000_000 + F.col("i")))
    return cut.select(pep_id.alias("pep_id"), F.col("item_id").alias("source_id"), F.expr("substr(pep, 1 + 12 * i, 12)").alias("peptide"))


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    size = table(spark, sf_dir, "documents").agg(F.count("*").alias("nd"))  # one row
    keyed = events.join(F.broadcast(size)).withColumn("seq_id", F.expr("event_id % nd"))
    heads = sequences(spark, sf_dir).select("seq_id", "organism", F.substring("seq", 1, 60).alias("seq"))  # peptides end at letter 55 at most
    both = keyed.join(heads, "seq_id")
    return both.selectExpr(
        "event_id as rec_id",
        "substr(seq, cast(1 + event_id % 40 as int), cast(8 + event_id % 9 as int)) as peptide",
        "case user_id % 4 when 0 then concat('HLA-A*', user_id) when 1 then concat('HLA-DRB1*', user_id) when 2 then concat('H-2-K', user_id) else concat('MAMU-', user_id) end as allele",
        "case when event_id % 3 = 0 then cast(value as string) else '' end as quant",
        "case event_type when 'purchase' then 'Positive-High' when 'click' then 'Positive-Intermediate' when 'view' then 'Positive-Low' when 'signup' then 'Positive' else 'Negative' end as qual",
        "organism",
        "concat('protein ', seq_id % 50) as source_mol",
        "seq_id",
        "1 + event_id % 40 as start",
    )


def residues3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("structure_id", F.expr("concat(label, '_', cast(floor(vec_id / 500) as int))"))
    e = e.withColumn("idx", F.row_number().over(Window.partitionBy("structure_id").orderBy("vec_id")).cast("long") - 1)
    at = lambda k: F.when(F.col("vec_id") % 37 != 0, 40 * F.col("embedding")[k].cast("double"))
    return e.select(
        "structure_id",
        F.expr("case when vec_id % 5 = 0 then 'H' else 'A' end").alias("chain_id"),
        "idx",
        "vec_id",
        F.expr(f"substr('{AA}', cast(1 + vec_id % 20 as int), 1)").alias("aa"),
        *[at(k).alias(c) for k, c in enumerate("xyz")],
        (400 * F.abs(F.col("embedding")[3].cast("double"))).alias("sasa"),
        (30 + 100 * F.col("embedding")[4].cast("double")).alias("bfactor"),
    )


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two atoms a residue: CA as it is, CB beside it."""
    res = residues3d(spark, sf_dir).select("structure_id", "chain_id", "idx", "x", "y", "z")
    kinds = F.explode(F.array(F.struct(F.lit("CA").alias("atom"), F.lit(0.0).alias("dx")), F.struct(F.lit("CB").alias("atom"), F.lit(1.5).alias("dx"))))
    return res.withColumn("k", kinds).select("structure_id", "chain_id", "idx", "k.atom", (F.col("x") + F.col("k.dx")).alias("x"), "y", "z")


def named_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms with residue names; some residues have no CA, some a name that is not standard."""
    letter = F.create_map(*[F.lit(x) for a, n in zip(AA, NAMES, strict=True) for x in (a, n)])
    res = residues3d(spark, sf_dir).select("structure_id", "chain_id", "idx", F.when(F.col("idx") % 29 == 0, "MSE").otherwise(letter[F.col("aa")]).alias("res_name"))
    return res.withColumn("atom", F.explode(F.when(F.col("idx") % 31 == 0, F.array(F.lit("CB"))).otherwise(F.array(F.lit("CA"), F.lit("CB")))))


def mined_assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assay records with the columns that antigens are mined from."""
    a = assays(spark, sf_dir)
    return a.select(
        "rec_id", F.when(F.col("rec_id") % 19 == 0, F.lower("peptide")).otherwise(F.col("peptide")).alias("peptide"), F.when(F.col("rec_id") % 13 != 0, F.col("start").cast("string")).otherwise("").alias("start"), (F.col("start") + F.length("peptide") - 1).cast("string").alias("end"),
        F.expr("case seq_id % 50 when 0 then '' when 1 then concat('Genome polyprotein ', seq_id % 7) when 2 then concat('Unknown ', seq_id % 7) else source_mol end").alias("source_mol"),
        F.expr("case when seq_id % 11 = 0 then 'http://example.org/none' else concat('http://www.ncbi.nlm.nih.gov/protein/AC_', seq_id % 40, '.1') end").alias("source_iri"),
        F.expr("case seq_id % 9 when 0 then 'Homo sapiens' when 1 then 'Mus musculus' else organism end").alias("organism"), F.when(F.col("rec_id") % 17 == 0, "").otherwise(F.col("qual")).alias("qual"),
    )


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "cast(floor(p_partkey / 4) as long) as structure_id",
        "char(65 + p_partkey % 4) as chain_id",
        "case p_partkey % 3 when 0 then 'immunoglobulin heavy chain' when 1 then 'antibody receptor' else 'lysozyme' end as description",
        "cast(p_size * 5 as long) as length",
    )


# The same views for DuckDB.
SQL = {
    "atoms": "atoms AS (SELECT structure_id, chain_id, idx, 'CA' AS atom, x, y, z FROM residues3d UNION ALL SELECT structure_id, chain_id, idx, 'CB', x + 15e-1, y, z FROM residues3d)",
    "chains": "chains AS (SELECT CAST(p_partkey // 4 AS BIGINT) AS structure_id, chr(CAST(65 + p_partkey % 4 AS INT)) AS chain_id, CASE p_partkey % 3 WHEN 0 THEN 'immunoglobulin heavy chain' WHEN 1 THEN 'antibody receptor' ELSE 'lysozyme' END AS description, CAST(p_size * 5 AS BIGINT) AS length FROM part)",
    "sequences": f"""sequences AS (SELECT doc_id AS seq_id, 'doc_' || doc_id AS name, source AS organism, lang, seq, length(seq) AS n FROM (SELECT *,
 regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{AA}]', '', 'g') AS seq FROM documents) WHERE length(seq) > 0)""",
    "ref_peptides": f"""ref_peptides AS (SELECT CASE WHEN i < 100 THEN item_id * 100 + i ELSE -(item_id * 1000000 + i) END AS pep_id, item_id AS source_id, substr(pep, 1 + 12 * i, 12) AS peptide FROM (SELECT item_id, pep, unnest(range(0, length(pep) // 12)) AS i FROM (SELECT item_id,
 regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{AA}]', '', 'g') AS pep FROM benchmark)))""",
    "assays": """assays AS (SELECT event_id AS rec_id, substr(seq, 1 + event_id % 40, 8 + event_id % 9) AS peptide,
 CASE user_id % 4 WHEN 0 THEN 'HLA-A*' || user_id WHEN 1 THEN 'HLA-DRB1*' || user_id WHEN 2 THEN 'H-2-K' || user_id ELSE 'MAMU-' || user_id END AS allele,
 CASE WHEN event_id % 3 = 0 THEN CAST(value AS VARCHAR) ELSE '' END AS quant,
 CASE event_type WHEN 'purchase' THEN 'Positive-High' WHEN 'click' THEN 'Positive-Intermediate' WHEN 'view' THEN 'Positive-Low' WHEN 'signup' THEN 'Positive' ELSE 'Negative' END AS qual,
 organism, 'protein ' || (seq_id % 50) AS source_mol, seq_id, 1 + event_id % 40 AS start
 FROM events CROSS JOIN (SELECT count(*) AS nd FROM documents) c JOIN sequences ON seq_id = event_id % nd)""",
    "residues3d": f"""residues3d AS (SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY vec_id) - 1 AS idx FROM (SELECT label || '_' || CAST(floor(vec_id / 500) AS INT) AS structure_id,
 CASE WHEN vec_id % 5 = 0 THEN 'H' ELSE 'A' END AS chain_id, vec_id, substr('{AA}', 1 + CAST(vec_id % 20 AS INT), 1) AS aa,
 CASE WHEN vec_id % 37 <> 0 THEN 40 * embedding[1]::double END AS x, CASE WHEN vec_id % 37 <> 0 THEN 40 * embedding[2]::double END AS y,
 CASE WHEN vec_id % 37 <> 0 THEN 40 * embedding[3]::double END AS z, 400 * abs(embedding[4]::double) AS sasa, 30 + 100 * embedding[5]::double AS bfactor FROM embeddings))""",
}
