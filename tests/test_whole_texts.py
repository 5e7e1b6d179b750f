"""Documents of every length are read: the length bound holds for the curation chain only, and sums over very long texts stay exact."""

import duckdb
import pytest

from immunoscan.plans import catalogue
from immunoscan.sources import fixtures

SF = "/root/testdata/sf0.001"


def test_every_letter_of_every_document_is_read(spark):
    con = duckdb.connect()
    n = con.execute(f"select sum(length(regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'))) from '{SF}/documents.parquet'").fetchone()[0]
    assert catalogue.QUERIES["b1_residues"](spark, SF).count() == n


def test_ref_peptides_takes_whole_items(spark, tmp_path):
    spark.createDataFrame([(1, "ACDEFGHIKLMN" * 120), (2, "ACDEFGHIKLMN" * 3 + "ACD"), (3, "ACD"), (4, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = fixtures.ref_peptides(spark, str(tmp_path)).collect()
    assert len(got) == len({r["pep_id"] for r in got}) == 123 and {r["peptide"] for r in got} == {"ACDEFGHIKLMN"}


THRESHOLD_BY_MEAN = ["a8_epitope_rows", "b7_all_methods", "c1_votes", "c3_consensus_regions", "c4_coverage", "i2_method_rates", "i3_threshold_sweep", "i4_combined_evidence", "i5_distribution", "i9_ranking", "i10_histogram"]


@pytest.fixture(scope="module")
def longest(tmp_path_factory):
    """The longest documents of sf0.1, one of 100,000 letters more, and the benchmark that is planted in some of them."""
    where = str(tmp_path_factory.mktemp("longest"))
    con = duckdb.connect()
    con.execute(f"""copy (select * from (select * from '/root/testdata/sf0.1/documents.parquet' order by length(text) desc limit 1)
      union all select 1000000, repeat('ACDEFGHIKLMNPQRSTVWYRRKKDENSSTPLLLVVVAAA', 2500) || repeat('D', 4000), 'en', 'x', 0) to '{where}/documents.parquet'""")
    # passages of the long texts themselves: truth for the rates
    con.execute(f"""copy (select doc_id as item_id, substr(text, 3000, 400) as text from '{where}/documents.parquet' where text is not null) to '{where}/benchmark.parquet'""")
    return where


@pytest.mark.parametrize("name", THRESHOLD_BY_MEAN)
def test_very_long_documents(spark, longest, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{longest}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, longest).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want) > 0
    got, want = (x[cols].sort_values(cols, ignore_index=True).fillna(-9).astype(str) for x in (got, want))
    assert got.equals(want)
