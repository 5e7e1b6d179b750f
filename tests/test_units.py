"""Hand-made tables for branches the fixtures hardly reach."""

from pyspark.sql import functions as F

from immunoscan.functions import matrices
from immunoscan.operators import assays, innate, learning, motifs, patches, peptides, structure, tcell, tracks
from immunoscan.sources import files

SEQ = "MKTAYIAKQRQISFVKSHFSRQLEEALCLSLHRALQ"


def seqs(spark, *texts):
    return spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "seq_id long, seq string, n long")


def test_track_centres_and_mean(spark):
    rows = tracks.track(seqs(spark, SEQ), ["parker"]).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(4, 34))
    first = [-4.2, 5.7, 5.2, 2.1, -1.9, -8.0, 2.1]
    assert abs(rows[0]["score"] - sum(first) / 7) < 1e-6


def test_product_track_has_mean_one(spark):
    rows = tracks.track(seqs(spark, SEQ), ["emini"]).collect()
    assert len(rows) == len(SEQ) - 5 and abs(sum(r["score"] for r in rows) / len(rows) - 1) < 1e-5


def test_short_sequence_gives_no_track(spark):
    assert tracks.track(seqs(spark, "ACDE")).count() == 0


def test_constant_sequence_is_one_region(spark):
    rows = tracks.regions(seqs(spark, "A" * 20), ["parker"]).collect()
    assert [(r["start"], r["end"]) for r in rows] == [(4, 17)]


def test_kmers_and_stride(spark):
    s = seqs(spark, SEQ, "ACD")
    assert peptides.kmers(s, 9).count() == len(SEQ) - 8
    assert peptides.stride(15, 1) == 15 and peptides.stride(15, 14) == 2 and peptides.stride(9, 9) == 1


def test_allele_name(spark):
    df = spark.createDataFrame([("a0201",), ("HLA-A*02:01",), ("DRB1*01:01",)], "a string")
    assert [r[0] for r in df.select(peptides.allele_name(F.col("a"))).collect()] == ["HLA-A*02:01", "HLA-A*02:01", "HLA-DRB1*01:01"]


def test_motif_positions(spark):
    rows = motifs.find(seqs(spark, "AAKRKAAHHH"), "basic_patch", motifs.PATTERNS["basic_patch"]).orderBy("start").collect()
    assert [(r["start"], r["end"], r["motif"]) for r in rows] == [(3, 5, "KRK"), (8, 10, "HHH")]


def test_glycosylation_kinds(spark):
    rows = {(r["pos"], r["site_type"]) for r in motifs.n_glycosylation(seqs(spark, "ANATNPSNACN")).collect()}
    assert rows == {(2, "canonical"), (5, "proline"), (8, "cysteine")}


def test_gap_regions_bridge_two(spark):
    on = {2, 3, 6, 10, 11, 12, 20, 24}
    rows = [("s", i, float(i), i in on, 1.0 if i != 11 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "structure_id string, idx long, score double, called boolean, x double").withColumns({"y": F.lit(2.0), "z": F.lit(3.0)})
    got = {(r["start"], r["end"], r["above"], r["score"], r["x"]) for r in structure.gap_regions(df).collect()}
    assert got == {(2, 6, 3, 4.0, 1.0), (10, 12, 3, 11.0, None)}


def test_chain_split_takes_the_longest_other_chain(spark):
    rows = [(1, "H", "Fab heavy chain", 220), (1, "A", "lysozyme", 129), (1, "B", "lysozyme", 129), (1, "C", "Fc receptor antibody", 60), (2, "A", "lysozyme", 129), (3, "H", "IgG", 200), (3, "A", "toxin", 49), (4, "H", "Kappa", 99), (4, "A", None, 80)]
    got = {tuple(r) for r in structure.chain_split(spark.createDataFrame(rows, "structure_id long, chain_id string, description string, length long")).collect()}
    assert got == {(1, "H", "B", 129), (4, "H", "A", 80)}


def test_interface_counts_touching_residues(spark):
    atoms = [("s", "H", 0, 0.0, 0.0, 0.0)] + [("s", "A", i, float(i), 0.0, 0.0) for i in range(1, 7)] + [("t", "H", 0, 0.0, 0.0, 0.0), ("t", "A", 1, 1.0, 0.0, 0.0), ("s", "A", 9, None, None, None)]
    df = spark.createDataFrame(atoms, "structure_id string, chain_id string, idx long, x double, y double, z double")
    assert {tuple(r) for r in structure.interface(df).collect()} == {("s", i) for i in range(1, 5)}


def test_caller_window_threshold_and_length(spark):
    s = seqs(spark, SEQ)
    assert [r["pos"] for r in tracks.track(s, ["parker"], 5).orderBy("pos").collect()] == list(range(3, len(SEQ) - 1))
    high = tracks.regions(s, ["parker"], least=1, window=5, threshold=100.0)
    low = tracks.regions(s, ["parker"], least=1, window=5, threshold=-100.0)
    assert high.count() == 0 and [(r["start"], r["end"]) for r in low.collect()] == [(3, len(SEQ) - 2)]
    assert {r["threshold"] for r in tracks.thresholds(s, threshold=0.7).collect()} == {0.7}


def test_short_sequences_have_empty_summaries_and_no_votes(spark):
    s = seqs(spark, "ACD", "A")
    assert {(r["top"], r["low"], r["mean"]) for r in tracks.summaries(s).collect()} == {(0.0, 0.0, 0.0)}
    assert sorted((r["seq_id"], r["pos"], r["votes"]) for r in tracks.votes(s).collect()) == [(0, 1, 0), (0, 2, 0), (0, 3, 0), (1, 1, 0)]


def test_votes_count_methods(spark):
    s = seqs(spark, SEQ * 3)
    spans = [(r["start"], r["end"]) for r in tracks.regions(s).collect()]
    assert {r["pos"]: r["votes"] for r in tracks.votes(s).collect()} == {p: sum(a <= p <= b for a, b in spans) for p in range(1, 3 * len(SEQ) + 1)}


def test_fasta_records(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nMK T\n\nAY\n>two\r\nAC\r\n>\nGG\n>empty\n")
    (tmp_path / "b.fa").write_text("MKT\nAYI\n")
    got = {(r["name"], r["seq"], r["reason"]) for r in files.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {("one", "MKTAY", None), ("two", "AC", None), ("", "GG", "no name"), ("empty", "", "no letters"), ("Sequence_1", "MKTAYI", None)}


def test_keyed_assays_with_commas(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Description,peptide,IC50,allele\n,SIINFEKL,12.5,HLA-A*02:01\nACDEFGHIK,,x,HLA-A*02:01\nacdefghik,,7,HLA-B*07:02\nACX,,1,\n")
    got = sorted(tuple(r) for r in files.read_keyed(spark, str(tmp_path)).collect())
    assert got == [("ACDEFGHIK", "HLA-B*07:02", 7.0), ("SIINFEKL", "HLA-A*02:01", 12.5)]
    assert files.read_keyed(spark, str(tmp_path), "HLA-A*02:01").count() == 1


def test_matrix_lengths_and_binders(spark):
    two = matrices.CLASS_ONE["HLA-A*02:01"]
    assert [len(matrices.anchored(two, k)) for k in (8, 9, 10, 11)] == [8, 9, 10, 11] and matrices.anchored(two, 10)[4] == matrices.anchored(two, 10)[5]
    rows = tcell.binders(seqs(spark, "ALAAAAAAV"), "HLA-A*02:01").collect()
    assert [(r["start"], r["end"], r["score"]) for r in rows] == [(1, 9, 3.65)]


def test_log_odds_take_defaults(spark):
    odds = spark.createDataFrame([("x", 2, "L", 2.0), ("x", 0, "V", 2.2), ("x", 1, "G", 0.3)], "allele string, place int, aa string, value double")
    peps = spark.createDataFrame([("x", "GLAAAAAAV"), ("x", "AAAAAAAAA"), ("y", "GLAAAAAAV")], "allele string, peptide string")
    assert {r["peptide"]: r["score"] for r in tcell.log_odds_affinity(peps, odds).collect()} == {"GLAAAAAAV": 8.55, "AAAAAAAAA": -2.0}


def test_merge_keeps_the_better_of_overlapping(spark):
    spans = [(1, 11, 40), (3, 13, 40), (5, 15, 50), (14, 24, 45), (16, 26, 36), (30, 40, 36)]
    df = spark.createDataFrame([(spans,)], f"x array<{innate.MERGED}>")
    got = df.select(innate.merged(F.col("x")).alias("m")).first()["m"]
    assert [tuple(r) for r in got] == [(5, 15, 50), (16, 26, 36), (30, 40, 36)]


def test_short_sequences_have_no_signal(spark):
    r = innate.signal_rules(seqs(spark, "MKK")).first()
    assert (r["is_signal"], r["cleavage_position"], r["confidence"], r["h_score"]) == (False, None, 0.0, 0.0)


def test_patches_link_in_chains(spark):
    rows = [("s", i, "A", 30.0, 9.0 * i, 0.0, 0.0) for i in range(6)] + [("s", 10, "A", 30.0, 200.0, 0.0, 0.0), ("s", 11, "A", 30.0, None, None, None), ("t", 0, "A", 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "structure_id string, idx long, aa string, sasa double, x double, y double, z double")
    assert {tuple(r) for r in patches.patches(df).collect()} == {("s", i, 0) for i in range(6)}
    scores = {(r["structure_id"], r["idx"]): r["score"] for r in patches.patch_propensity(df)[0].collect()}
    assert scores["t", 0] == -1.5 and scores["s", 10] == scores["s", 0] - 0.5


def test_depth_beyond_the_first_cells(spark):
    rows = [("s", 0, 90.0, 0.0, 0.0, 0.0), ("s", 1, 1.0, 7.0, 0.0, 0.0), ("s", 2, 1.0, 100.0, 0.0, 0.0), ("s", 3, 1.0, 30.0, 0.0, 0.0), ("u", 0, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "structure_id string, idx long, sasa double, x double, y double, z double")
    assert {(r["structure_id"], r["idx"]): r["depth"] for r in structure.residue_depth(df).collect()} == {("s", 0): 0.0, ("s", 1): 7.0, ("s", 2): 100.0, ("s", 3): 30.0}


def test_selection_relaxes_the_cap(spark):
    rows = [(i, "a" if i < 12 else "b", 100 - i) for i in range(20)]
    df = spark.createDataFrame(rows, "seq_id long, organism string, matched long")
    order = [F.desc("matched"), F.col("seq_id")]
    assert assays.capped(df, "organism", order, 6, 10, 12).count() == 12
    assert {r["organism"]: r["count"] for r in assays.capped(df, "organism", order, 6, 10, 50).groupBy("organism").count().collect()} == {"a": 10, "b": 8}


def test_encodings_have_their_sizes(spark):
    df = spark.createDataFrame([("ACDEFGHIK",), ("ACDEFGHIKLM",)], "p string")
    r = df.select(F.size(learning.encode_padded(F.col("p"))).alias("a"), F.size(learning.encode_anchored(F.col("p"))).alias("b"), F.size(learning.encode_core(F.substring("p", 1, 9))).alias("c")).distinct().collect()
    assert [tuple(x) for x in r] == [(485, 360, 125)]
    assert learning._nine(8) == [1, 2, 3, 4, 5, 0, 6, 7, 8] and learning._nine(11) == [1, 2, 3, 4, 5, 7, 9, 10, 11]
