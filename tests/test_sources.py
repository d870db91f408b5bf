import pytest
from pyspark.sql import functions as F

from assaygrid.operators import dosing
from assaygrid.sources import files


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path.parent)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reader_files(spark, tmp_path):
    d = write(tmp_path / "r" / "AUTOMATED1.txt", "Date: 03/02/2024  Time: 10:20:30\nA01: 9\nMeasurement Data\nA01: 0.5\nH12: 1\nI01: 2\nA02: x\n===\n\n")
    (tmp_path / "r" / "OTHER.txt").write_text("Measurement Data\nA01: 1\n")
    got = files.reader_files(spark, d).collect()
    assert [(r.well, r.od, str(r.file_time)) for r in got] == [("A01", 0.5, "2024-02-03 10:20:30"), ("H12", 1.0, "2024-02-03 10:20:30")]


def test_log_pairing(spark, tmp_path):
    lines = ["process_well() ( 1, 2 )", "x, t = 0.5", "y, t = 0.4", "process_well() ( 1, 3 )", "process_well() ( 2, 4 )", ", t = 0.512", "process_well() ( 1000, 1 )", ", t = 0.1", "process_well() ( 3, 1 )", ", t = 0.9"]
    d = write(tmp_path / "log" / "a.txt", "\n".join(lines))
    got = dosing.paired_timings(files.instrument_log(spark, d)).collect()
    assert [(r.well, r.t) for r in got] == [("A2", 0.5), ("B4", 0.512)]


def test_facts_and_matrix(spark, tmp_path):
    d = write(tmp_path / "f" / "t.dl", "% c\ncompound_modulates_target('v,1','inhibits','YAL').\nother('x').\n")
    assert rows(files.facts(spark, d, "compound_modulates_target", ["value", "action", "gene"])) == [("v,1", "inhibits", "YAL")]
    d = write(tmp_path / "m" / "x.txt", "1 0 1\n0 1 0\n")
    assert rows(files.feature_matrix(spark, d, "G")) == [(0, "G_ilp0"), (0, "G_ilp2"), (1, "G_ilp1")]
    d = write(tmp_path / "e" / "G.txt", "[pos cover = 233 neg cover = 0]\nfeature(3,(gene(A):-p(A,'x'))).\n")
    assert [(r.id, r.pos_cover, r.clause) for r in files.explanations(spark, d).collect()] == [(3, 233, "gene(A):-p(A,'x')")]


def test_quads_round_trip(spark, tmp_path):
    d = write(tmp_path / "q" / "a.nq", '<s> <p> "a \\"b\\""@en <g> .\n<s> <p> _:b <g> .\n_:b <p> "1.5"^^<x:float> <g> .\nnot a quad\n')
    with pytest.raises(Exception, match="no quad: not a quad"):
        files.n_quads(spark, d).collect()
    assert [r.value for r in files.unreadable(spark, d).collect()] == ["not a quad"]
    store = files.n_quads(spark, d, strict=False)
    assert sorted((r.o_kind, r.o_lang or "", r.o_dtype or "") for r in store.collect()) == [("blank", "", ""), ("literal", "", "x:float"), ("literal", "en", "")]
    assert {r.o for r in store.where("o_kind = 'blank'").collect()} == {r.s for r in store.where("o_dtype is not null").collect()}
    files.write_n_quads(store, str(tmp_path / "out"))
    assert files.n_quads(spark, str(tmp_path / "out")).count() == 3
    name = "_:" + "b" * 5000
    d = write(tmp_path / "r" / "a.nq", f"<s> <p> {name}1 .\n<s> <p> {name}2 .\n# a comment\n\n")
    store = files.n_quads(spark, d)
    assert {r.g for r in store.collect()} == {""} and len({r.o for r in store.collect()}) == 2
    files.write_n_quads(store, str(tmp_path / "out2"))
    assert all(r.g == "" for r in files.n_quads(spark, str(tmp_path / "out2")).collect())


def test_lookups_and_lists(spark, tmp_path):
    assert rows(files.id_map(spark, write(tmp_path / "i" / "m.tsv", "From\tTo\nP1\tsce:YAL\n"))) == [("P1", "YAL")]
    assert rows(files.orf_names(spark, write(tmp_path / "o" / "m.tsv", "x\tYAL\ty\tname\n"))) == [("YAL", "name")]
    assert rows(files.delimited(spark, write(tmp_path / "d" / "t.tsv", "a\tb\n1\tx\n"), "a int, b string")) == [(1, "x")]
    genes = spark.createDataFrame([("b",), ("a",), ("c",)], "gene string")
    files.write_examples(genes, str(tmp_path / "g"), "c")
    assert [r.gene for r in files.examples(spark, str(tmp_path / "g"), "c").collect()] == ["c", "a", "b"]
    files.write_result(genes, str(tmp_path / "t"))
    assert sorted(r.gene for r in spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).collect()) == ["a", "b", "c"]
    files.write_stage(genes, str(tmp_path / "s"))
    files.append_lines(genes.select(F.col("gene").alias("line")), str(tmp_path / "l"))
    files.append_lines(genes.select(F.col("gene").alias("line")), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3 and spark.read.text(str(tmp_path / "l")).count() == 6


def test_runs_can_be_repeated(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    at = str(tmp_path / "runs")
    for run, got in (("one", lines("a", "b")), ("two", lines("c")), ("one", lines("a", "d")), ("two", lines("c"))):
        files.append_lines(got, at, run)
    assert sorted((r.run, r.value) for r in spark.read.text(at).collect()) == [("one", "a"), ("one", "d"), ("two", "c")]


def test_protocols_and_records(spark, tmp_path):
    d = write(tmp_path / "p" / "a.json", '{"logic_program": "l", "experiments": [\n{"experiment": 1, "treatment": null}, {"experiment": 2, "treatment": "x"}]}')
    assert [(r.experiment, r.treatment) for r in files.protocols(spark, d).orderBy("experiment").collect()] == [(1, None), (2, "x")]
    files.write_records(files.protocols(spark, d).select("experiment", "treatment"), str(tmp_path / "o"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == ['{"experiment":1}', '{"experiment":2,"treatment":"x"}']
    write(tmp_path / "h" / "arg_202503131539" / "hypothesis_details.json", '{"observable": "o"}')
    assert str(files.hypotheses(spark, str(tmp_path / "h")).first().created) == "2025-03-13 15:39:00"


def test_reference_library(spark):
    flat = spark.createDataFrame([("m", "C", "H", 1.0, 2.0), ("m", "C", "Na", 1.5, 2.5)], "molecule string, formula string, adduct string, precursor_mz double, ccs double")
    assert [files.reference_library(flat)[k].count() for k in ("molecules", "ions", "ccs_values")] == [1, 2, 2]
