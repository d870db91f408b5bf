from pyspark.sql import functions as F

from assaygrid.operators import labels


def test_named_terms(spark):
    docs = spark.createDataFrame([(1, "CHEBI:1 and CHEBI:12, CHEBI:1"), (2, None), (None, "CHEBI:1"), (3, ""), (4, "CHEBI:9")], "id int, note string")
    names = spark.createDataFrame([("CHEBI:1", "water"), ("CHEBI:1", "aqua"), ("CHEBI:12", None)], "term string, name string")
    got = {r.id: r.note for r in labels.named_terms(docs, names, "id", "note").collect()}
    assert got == {1: "aqua and CHEBI:12, aqua", 2: None, None: "CHEBI:1", 3: "", 4: "CHEBI:9"}
    assert labels.named_terms(docs.where("false"), names, "id", "note").count() == 0


def test_texts_and_codes(spark):
    text = "a\r\nb  \nCell(A):-exhibits_phenotype(A,\nx). y."
    row = spark.createDataFrame([(text, None)], "t string, n string").select(
        labels.line_at(F.col("t"), 1), labels.line_at(F.col("t"), 9), labels.line_at(F.col("n"), 0), labels.first_clause(F.col("t")), labels.first_clause(F.lit("none.")),
        labels.relevance(F.col("t"), ["zz", "b", "x"]), labels.forest_assay(F.lit(1)), labels.forest_assay(F.lit(0)), labels.comparison(F.lit(7))["link"], labels.comparison(F.lit(9))["link"]).first()
    assert tuple(row) == ("b", None, None, "Cell(A):-exhibits_phenotype(A,\nx).", None, 3, 4, None, "Treatment=No, Supplement=NegHigh", None)
