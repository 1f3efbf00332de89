"""The queries on literal records read their inputs."""

from pyspark.sql import functions as F

from sourcegrain.functions import text
from sourcegrain.plans import record_queries


def test_normal_forms_reads_its_doi(spark, monkeypatch):
    assert record_queries.normal_forms(spark).first()["doi"] == "10.1/q"
    monkeypatch.setattr(record_queries.text, "normalize_doi", lambda c: F.concat(F.lit("of "), c))
    assert record_queries.normal_forms(spark).first()["doi"] == "of https://doi.org/10.1/Q)."


def test_doi_forms(spark):
    rows = [("https://doi.org/10.1/Q).", "10.1/q", ""), ("see https://doi.org/10.1000/Q).", "see https://doi.org/10.1000/q", "10.1000/q"), ("DOI:10.18653/v1/P19-1,", "10.18653/v1/p19-1", "10.18653/v1/p19-1")]
    df = spark.createDataFrame(rows, "given string, normal string, found string")
    for r in df.select("*", text.normalize_doi(F.col("given")).alias("n"), text.extract_doi(F.col("given")).alias("f")).collect():
        assert (r["n"], r["f"]) == (r["normal"], r["found"])
