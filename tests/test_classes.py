"""Pairs judged by classes: odd rows against the queries' SQL, and tables of many copies."""

import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_oracles import plain

from sourcegrain.operators import classes
from sourcegrain.plans import registry

duckdb = pytest.importorskip("duckdb")
KINDS = {"p_partkey": pa.int64(), "p_name": pa.string(), "p_brand": pa.string(), "p_type": pa.string(), "p_size": pa.int32()}


def write(folder, rows):
    pq.write_table(pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(KINDS.items())}), f"{folder}/part.parquet")
    return str(folder)


def both(spark, folder, name):
    df = registry.queries()[name](spark, folder)
    result = duckdb.execute(registry.oracle_sql()[name].replace("FROM part ", f"FROM '{folder}/part.parquet' ").replace("JOIN part ", f"JOIN '{folder}/part.parquet' ").replace("FROM part)", f"FROM '{folder}/part.parquet')"))
    names = [c[0] for c in result.description]
    return plain(df.collect(), df.columns), plain(result.fetchall(), names)


@pytest.mark.parametrize("name", ["scored_join_with_margin", "fuzzy_best_match", "title_similarity_pairs", "levenshtein_titles"])
def test_odd_rows(spark, tmp_path, name):
    """Null, empty and repeated values; keys that stand in several rows, groups and classes."""
    dice = random.Random(5)
    words = ["", None, "red ring", "red  ring", "ring red", "bolt", "blue bolt", "a", "red"]
    rows = [(dice.choice([None, *range(70)]), dice.choice(words), dice.choice(["x", "y", None]), dice.choice(["s", "t", "u", "v", None]), dice.choice([1, 2, 3, 4, 5, 6, 7, None])) for _ in range(90)]
    lone = [(1000 + k, "lone", f"z{k // 3}", "st"[k % 2], k % 5) for k in range(60)]
    got, wanted = both(spark, write(tmp_path, rows + lone), name)
    assert got == wanted
    assert wanted


@pytest.mark.parametrize(("name", "n"), [("scored_join_with_margin", 2), ("fuzzy_best_match", 60_002)])
def test_many_copies(spark, tmp_path, name, n):
    """3.6 billion pairs of copies in one brand; only their classes may meet."""
    rows = [(k, "red ring", "x", "s", 1) for k in range(60_000)] + [(100_001, "red rings", "y", "s", 1), (100_002, "red ring", "y", "s", 1)]
    began = time.monotonic()
    found = registry.queries()[name](spark, write(tmp_path, rows)).collect()
    assert len(found) == n
    assert time.monotonic() - began < 60
    if name == "fuzzy_best_match":
        best = {r["a_id"]: (r["b_id"], r["score"]) for r in found}
        assert (best[0], best[1], best[59_999], best[100_001]) == ((1, 1.0), (0, 1.0), (0, 1.0), (100_002, 0.888888889))


@pytest.mark.parametrize("name", ["title_similarity_pairs", "levenshtein_titles"])
def test_pairs_of_a_small_file_are_dealt_out(spark, tmp_path, name):
    """Few bytes make millions of pairs, which must not be one task's work."""
    rows = [(k, "red ring" if k % 2 else "red bolt", "x", "s", 1) for k in range(4000)]
    sizes = registry.queries()[name](spark, write(tmp_path, rows)).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sum(sizes) == 4000 * 3999 // 2
    assert max(sizes) < 0.6 * sum(sizes)


def test_partners_of_a_small_file_are_dealt_out(spark, tmp_path):
    """The rows of one file must not meet what their classes have found in one task."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows = [(k, "red ring", f"b{k % 5}", "st"[k % 2], k % 7) for k in range(4000)]
        part = spark.read.parquet(write(tmp_path, rows) + "/part.parquet")
        one = lambda a, b: F.when(a["p_size"] == b["p_size"], 1.0).otherwise(0.5)
        found = classes.best_partners(part, "p_brand", ["p_size", "p_type"], "p_partkey", one, 0.6, k=2)
        sizes = found.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    finally:
        spark.conf.set(key, before)
    assert sum(sizes) == 2 * 4000
    assert max(sizes) < 0.6 * sum(sizes)
