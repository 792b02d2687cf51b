"""Cases beyond limits that once changed results: many queries, NULL series, repeated keys, clusters without a shared folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektorloom import session
from vektorloom.collections.store import Collections
from vektorloom.operators import index, search, telemetry
from vektorloom.operators.prompting import generate
from vektorloom.operators.spread import over_all_cores
from vektorloom.session import scratch_path


def vectors(spark, n, key):
    random = np.random.default_rng(n)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(random.normal(size=(n, 4)).round(3))]
    return spark.createDataFrame(rows, f"{key} long, vector array<float>")


def test_coded_search_of_many_queries(spark, monkeypatch):
    items, queries = vectors(spark, 50, "id"), vectors(spark, 90, "q_id")
    codes = index.ScalarCodes.train(items)
    coded = codes.encode(items, "vector")
    whole = index.coded_top_k(queries, coded, codes, items, 3, over_fetch=20)
    monkeypatch.setattr(search, "MAX_SCAN_QUERIES", 40)
    blocks = index.coded_top_k(queries, coded, codes, items, 3, over_fetch=20)
    key = lambda r: (r.q_id, r["rank"], r.id)
    assert sorted(map(key, blocks.collect())) == sorted(map(key, whole.collect()))


def test_codebooks_need_a_divisor(spark):
    with pytest.raises(ValueError):
        index.ProductCodes.train(vectors(spark, 20, "id"), 3)


def test_null_series(spark):
    rows = spark.createDataFrame([(None, 10, 5), (None, 30, 9), ("a", 10, 1)], "run string, at long, v long")
    got = {(r.run, r.at): r.seconds for r in telemetry.relative_seconds(rows, ["run"], "at", 1.0).collect()}
    assert got == {(None, 10): 0.0, (None, 30): 20.0, ("a", 10): 0.0}
    near = telemetry.with_neighbour(rows, ["run"], ["at"], {"v": "before"}, 15).collect()
    assert {(r.run, r.at): r.before for r in near} == {(None, 10): None, (None, 30): 5, ("a", 10): None}


def test_strict_pairs_refuse_repeated_keys(spark):
    store = Collections(spark, scratch_path(spark, "strict"), "strict_pairs_test")
    store.create("c", 4)
    items = vectors(spark, 3, "chunk_id")
    chunks = items.select("chunk_id", F.lit("x").alias("text"))
    with pytest.raises(ValueError, match="stands for"):
        store.insert_vectors("c", items.unionByName(items), chunks)


def test_generation_is_spread(spark):
    prompts = spark.range(200).coalesce(1).select(F.col("id").cast("string").alias("prompt"))
    made = generate(over_all_cores(prompts), lambda: lambda batch, _: batch)
    tasks = made.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_codebooks_hold_few_distances(monkeypatch):
    rows = np.random.default_rng(4).normal(size=(3000, 2))
    whole = index.lloyd(rows, 16, 5, 7)
    sizes, score = [], index.score_matrix
    monkeypatch.setattr(index, "HELD_DISTANCES", 1600, raising=False)
    monkeypatch.setattr(index, "score_matrix", lambda metric, a, b: sizes.append(len(a) * len(b)) or score(metric, a, b))
    assert np.allclose(index.lloyd(rows, 16, 5, 7), whole) and max(sizes) <= 1600
