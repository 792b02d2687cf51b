import re

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from vektorloom.functions import vectors as vx
from vektorloom.operators import embedding, index, late_interaction, search
from vektorloom.operators.late_interaction import candidate_documents, fetch_documents, max_sim
from vektorloom.operators.rerank import pairs_of_lists, rerank

DIM = 8


def frame(spark, matrix, key="id"):
    rows = [(i, v.tolist() if v is not None else None) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} long, vector array<float>")


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(3)
    items = draw.normal(size=(300, DIM)).astype(np.float32)
    items[50] = items[40]  # a tie
    queries = draw.normal(size=(7, DIM)).astype(np.float32)
    queries[0] = items[40]
    return frame(spark, items), frame(spark, queries, "q_id"), items.astype(float), queries.astype(float)


def brute(items, queries, k, metric):
    scores = np.round(vx.score_matrix(metric, queries, items), 6)
    sign = -1 if vx.LARGER_FIRST[metric] else 1
    out = []
    for q, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda i: (sign * row[i], i))[:k]
        out += [(q, rank, i, row[i]) for rank, i in enumerate(order)]
    return out


def rows_of(hits):
    return [(r.q_id, r.rank, r.id, r.score) for r in hits.orderBy("q_id", "rank").collect()]


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("strategy", ["scan", "grid"])
def test_top_k_equals_brute_force(data, metric, strategy, monkeypatch):
    monkeypatch.setattr(search, "ITEM_TILE_BYTES", 64 * 8 * DIM)
    monkeypatch.setattr(search, "QUERY_TILE_BYTES", 3 * 8 * DIM)
    collection, queries, items, asked = data
    got = rows_of(search.similarity_top_k(queries, collection.repartition(5), 6, metric, strategy=strategy))
    want = brute(items, asked, 6, metric)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_many_queries_take_the_grid(data, monkeypatch):
    collection, queries, items, asked = data
    monkeypatch.setattr(search, "MAX_SCAN_QUERIES", 3)
    got = rows_of(search.similarity_top_k(queries, collection, 4))
    assert [g[:3] for g in got] == [w[:3] for w in brute(items, asked, 4, "l2")]
    with pytest.raises(ValueError):
        search.similarity_top_k(queries, collection, 4, strategy="scan")


def test_expressions_agree_with_blocks(spark, data):
    collection, queries, items, asked = data
    pairs = queries.select("q_id", F.col("vector").alias("q")).join(collection)
    for metric in vx.LARGER_FIRST:
        rows = pairs.select("q_id", "id", vx.score(metric, "q", "vector").alias("s")).collect()
        matrix = vx.score_matrix(metric, asked, items)
        assert all(abs(matrix[r.q_id, r.id] - r.s) < 1e-6 for r in rows)


def test_fewer_items_than_k(spark, data):
    _, queries, _, _ = data
    small = frame(spark, [np.ones(DIM, dtype=np.float32), None, np.zeros(DIM, dtype=np.float32)])
    assert search.similarity_top_k(queries, small, 10).count() == 7 * 2
    # a vector without direction has no cosine
    assert search.similarity_top_k(queries, small, 10, "cosine").count() == 7


def test_no_queries_give_no_hits(spark, data):
    collection, queries, _, _ = data
    none = queries.where("q_id < 0")
    cells = index.Cells(np.zeros((2, DIM)), "l2")
    codes = index.ScalarCodes.train(collection)
    for hits in (
        search.similarity_top_k(none, collection, 3),
        search.similarity_top_k(none, collection, 3, strategy="grid"),
        search.similarity_top_k(queries, collection.where("id < 0"), 3),
        search.similarity_top_k(queries, collection.where("id < 0"), 3, strategy="grid"),
        index.probe_top_k(none, cells.assign(collection), cells, 3),
        index.probe_top_k(none, cells.assign(collection), cells, 3, strategy="grid"),
        index.coded_top_k(none, codes.encode(collection), codes, collection, 3),
    ):
        assert hits.count() == 0


def test_wrong_length_raises(spark, data):
    _, queries, _, _ = data
    with pytest.raises(Exception, match="expected 8"):
        search.similarity_top_k(queries, frame(spark, [np.ones(3, dtype=np.float32)]), 1).collect()


def test_output_fields_and_report(spark, data):
    collection, queries, _, _ = data
    texts = collection.withColumn("text", F.concat(F.lit("t"), F.col("id")))
    hits = search.similarity_top_k(queries, texts, 2, output_fields=["text"])
    assert all(r.text == f"t{r.id}" for r in hits.collect())
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert {r.text_length for r in search.hit_report(hits).collect()} <= {2, 3, 4}


def test_partial_cut_before_the_shuffle(data):
    collection, queries, _, _ = data
    plan = search.similarity_top_k(queries, collection, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_cells_probe(spark, data, tmp_path):
    collection, queries, items, asked = data
    cells = index.Cells.train(collection, "l2", 8, 5)
    cells.assign(collection).write.partitionBy("cell").parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    assert stored.count() == 300
    exact = brute(items, asked, 5, "l2")
    for strategy in ("auto", "grid"):
        all_cells = rows_of(index.probe_top_k(queries, stored, cells, 5, nprobe=8, strategy=strategy))
        assert [g[:3] for g in all_cells] == [w[:3] for w in exact]
    some = rows_of(index.probe_top_k(queries, stored, cells, 5, nprobe=3))
    grid = rows_of(index.probe_top_k(queries, stored, cells, 5, nprobe=3, strategy="grid"))
    assert some == grid
    found = {(q, i) for q, _, i, _ in some} & {(q, i) for q, _, i, _ in exact}
    assert len(found) / len(exact) > 0.5


def test_probe_reads_only_probed_cells(spark, data, tmp_path):
    collection, queries, _, _ = data
    cells = index.Cells.train(collection, "l2", 8, 5)
    cells.assign(collection).write.partitionBy("cell").parquet(str(tmp_path / "cells"))
    plan = index.probe_top_k(queries.limit(1), spark.read.parquet(str(tmp_path / "cells")), cells, 5, nprobe=1)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(cell#\d+ = \d\)", text)


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_hot_cell_is_tiled(data, metric, monkeypatch):
    """All vectors in one cell: the tiles still give the exact answer."""
    monkeypatch.setattr(search, "ITEM_TILE_BYTES", 40 * 8 * DIM)
    monkeypatch.setattr(search, "QUERY_TILE_BYTES", 2 * 8 * DIM)
    collection, queries, items, asked = data
    cells = index.Cells(np.zeros((1, DIM)), metric)
    got = rows_of(index.probe_top_k(queries, cells.assign(collection), cells, 5, strategy="grid"))
    assert [g[:3] for g in got] == [w[:3] for w in brute(items, asked, 5, metric)]


@pytest.mark.parametrize("kind", ["sq", "pq"])
def test_codes_with_rescoring(data, kind):
    collection, queries, items, asked = data
    codes = index.ScalarCodes.train(collection) if kind == "sq" else index.ProductCodes.train(collection, 4, bits=5)
    coded = codes.encode(collection)
    assert coded.columns == ["id", "codes"]
    hits = rows_of(index.coded_top_k(queries, coded, codes, collection, 5, over_fetch=6))
    exact = brute(items, asked, 5, "l2")
    found = {(q, i) for q, _, i, _ in hits} & {(q, i) for q, _, i, _ in exact}
    assert len(found) / len(exact) > 0.85


def test_scalar_codes_span_the_range(spark):
    df = frame(spark, [np.array([0, 5.0]), np.array([1.0, 5.0]), np.array([0.5, 5.0])])
    codes = index.ScalarCodes.train(df)
    got = {r.id: r.codes for r in codes.encode(df).collect()}
    assert got == {0: [0, 0], 1: [255, 0], 2: [128, 0]}


def test_index_kinds():
    assert index.coding_of("IVF_HNSW_SQ") == "sq"
    assert index.coding_of("IVF_PQ") == "pq"
    assert index.coding_of("GPU_IVF_FLAT") is None
    with pytest.raises(ValueError):
        index.coding_of("HNSW")


@pytest.fixture(scope="module")
def late(spark):
    draw = np.random.default_rng(5)
    rows = [(d, s, draw.normal(size=DIM).tolist()) for d in range(12) for s in range(400 if d == 3 else 4)]
    tokens = [(q, s, draw.normal(size=DIM).tolist()) for q in range(3) for s in range(2)]
    return (
        spark.createDataFrame(tokens, "q_id long, q_seq long, vector array<float>"),
        spark.createDataFrame(rows, "doc_id long, seq_id long, vector array<float>").repartition(6),
        np.array([r[2] for r in rows], dtype=np.float32),
        np.array([r[0] for r in rows]),
        np.array([t[2] for t in tokens], dtype=np.float32),
    )


@pytest.mark.parametrize("strategy", ["auto", "tiles"])
def test_max_sim(late, strategy, monkeypatch):
    monkeypatch.setattr(search, "ITEM_TILE_BYTES", 90 * 8 * DIM)  # the hot document needs several tiles
    monkeypatch.setattr(search, "QUERY_TILE_BYTES", 2 * 8 * DIM)
    tokens, rows, matrix, docs, asked = late
    candidates = candidate_documents(tokens, rows, 10)
    got = max_sim(tokens, rows, candidates, 3, digits=4, strategy=strategy).orderBy("q_id", "rank").collect()
    for q in range(3):
        mine = asked[2 * q : 2 * q + 2].astype(float)
        sims = mine @ matrix.astype(float).T
        allowed = {docs[i] for row in sims for i in np.argsort(-row)[:10]}
        assert {r.doc_id for r in candidates.where(F.col("q_id") == q).collect()} == allowed
        total = {d: sum(row[docs == d].max() for row in sims) for d in allowed}
        want = sorted(total, key=lambda d: (-round(total[d], 4), d))[:3]
        assert [r.doc_id for r in got if r.q_id == q] == want
        assert np.allclose([r.score for r in got if r.q_id == q], [total[d] for d in want], atol=1e-3)


def test_candidate_list_too_large_to_send(late, monkeypatch):
    from vektorloom.operators import spread

    tokens, rows, *_ = late
    candidates = candidate_documents(tokens, rows, 10)
    want = max_sim(tokens, rows, candidates, 3).orderBy("q_id", "rank").collect()
    monkeypatch.setattr(spread, "MAX_SENT_ROWS", 2)
    assert max_sim(tokens, rows, candidates, 3).orderBy("q_id", "rank").collect() == want


def test_fetch_documents(spark, late):
    _, rows, *_ = late
    wanted = spark.createDataFrame([(0, 3), (1, 3), (1, 5)], "q_id long, doc_id long")
    assert fetch_documents(rows, wanted).count() == 404
    assert fetch_documents(rows, wanted, limit=100).groupBy("doc_id").count().orderBy("doc_id").collect() == [(3, 100), (5, 4)]


def test_rerank_is_stable(spark):
    asked = spark.createDataFrame([(1, "red fox", ["a cat", "the Red fox", "fox", "a dog"])], "q_id long, question string, docs array<string>")
    got = rerank(pairs_of_lists(asked, "docs"), 3).orderBy("rank").collect()
    assert [(r.text, r.first_rank) for r in got] == [("the Red fox", 1), ("fox", 2), ("a cat", 0)]
    by_length = lambda: lambda queries, documents: [len(d) for d in documents]
    got = rerank(pairs_of_lists(asked, "docs"), 1, by_length).collect()
    assert got[0].text == "the Red fox"
    with pytest.raises(Exception, match="scores for"):
        rerank(pairs_of_lists(asked, "docs"), 1, lambda: lambda q, d: [1.0]).collect()


def test_zero_vector_has_no_unit_length(spark):
    df = frame(spark, [np.array([3.0, 4.0]), np.zeros(2)])
    got = [r.vector for r in embedding.normalised(df).orderBy("id").collect()]
    assert np.allclose(got[0], [0.6, 0.8]) and got[1] is None


def test_vector_checks(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, [float("nan"), 0.0]), (4, None), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    good, bad = embedding.split_valid(df, 2)
    assert [r.id for r in good.collect()] == [1]
    assert sorted(r.id for r in bad.collect()) == [2, 3, 4, 5]
    with pytest.raises(Exception, match="bad vector"):
        embedding.require_valid(df, 2).collect()


def test_mean_vectors(spark, data):
    collection, _, items, _ = data
    means = embedding.mean_vectors(collection.withColumn("k", F.col("id") % 3).repartition(4), ["k"], "vector")
    for r in means.collect():
        assert np.allclose(r.vector, items[r.k :: 3].mean(axis=0), atol=1e-6)


def test_embedding_models(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.vector for r in embedding.embed(df, encoder=embedding.word_count_encoder(16)).collect()}
    assert sorted(got[1])[-2:] == [1.0, 2.0] and sum(got[2]) == 0 and sum(got[3]) == 0
    letters = lambda: lambda texts: [np.array([[ord(c), 1.0] for c in t or ""]).reshape(-1, 2) for t in texts]
    multi = embedding.embed_multi(df, "id", "text", letters).orderBy("seq_id").collect()
    assert [(r.id, r.seq_id, r.vector[0]) for r in multi][:2] == [(1, 0, 97.0), (1, 1, 32.0)] and len(multi) == 5


@pytest.mark.parametrize("top_k", [1, 3, 12, 20])
def test_cells_leave_out_documents_but_none_of_the_best(spark, late, top_k):
    tokens, rows, *_ = late
    far = spark.createDataFrame([(100 + d, s, [-9.0] * DIM) for d in range(30) for s in range(3)], "doc_id long, seq_id long, vector array<float>")
    rows = rows.unionByName(far)
    cells = index.Cells.train(rows, "ip", 12, 10)
    everything = rows.select("doc_id").distinct().crossJoin(tokens.select("q_id").distinct())
    reached = late_interaction.reaching_documents(tokens, late_interaction.document_cells(rows, cells), cells, everything, top_k)
    want = max_sim(tokens, rows, everything, top_k).orderBy("q_id", "rank").collect()
    assert max_sim(tokens, rows, reached, top_k).orderBy("q_id", "rank").collect() == want
    if top_k < 12:
        assert reached.count() < everything.count() * 0.8


def test_max_sim_sends_candidates_once(late):
    tokens, rows, *_ = late
    plan = max_sim(tokens, rows, candidate_documents(tokens, rows, 10), 3)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "_queries" not in plan and "LeftSemi" in plan


def test_collection_is_not_moved(data, monkeypatch):
    """Query files: no exchange below the scoring of the collection, and none carries a vector."""
    collection, queries, *_ = data
    plan = search.similarity_top_k(queries, collection, 3, strategy="grid")._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "vector" not in plan.split("MapInArrow")[0]


def test_query_files_are_given_away_one_by_one(data, monkeypatch):
    """A cluster refuses folders of a mounted disk (``addFile`` with ``recursive``)."""
    collection, queries, *_ = data
    add, given = SparkContext.addFile, []

    def add_file(self, path, recursive=False):
        assert not recursive
        given.append(path)
        add(self, path)

    monkeypatch.setattr(SparkContext, "addFile", add_file)
    monkeypatch.setattr(search, "QUERY_TILE_BYTES", 8 * DIM * 3)
    scan = search.similarity_top_k(queries, collection, 3, strategy="scan")
    assert rows_of(search.similarity_top_k(queries, collection, 3, strategy="grid")) == rows_of(scan)
    assert len(given) > 1
