"""Indexes that outlive their session, against exact search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektorloom.operators import embedding, search, stored_index
from vektorloom.operators.stored_index import StoredIndexes, open_index
from vektorloom.plans.answering import answer
from vektorloom.plans.ingest import ingest, ingest_pages, indexes_of
from tests.test_search import brute, frame, rows_of

DIM = 8
KINDS = ["IVF_FLAT", "IVF_HNSW_SQ", "IVF_PQ"]


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, DIM)) * 3
    items = (centres[draw.integers(0, 12, 600)] + draw.normal(size=(600, DIM))).astype(np.float32)
    items[50] = items[40]  # a tie
    items[60] = 0  # no direction
    queries = items[draw.integers(0, 600, 9)] + draw.normal(size=(9, DIM)).astype(np.float32) / 2
    queries[0] = items[40]
    collection = frame(spark, list(items)).unionByName(spark.createDataFrame([(9999, None)], "id long, vector array<float>"))
    return collection.repartition(4), frame(spark, queries, "q_id"), items.astype(float), queries.astype(float)


@pytest.fixture(scope="module")
def indexes(spark, data, tmp_path_factory):
    made = StoredIndexes(spark, str(tmp_path_factory.mktemp("indexes")))
    for kind in KINDS:
        for metric in ("l2", "ip", "cosine"):
            made.build(data[0], kind, metric, cells=8, sub_vectors=4, bits=4, iterations=5)
    return made


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_full_probe_is_exact(indexes, data, kind, metric, monkeypatch):
    _, queries, items, asked = data
    index = indexes.open(f"{kind}_{metric}")
    kept = items if metric != "cosine" else np.delete(items, 60, 0)
    for k in (1, 7, 700):
        want = brute(kept, asked, k, metric)
        if metric == "cosine":
            want = [(q, r, i + (i >= 60), s) for q, r, i, s in want]
        got = rows_of(index.search(queries, k, nprobe=8))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)
    monkeypatch.setattr(search, "QUERY_TILE_BYTES", 4 * 8 * DIM)
    monkeypatch.setattr(stored_index, "ITEM_TILE_BYTES", 2000)
    assert rows_of(index.search(queries, 7, nprobe=8, strategy="grid")) == rows_of(index.search(queries, 7, nprobe=8))


@pytest.mark.parametrize("kind", KINDS)
def test_certificate_passes_on_few_rows(indexes, data, kind):
    """The bounds leave most rows out, and the candidates hold the exact answer."""
    _, queries, items, asked = data
    candidates, _ = indexes.open(f"{kind}_l2").candidates(queries, 5, 8)
    found = {(r.q_id, r.id) for r in candidates.collect()}
    assert {w[:3:2] for w in brute(items, asked, 5, "l2")} <= found and len(found) < 9 * 600 / 4
    few = indexes.open(f"{kind}_l2").candidates(queries, 5, 8, over_fetch=2)[0]
    assert few.groupBy("q_id").count().select(F.max("count")).first()[0] == 10


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_measured_default_finds_the_neighbours(indexes, data, metric):
    _, queries, items, asked = data
    index = indexes.open(f"IVF_HNSW_SQ_{metric}")
    m = index.manifest
    assert 1 <= m.nprobe <= 8 and m.recall[str(m.nprobe)] >= stored_index.WANTED_RECALL
    assert list(m.recall.values()) == sorted(m.recall.values())
    found = {(q, i) for q, _, i, _ in rows_of(index.search(queries, 5))}
    want = {(q, i + (metric == "cosine" and i >= 60)) for q, _, i, _ in brute(items if metric != "cosine" else np.delete(items, 60, 0), asked, 5, metric)}
    assert len(found & want) >= 0.9 * len(want)


def test_reopened_by_path(spark, indexes, data):
    index = open_index(spark, indexes.open("IVF_PQ_l2").path + "/")
    fresh = rows_of(index.search(data[1], 4))
    assert fresh == rows_of(indexes.open("IVF_PQ_l2").search(data[1], 4))
    with pytest.raises(FileNotFoundError):
        open_index(spark, indexes.root + "/nothing")


def test_search_reads_codes_of_probed_cells_only(indexes, data):
    index = indexes.open("IVF_HNSW_SQ_l2")
    one = data[1].where("q_id = 3")
    sent = search.sent_queries(one, ["q_id"])
    cells = index._asked(sent, 2)
    rows = index.rows().select("id", "code", "error", "cell").where(F.col("cell").isin(cells))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(cells) == 2 and re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN", plan)
    assert "vector" not in plan.split("ReadSchema")[1]


def test_versions(spark, data, tmp_path):
    collection, queries, items, asked = data
    indexes = StoredIndexes(spark, str(tmp_path / "deep" / "er"))
    assert indexes.names() == [] and not indexes.has("mine") and indexes.describe().count() == 0
    first = indexes.build(collection, "IVF_FLAT", "l2", "mine", cells=4, iterations=3, nprobe=4, snapshot="one")
    running = first.search(queries, 3)  # its plan reads the first version
    second = indexes.build(collection.where("id < 100"), "IVF_HNSW_SQ", "l2", "mine", cells=2, iterations=3, nprobe=2)
    assert (first.manifest.version, second.manifest.version) == (1, 2) and indexes.versions("mine") == [1, 2]
    assert [r[:3] for r in rows_of(running)] == [w[:3] for w in brute(items, asked, 3, "l2")]
    assert indexes.open("mine").manifest.rows == 100 and indexes.open("mine", 1).manifest.rows == 600
    with pytest.raises(FileExistsError):
        indexes.build(collection, "IVF_FLAT", "l2", "mine", replace_existing=False)
    indexes.build(collection, "IVF_FLAT", "ip", cells=2, iterations=2, nprobe=1)
    listed = [tuple(r) for r in indexes.describe().select("name", "version", "kind", "n_rows", "snapshot").collect()]
    assert listed == [("IVF_FLAT_ip", 1, "IVF_FLAT", 600, None), ("mine", 2, "IVF_HNSW_SQ", 100, None)]
    indexes.expire("mine", keep=1)
    assert indexes.versions("mine") == [2] and indexes.open("mine").search(queries, 2).count() == 18
    indexes.drop("mine")
    assert indexes.names() == ["IVF_FLAT_ip"] and not indexes.has("mine")
    with pytest.raises(ValueError):
        indexes.build(collection.where("vector IS NULL"), "IVF_FLAT", "l2")
    with pytest.raises(ValueError):
        indexes.has("../mine")


def test_two_builders_get_two_numbers(indexes, data):
    """The second to publish finds its number taken and takes the next."""
    index = indexes.open("IVF_FLAT_l2")
    folder = indexes._folder("IVF_FLAT_l2")
    assert not folder.publish("manifest-00000001.json", "{}") and [n for n in folder.names() if n.startswith("_draft")] == []
    again = indexes._publish(index.manifest)
    assert again.manifest.version == index.manifest.version + 1
    assert rows_of(again.search(data[1], 3)) == rows_of(index.search(data[1], 3))


def test_ties_and_string_keys(spark, tmp_path):
    rows = [(f"k{i:02d}", "x", [1.0, float(i // 10)]) for i in range(40)]
    collection = spark.createDataFrame(rows, "name string, part string, vector array<float>")
    index = StoredIndexes(spark, str(tmp_path)).build(collection, "IVF_PQ", "l2", item_keys=("name", "part"), fields=("part",), cells=2, sub_vectors=2, bits=2, iterations=3, nprobe=2)
    asked = spark.createDataFrame([(1, "a", [1.0, 1.0]), (2, "b", None)], "q_id long, who string, vector array<float>")
    got = index.search(asked, 3, query_keys=("q_id", "who"), output_fields=("part",)).orderBy("rank").collect()
    assert [(r.q_id, r.who, r.name, r.score, r.part) for r in got] == [(1, "a", f"k{i}", 0.0, "x") for i in (10, 11, 12)]
    assert index.search(asked.where("q_id > 5"), 3, query_keys=("q_id",)).count() == 0


def test_answers_through_an_index(spark, tmp_path):
    from vektorloom.collections.store import Collections

    store = Collections(spark, str(tmp_path), "indexed")
    corpus = spark.createDataFrame([(1, "cats purr and sleep"), (2, "dogs bark at night")], "id long, body string")
    ingest(store, "pets", corpus, "id", "body", 64, size=100)
    more = spark.createDataFrame([(3, "fish swim in water")], "id long, body string")
    index = ingest(store, "pets", more, "id", "body", 64, size=100, index="IVF_HNSW_SQ", metric="cosine", if_exists="append", cells=2)
    assert indexes_of(store).names() == ["pets"] and index.manifest.rows == 3 == store.scan("pets").count()
    questions = spark.createDataFrame([(1, "who will bark at night", "dogs"), (2, "what can swim", "fish")], "q_id long, question string, reference string")
    scanned = answer(questions, store.scan("pets"), k=2, top_n=1).orderBy("q_id").collect()
    assert answer(questions, k=2, top_n=1, index=open_index(spark, index.path), nprobe=2).orderBy("q_id").collect() == scanned
    pages = spark.createDataFrame([(d, s, [float(d), 1.0], f"p{d}") for d in range(3) for s in range(2)], "doc_id long, seq_id long, vector array<float>, filepath string")
    found = ingest_pages(store, "pages", pages, 2, index="IVF_FLAT", cells=2, nprobe=2)
    got = found.search(spark.createDataFrame([(1, [1.0, 0.0])], "q_id long, vector array<float>"), 2, output_fields=("filepath",))
    assert [(r.doc_id, r.seq_id, r.filepath) for r in got.orderBy("rank").collect()] == [(2, 0, "p2"), (2, 1, "p2")]
    with pytest.raises(ValueError):
        ingest(store, "pets", more, "id", "body", 64, if_exists="merge")


@pytest.mark.parametrize("name", ["pq_search", "ivf_probe", "index_default"])
def test_recall_of_the_registered_queries(spark, name):
    from workload.registry import QUERIES
    import workload.indexes  # noqa: F401

    sf = "/root/testdata/sf0.01"
    found, exact = ({(r.q_id, r.id) for r in QUERIES[q](spark, sf).collect()} for q in (name, "knn_l2"))
    assert len(found & exact) >= 0.9 * len(exact) == 90


def test_a_build_runs_the_model_once_per_row(spark, tmp_path):
    log = str(tmp_path / "rows")

    def encoder():
        def encode(texts):
            with open(log, "a") as f:
                f.write("x" * len(texts))
            return np.array([[len(t), t.count("a") + 1] for t in texts], np.float32)

        return encode

    texts = spark.createDataFrame([(i, "a" * (i % 7) + "b" * (i % 5)) for i in range(400)], "id long, text string")
    rows = embedding.embed(texts, encoder=encoder)
    index = stored_index.StoredIndexes(spark, str(tmp_path / "indexes")).build(rows, "IVF_HNSW_SQ", "cosine", fields=("text",), cells=4, iterations=2, nprobe=4)
    assert len(open(log).read()) == 400 and index.manifest.rows == 400


def test_scores_of_pairs(spark):
    queries = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "q_id long, vector array<double>")
    items = spark.createDataFrame([(1, [4.0, 3.0]), (2, [0.0, 2.0])], "id long, vector array<float>")
    every = queries.select("q_id").crossJoin(items.select("id"))
    got = {m: {(r.q_id, r.id): r.score for r in search.rescored(every, queries, items, 5, m).collect()} for m in ("l2", "ip", "cosine")}
    assert got["l2"] == {(1, 1): 2.0, (1, 2): 13.0, (2, 1): 25.0, (2, 2): 4.0}
    assert got["ip"] == {(1, 1): 24.0, (1, 2): 8.0, (2, 1): 0.0, (2, 2): 0.0}
    assert got["cosine"] == {(1, 1): 0.96, (1, 2): 0.8}
