import pytest
from pyspark.sql import functions as F

from vektorloom.collections.store import Collections, apply_changes
from vektorloom.operators import prompting, scoring
from vektorloom.operators.embedding import embed, word_count_encoder
from vektorloom.plans.answering import answer, page_prompts, retrieve_pages
from vektorloom.plans.ingest import ingest


@pytest.fixture()
def store(spark, tmp_path):
    made = Collections(spark, str(tmp_path), f"db_{tmp_path.name.lower()}".replace("-", "_"))
    yield made
    for name in made.names():
        made.drop(name)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, vector array<float>, version long")


def test_life_cycle(spark, store):
    assert not store.has("Docs") and store.names() == []
    store.create("Docs", 2)
    store.insert_rows("docs", vectors(spark, [("a", "x", [1.0, 2.0], 1), ("b", "y", [0.0, 1.0], 1)]))
    assert store.has("docs") and store.dim("docs") == 2
    store.create("docs", 2, if_exists="ignore")
    assert store.row_counts().collect() == [("docs", 2)]
    with pytest.raises(FileExistsError):
        store.create("docs", 2, if_exists="error")
    store.create("docs", 2)
    assert store.scan("docs").count() == 0
    assert "vector" in {r.col_name for r in store.describe("docs").collect()}
    store.drop("docs")
    assert not store.has("docs")
    with pytest.raises(ValueError):
        store.create("x", 2, data_type="audio")


def test_first_image_load_is_kept(spark, store):
    store.create("pages", 2, data_type="image")
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0], "p1.png"), (1, 1, [0.0, 1.0], "p1.png")], "doc_id long, seq_id long, vector array<float>, filepath string")
    store.insert_rows("pages", rows)
    assert store.query("pages", "doc_id in (1)", ["seq_id", "filepath"]).count() == 2
    assert store.query("pages", "doc_id in (1)", ["seq_id"], limit=1).count() == 1


def test_bad_vectors_are_refused(spark, store):
    store.create("docs", 2)
    with pytest.raises(Exception, match="bad vector"):
        store.insert_rows("docs", vectors(spark, [("a", "x", [1.0], 1)]))
    assert store.scan("docs").count() == 0


def test_pairing_by_key(spark, store):
    store.create("docs", 1)
    left = spark.createDataFrame([("c1", [1.0]), ("c2", [2.0])], "chunk_id string, vector array<float>")
    right = spark.createDataFrame([("c2", "two"), ("c1", "one"), ("c3", "three")], "chunk_id string, text string")
    with pytest.raises(ValueError, match="0 vectors and 1 chunks"):
        store.insert_vectors("docs", left, right)
    store.insert_vectors("docs", left, right, strict=False)
    rows = store.scan("docs").select("id", "text", F.col("vector")[0], F.col("payload")["chunk"]).orderBy("id")
    assert [tuple(r) for r in rows.collect()] == [("c1", "one", 1.0, "one"), ("c2", "two", 2.0, "two")]


def test_upsert_highest_version_wins(spark, store):
    store.create("docs", 1)
    store.upsert("docs", vectors(spark, [("a", "new", [2.0], 5), ("a", "old", [1.0], 3), ("b", "b", [1.0], 1)]))
    later = vectors(spark, [("a", "late", [9.0], 4), ("b", "b2", [3.0], 1), ("c", "c", [1.0], 1)])
    for _ in range(2):  # repeating a batch changes nothing
        store.upsert("docs", later)
        got = store.scan("docs").orderBy("id").collect()
        assert [(r.id, r.text, r.version) for r in got] == [("a", "new", 5), ("b", "b2", 1), ("c", "c", 1)]
    store.delete("docs", spark.createDataFrame([("a",)], "id string"))
    assert sorted(r.id for r in store.scan("docs").collect()) == ["b", "c"]


def test_change_feed(spark):
    current = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id long, text string")
    feed = spark.createDataFrame(
        [(2, "2b", 2, "update"), (2, "2a", 1, "update"), (3, None, 4, "delete"), (4, "x", 1, "insert"), (5, "y", 1, "insert"), (5, None, 2, "delete"), (4, "x", 1, "insert")],
        "id long, text string, version long, op string",
    )
    assert sorted(tuple(r) for r in apply_changes(current, feed).collect()) == [(1, "one"), (2, "2b"), (4, "x")]


def test_ingest_and_answer(spark, store):
    corpus = spark.createDataFrame(
        [(1, "cats purr and sleep"), (2, "dogs bark at night"), (3, "fish swim in water")], "id long, body string"
    )
    index = ingest(
        store, "animals", corpus, "id", "body", 64, size=100, index="IVF_HNSW_SQ", metric="l2", cells=2
    )
    assert store.scan("animals").count() == 3 and index.manifest.coding == "sq"
    assert index.manifest.snapshot == store.snapshot("animals") and index.manifest.rows == 3
    assert {"cell", "code", "text"} <= set(index.rows().columns)
    questions = spark.createDataFrame([(1, "who will bark at night", "dogs"), (2, "what can swim", "fish")], "q_id long, question string, reference string")
    got = answer(questions, store.scan("animals"), k=2, top_n=1).orderBy("q_id").collect()
    assert [r.retrieved_contexts for r in got] == [["Source #0\nDetail: dogs bark at night\n"], ["Source #0\nDetail: fish swim in water\n"]]
    assert [r.response for r in got] == ["who will bark at night", "what can swim"]
    assert [r.reference for r in got] == ["dogs", "fish"]
    assert "There are totally 1 contexts" in got[0].prompt


def test_every_question_is_answered(spark):
    """Small last batches and questions without a hit are kept."""
    questions = spark.createDataFrame([(i, "" if i == 3 else f"w{i}", "") for i in range(7)], "q_id long, question string, reference string")
    collection = embed(spark.createDataFrame([(0, "w1 w2"), (1, "w5")], "id long, text string"), encoder=word_count_encoder(256))
    got = answer(questions, collection, k=10, top_n=None, encoder=word_count_encoder(256)).collect()
    assert sorted(r.q_id for r in got) == list(range(7))
    assert {r.q_id: len(r.retrieved_contexts) for r in got}[3] == 0


def test_response_count_is_checked(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    assert sorted(r.response for r in prompting.generate(df, lambda: lambda p, s: [f"{x}{s['max_tokens']}" for x in p], max_tokens=3).collect()) == ["a3", "b3"]
    with pytest.raises(Exception, match="responses for"):
        prompting.generate(df, lambda: lambda p, s: p[:0]).collect()


def test_prompt_text(spark):
    questions = spark.createDataFrame([(1, "why {x}?")], "q_id long, question string")
    hits = spark.createDataFrame([(1, 1, "second"), (1, 0, "first")], "q_id long, rank long, text string")
    text = prompting.prompts(questions, prompting.gather_contexts(hits)).first().prompt
    combined = "Source #0\nDetail: first\n\nSource #1\nDetail: second\n"
    want = prompting.PROMPT_LAYOUT.format(n_ctx=2, ctx_fmt="Source #{source_idx}\nDetail: {source_detail}\n", contexts_combined=combined, question="why {x}?")
    assert text == want


def test_page_retrieval(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0], "p1"), (2, 0, [0.0, 1.0], "p2"), (2, 1, [1.0, 0.0], "p2")], "doc_id long, seq_id long, vector array<float>, filepath string")
    tokens = spark.createDataFrame([(9, 0, [1.0, 0.0]), (9, 1, [0.0, 1.0])], "q_id long, q_seq long, vector array<float>")
    pages = retrieve_pages(tokens, rows, top_k=2)
    assert [(r.filepath, r.score) for r in pages.orderBy("rank").collect()] == [("p2", 2.0), ("p1", 1.0)]
    asked = spark.createDataFrame([(9, "q?"), (8, "none")], "q_id long, question string")
    turns = {r.q_id: r.messages for r in page_prompts(asked, pages).collect()}
    assert [(c.type, c.image, c.text) for c in turns[9][0].content] == [("image", "p2", None), ("image", "p1", None), ("text", None, "q?")]
    assert len(turns[8][0].content) == 1 and turns[8][0].role == "user"


def test_scores(spark):
    contexts = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("a", 2, 1), ("b", 0, 0)], "q_id string, rank long, relevant int")
    for width in (1, 2, 100):
        got = dict(scoring.context_precision(contexts, width=width).collect())
        assert got == {"a": pytest.approx((1 + 2 / 3) / 2), "b": 0.0}
    claims = spark.createDataFrame([("a", "TP"), ("a", "FP"), ("a", "FN"), ("a", "TP"), ("b", "FN")], "q_id string, outcome string")
    assert dict(scoring.factual_f1(claims).collect()) == {"a": pytest.approx(4 / 6), "b": 0.0}
    ratings = spark.createDataFrame([("a", 4), ("a", 2)], "q_id string, rating int")
    assert scoring.answer_accuracy(ratings).first().answer_accuracy == 0.75
    pairs = spark.createDataFrame([("same", "the cat sat", "the cat sat"), ("clip", "the the the the", "the cat the"), ("short", "the cat", "the cat sat"), ("none", "", "x"), ("one", "cat", "cat")], "q_id string, response string, reference string")
    got = dict(scoring.bleu(pairs).collect())
    assert got["same"] == 1.0 and got["none"] == 0.0 and got["one"] == 0.0 and got["clip"] == 0.0
    assert got["short"] == pytest.approx(2.718281828 ** (1 - 3 / 2))
    assert dict(scoring.bleu(pairs, max_n=1).collect())["clip"] == pytest.approx(0.5)


def test_judge_rows(spark):
    rows = spark.createDataFrame([("a", "x y"), ("b", "x")], "q_id string, response string")
    by_word = lambda: lambda b: b.assign(w=b.response.str.split()).explode("w").assign(supported=lambda d: (d.w == "x").astype("int32"))[["q_id", "supported"]]
    verdicts = scoring.judge(rows, by_word, "q_id string, supported int")
    scores = scoring.faithfulness(verdicts)
    assert dict(scores.collect()) == {"a": 0.5, "b": 1.0}
    assert scoring.metric_means(scores, ["faithfulness"]).first().faithfulness == 0.75


def files_below(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_upserts_leave_other_files_alone(spark, store, tmp_path):
    store.create("docs", 1)
    store.insert_rows("docs", vectors(spark, [(f"k{i}", "old", [1.0], 1) for i in range(500)]))
    before = files_below(tmp_path)
    store.upsert("docs", vectors(spark, [("k7", "new", [2.0], 2), ("k8", "stale", [2.0], 0), ("fresh", "x", [3.0], 1)]))
    after = files_below(tmp_path)
    assert before.items() <= after.items() and len(after) - len(before) <= 3
    got = {r.id: (r.text, r.version) for r in store.scan("docs").collect()}
    assert len(got) == 501 and (got["k7"], got["k8"], got["fresh"], got["k9"]) == (("new", 2), ("old", 1), ("x", 1), ("old", 1))
    assert store.row_counts().where("collection = 'docs'").first().n_rows == 501
    store.delete("docs", spark.createDataFrame([("k7",), ("nobody",), ("k7",)], "id string"))
    assert store.scan("docs").count() == 500 and store.query("docs", "id = 'k7'").count() == 0
    store.upsert("docs", vectors(spark, [("k7", "back", [2.0], 1)]))  # after a delete any version counts
    assert store.query("docs", "id = 'k7'", ["text"]).first().text == "back"
    whole = sorted(map(str, store.scan("docs").collect()))
    reader = store.scan("docs")
    store.compact("docs")
    assert sorted(map(str, store.scan("docs").collect())) == whole == sorted(map(str, reader.collect()))
    store.insert_rows("docs", vectors(spark, [("later", "x", [1.0], 1)]))
    assert store.scan("docs").count() == 502


def test_buckets_are_folded_apart(spark, tmp_path):
    import random

    from vektorloom.collections.deltas import Deltas

    schema = spark.createDataFrame([], "id long, v string, version long").schema
    deltas = Deltas(spark, str(tmp_path / "d"), schema, "id", buckets=4)
    base = spark.createDataFrame([(i, "base", 5) for i in range(40)], schema)
    pick, table = random.Random(2), {i: ("base", 5) for i in range(40)}
    for step in range(9):
        if step in (3, 6):
            gone = [pick.randrange(50) for _ in range(8)]
            deltas.erase(spark.createDataFrame([(i,) for i in gone], "id long"))
            table = {k: v for k, v in table.items() if k not in gone}
            continue
        rows = [(i, f"s{step}", pick.randrange(10)) for i in sorted({pick.randrange(50) for _ in range(2 if step == 8 else 9)})]
        deltas.put(spark.createDataFrame(rows, schema), ("writer", step))
        deltas.put(spark.createDataFrame([(1, "again", 99)], schema), ("writer", step))  # a repeated change set
        for i, v, version in rows:
            if i not in table or version >= table[i][1]:
                table[i] = (v, version)
        if step == 5:
            sets = {b: len(s) for b, s in deltas.manifest()["files"].items()}
            files = files_below(tmp_path)
            folded = deltas.compact(max(sets.values()) - 1)
            assert folded == [int(b) for b, n in sorted(sets.items()) if n == max(sets.values())] and len(folded) < 4
            assert files.items() <= files_below(tmp_path).items()
            names = {b: s for b, s in deltas.manifest()["files"].items()}
            assert all(len(s) == (1 if int(b) in folded else sets[b]) for b, s in names.items())
        got = {r.id: (r.v, r.version) for r in deltas.over(base, lambda x: x).collect()}
        assert got == table, step
    deltas.compact(0)
    deltas.clean()
    assert len(deltas.commits()) == 1 and {r.id: (r.v, r.version) for r in deltas.over(base, F.broadcast).collect()} == table
    assert len({p.split("/_bucket")[0] for p in files_below(tmp_path)}) == 1


def test_rounds_are_timed(spark, tmp_path):
    from vektorloom.plans.answering import answer_in_rounds

    questions = spark.createDataFrame([(i, f"w{i}", "") for i in range(7)], "q_id long, question string, reference string")
    collection = embed(spark.createDataFrame([(0, "w1 w2"), (1, "w5")], "id long, text string"))
    answered, rounds = answer_in_rounds(questions, collection, 3, str(tmp_path / "run"), k=2, top_n=1)
    assert sorted(map(str, answered.collect())) == sorted(map(str, answer(questions, collection, k=2, top_n=1).collect()))
    rows = rounds.orderBy("round").collect()
    assert [r.round for r in rows] == [0, 1, 2] and all(r.total == r.embedding + r.retrieval + r.rerank + r.prompt + r.generation > 0 for r in rows)
    assert all(abs(sum(r[f"share_{c}"] for c in ("embedding", "retrieval", "rerank", "prompt", "generation")) - 100) < 1e-6 for r in rows)
    lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "run" / "rounds")).collect()]
    assert sorted(int(x[0]) for x in lines) == [0, 1, 2] and all(len(x) == 7 for x in lines)
    none, no_rounds = answer_in_rounds(questions.where("q_id > 99"), collection, 3, str(tmp_path / "none"))
    assert none.count() == 0 and no_rounds.count() == 0
