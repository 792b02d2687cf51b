from hypothesis import given, settings
from hypothesis import strategies as st

from vektorloom.operators import chunking
from vektorloom.operators.chunking import split_recursively

texts = st.text(alphabet="ab é\n.", max_size=200)


def test_paragraphs_before_lines_before_words():
    text = "one two three\nfour five\n\nsix seven eight nine"
    assert split_recursively(text, 24) == ["one two three\nfour five", "six seven eight nine"]
    assert split_recursively(text, 14) == ["one two three", "four five", "six seven", "eight nine"]


def test_long_word_is_cut():
    assert split_recursively("abcdefghij", 4) == ["abcd", "efgh", "ij"]


def test_exact_size_and_one_more():
    assert split_recursively("ab cd", 5) == ["ab cd"]
    assert split_recursively("ab cd", 4) == ["ab", "cd"]


def test_overlap_keeps_last_pieces():
    assert split_recursively("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]


def test_nothing_but_separators():
    assert split_recursively("", 10) == []
    assert split_recursively("\n\n  \n", 3) == []


@given(texts, st.integers(2, 30))
def test_no_chunk_is_too_long(text, size):
    assert all(0 < len(c) <= size for c in split_recursively(text, size, size // 3))


@given(texts, st.integers(2, 30))
def test_without_overlap_nothing_is_lost(text, size):
    joined = "".join("".join(c.split()) for c in split_recursively(text, size, 0))
    assert joined == "".join(text.split())


def fixed(text, size, overlap):
    step = size - overlap
    count = max(-(-(len(text) - overlap) // step), 1)
    return [text[i * step : i * step + size] for i in range(count)]


@settings(deadline=None, max_examples=8)
@given(st.lists(st.text(alphabet="aé𝄞\n ", max_size=60), min_size=1, max_size=6), st.sampled_from([(5, 0), (5, 2), (7, 6), (4, 3)]))
def test_fixed_length(spark, rows, shape):
    size, overlap = shape
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = chunking.fixed_length_chunks(df, "text", size, overlap).orderBy("doc_id", "chunk_idx").collect()
    want = [(d, i, c) for d, t in enumerate(rows) for i, c in enumerate(fixed(t, size, overlap))]
    assert [tuple(r) for r in got] == want


def test_chunks_keep_their_document(spark):
    df = spark.createDataFrame([(7, "aa bb cc"), (8, None), (9, "")], "doc_id long, text string")
    got = chunking.recursive_chunks(df, "text", 3, 0).orderBy("chunk_idx").collect()
    assert [(r.doc_id, r.chunk_idx, r.text) for r in got] == [(7, 0, "aa"), (7, 1, "bb"), (7, 2, "cc")]
    totals = chunking.chunk_totals(chunking.recursive_chunks(df, "text", 3, 0)).collect()
    assert [(r.doc_id, r.n_chunks, r.n_chars) for r in totals] == [(7, 3, 6)]
