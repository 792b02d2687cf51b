"""Operators of the corpus subpackage against brute force, on odd rows, and on empty tables."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vektorloom.llm import (
    bpe,
    chat,
    common,
    components,
    exact_dedup,
    fingerprints,
    html_layout,
    jaccard_join,
    mixing,
    queries,
    substring_dedup,
    token_counts,
    toxicity,
)
from vektorloom.llm.words import SliceHashes, WordHashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = [a + b + c for a in ("th", "er", "an", "ou") for b in ("a", "in", "el", "qu") for c in ("st", "ing", "de", "x", "é")]


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(VOCABULARY) for _ in range(n))


def changed(text, seed, times):
    pick, words = random.Random(seed), text.split(" ")
    for _ in range(times):
        words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
    return " ".join(words)


def rows():
    """Nulls, empty and long texts, ties, repeated rows, exact and near copies in families."""
    out = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, "", "en", None, 0), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3)]
    out += [(5, "One two", "de", "b", 7), (6, "one TWO", "de", "b", 7), (None, prose(3, 80), "fr", "c", None), (7, prose(1, 6000), "en", "a", None)]
    out += [(None, "lost row", "fr", "c", None), (8, " \n\t", "fr", "c", 3), (4, "two", "en", "b", 3)]
    for family in range(4):
        base = prose(100 + family, 60 + 50 * family)
        out += [(10 + 40 * family + i, changed(base, i, i % 7), "en", "a", None) for i in range(36)]
        out += [(47 + 40 * family, base, "en", "d", None), (48 + 40 * family, base, "en", "d", None)]
    shared = prose(999, 60)
    out += [(300 + i, f"{prose(400 + i, 30 + i)} {shared if i % 3 else ''} {prose(500 + i, 25)}", "es", "e", None) for i in range(9)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    clash = [F.lit(9).alias(c) for c in ("key", "cls", "n", "span", "kept", "score", "_row", "tokens", "lead", "at")]
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).select("*", *clash).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_sets(size):
    out = []
    for doc_id, text, *_ in rows():
        words = (text or "").encode().lower().split()
        size_here = min(size, len(words))
        out.append((doc_id, {tuple(words[i : i + size_here]) for i in range(len(words) - size_here + 1)} if words else set()))
    return out


@pytest.mark.parametrize("rule", [jaccard_join.Rule(3, 9, 10), jaccard_join.Rule(5, 4, 5), jaccard_join.Rule(1, 4, 5)])
def test_jaccard_join(docs, none, rule):
    sets = [(i, s) for i, s in shingle_sets(rule.words)]
    named = [(i, s) for i, s in sets if i is not None and s]
    parent = list(range(len(named)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(range(len(named)), 2):
        a, b = named[x][1], named[y][1]
        if rule.of * len(a & b) >= rule.part * len(a | b):
            parent[max(root(x), root(y))] = min(root(x), root(y))
    least = defaultdict(lambda: 10**9)
    for x, (i, _) in enumerate(named):
        least[root(x)] = min(least[root(x)], i)
    expected = Counter((i, len(s), least[root(x)]) for x, (i, s) in enumerate(named))
    expected += Counter((i, len(s), i) for i, s in sets if i is None or not s)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.grouped(docs, rule).collect())
    assert got == expected
    assert len({c for _, _, c in got}) < len(named)
    assert jaccard_join.grouped(none, rule).count() == 0


@pytest.mark.parametrize("rule", [jaccard_join.Rule(3, 9, 10), jaccard_join.Rule(5, 4, 5), jaccard_join.Rule(5, 1, 2)])
def test_linked_sets_meet_in_a_list(rule):
    random = np.random.default_rng(5)
    linked = 0
    for n in [*range(1, 60), *random.integers(60, 3000, 300).tolist()]:
        core = random.integers(0, 1 << 64, n, np.uint64)
        most = rule.per_element * n // rule.per_difference
        for differ in {most, most + 1, 2 * most}:
            gone = int(random.integers(0, min(differ, n - 1) + 1))
            x = np.unique(core)
            y = np.unique(np.concatenate([core[gone:], random.integers(0, 1 << 64, differ - gone, np.uint64)]))
            both = len(np.intersect1d(x, y))
            if both < len(x) + len(y) - both and rule.of * both >= rule.part * (len(x) + len(y) - both):
                linked += 1
                assert len(np.intersect1d(jaccard_join.block_keys(x, rule), jaccard_join.block_keys(y, rule)))
    assert linked > 200


def test_jaccard_join_ends_lists_of_unlinked_sets_in_few_rounds(spark, monkeypatch):
    """Sets that changed too much to link share elements with one another; one leader a round would take a round each."""
    pick, rule = random.Random(7), jaccard_join.Rule(1, 4, 5)
    base, pool = [f"w{i}" for i in range(100)], [f"x{i}" for i in range(30)]
    texts = []
    for _ in range(60):
        words = list(base)
        for place in pick.sample(range(100), pick.choice([6, 12, 14, 16])):
            words[place] = pick.choice(pool)
        texts.append(" ".join(words))
    sets, parent = [set(t.split()) for t in texts], list(range(len(texts)))
    for _ in sets:  # the smallest id travels along the links
        for x, y in itertools.combinations(range(len(sets)), 2):
            if rule.of * len(sets[x] & sets[y]) >= rule.part * len(sets[x] | sets[y]):
                parent[x] = parent[y] = min(parent[x], parent[y])
    rounds, derived = [], jaccard_join.derived
    monkeypatch.setattr(jaccard_join, "derived", lambda *a: (rounds.append(1), derived(*a))[1])
    found = jaccard_join.grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rule)
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(parent))
    assert 1 < len(set(parent)) < len(parent)
    assert 1 <= len(rounds) <= 3


@pytest.mark.parametrize("most", [0, 10**6])
def test_jaccard_join_brings_no_table_into_the_driver(docs, monkeypatch, most):
    def refused(*_):
        raise AssertionError("a table is brought into the driver")

    wanted = sorted(jaccard_join.grouped(docs).collect(), key=str)
    monkeypatch.setattr(common, "MOST_SENT", most)
    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(docs), name, refused)
    assert jaccard_join.one_of_each(docs).columns == docs.columns
    found = jaccard_join.grouped(docs)
    monkeypatch.undo()
    assert sorted(found.collect(), key=str) == wanted


def test_one_of_each_keeps_columns(docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = jaccard_join.grouped(docs).where("doc_id IS NOT NULL")
    wanted = {r.doc_id for r in groups.where("doc_id = component_id").collect()}
    assert {r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()} == wanted
    assert kept.where("doc_id IS NULL").count() == 2


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 20), (30, 31), (31, 31)] + [(100, x) for x in range(101, 140)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 1), 8: 8, 9: 8, 20: 8, 30: 30, 31: 30, **dict.fromkeys(range(100, 140), 100)}


@pytest.mark.parametrize("key_of", [F.xxhash64, lambda c: F.xxhash64(c) % 3])
def test_exact_groups(docs, none, key_of):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows():
        groups[text or ""].append(doc_id)
    got = exact_dedup.exact_groups(docs, key_of).collect()
    assert len(got) == len(rows())
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == digest]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted((r.doc_id is None, r.doc_id) for r in mine) == sorted((i is None, i) for i in ids)
        assert {(r.keep_id, r.group_size) for r in mine} == {(keep, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [keep]
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_chunks_make_the_text(docs):
    cut = docs.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("c", exact_dedup.chunks_of(F.col("t"), 16, 64))
    assert cut.where(F.array_join("c", "") != F.col("t")).count() == 0


def test_fingerprints(docs, none):
    got = fingerprints.fingerprinted_edits(docs).collect()
    assert len(got) == len(rows()) and fingerprints.fingerprinted_edits(none).count() == 0
    order = sorted((i, t or "") for i, t, *_ in rows() if i is not None)
    expected = Counter()
    for at, (doc_id, text) in enumerate(order):
        half, following = len(text) // 2, order[(at + 1) % len(order)][1]
        edited = text[: len(text) - half] + following[:half]
        expected[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == expected
    same = defaultdict(set)
    for r in got:
        assert 0 <= r.near_edited <= 1 and (r.near_next is None) == (r.doc_id is None)
        same[r.doc_id].add(r.fingerprint)
    assert same[47] == same[48] and same[2] == same[3] and len(same[4]) == 2
    long_ones = [r for r in got if r.n_chars > 300 and r.doc_id is not None and r.doc_id >= 300]
    assert np.mean([r.near_edited for r in long_ones]) > np.mean([r.near_next for r in long_ones]) + 0.1


def prints_of(spark, texts):
    found = fingerprints.fingerprints(spark.createDataFrame(list(texts.items()), "k long, t string"), ["k"], "t").collect()
    return {r.k: (r.n, r.lanes, r.counts) for r in found}


def as_frame(spark, print_):
    return spark.createDataFrame([(0, *print_)], "k long, n long, lanes array<bigint>, counts array<bigint>")


def test_fingerprints_add_and_leave(spark):
    texts = {1: "first paragraph here\nsecond one there", 2: "second one there\nfirst paragraph here", 3: "first paragraph here", 4: "second one there"}
    of = prints_of(spark, {**texts, 5: "nothing like it"})
    assert of[1] == of[2] != of[3]
    plain = lambda df: tuple(df.first()[1:])
    insert, delete = (lambda a, b, f=f: plain(f(as_frame(spark, a), as_frame(spark, b), ["k"])) for f in (fingerprints.insert, fingerprints.delete))
    assert insert(of[3], of[4]) == of[1] and delete(of[1], of[4]) == of[3]
    # taking away what is not there, and sums beyond the modulus, are undone exactly
    assert insert(delete(of[3], of[5]), of[5]) == of[3] and all(0 <= x < 1 << 32 for x in delete(of[3], of[5])[1])
    top = ((1 << 32) - 1, [(1 << 32) - 1] * 32, [(1 << 32) - 1] * 64)
    assert delete(insert(top, top), top) == top and insert(of[3], top) == delete(of[3], (1, [1] * 32, [1] * 64))


def test_fingerprints_are_of_paragraphs(spark):
    """Only the order of paragraphs (and empty lines) does not matter."""
    same = ["one two\nthree\nthree", "three\none two\nthree", "\n\nthree\nthree\n\none two\n"]
    other = ["one two\nthree", "two one\nthree\nthree", "one  two\nthree\nthree", "one two three three", "one two\nthree\nthree ", "three one\ntwo\nthree", "", "one two\nthree\nThree"]
    lanes = [tuple(lanes) for _, (_, lanes, _) in sorted(prints_of(spark, dict(enumerate([*same, *other]))).items())]
    assert len(set(lanes[:3])) == 1 and len(set(lanes)) == 1 + len(other) and lanes[9] == (0,) * 32


def test_fingerprints_by_hand(spark):
    """Both parts of a fingerprint and the likeness against sums in Python."""
    import re

    texts = dict(enumerate([prose(i, 5 + 17 * i).replace(" ", "\n", i) for i in range(6)] + ["", "a b c\nd", prose(3, 40) + " " + prose(4, 20)]))
    parts = sorted({p for t in texts.values() for p in [*t.split("\n"), *re.split(fingerprints.PHRASE_END, t)]})
    hashed = spark.createDataFrame([(p,) for p in parts], "p string").select("p", F.xxhash64("p").alias("h"), F.array(*[F.xxhash64(F.lit(i), "p") for i in range(16)]).alias("s")).collect()
    single, seeded = {r.p: r.h % (1 << 64) for r in hashed}, {r.p: [x % (1 << 64) for x in r.s] for r in hashed}
    expected = {}
    for k, t in texts.items():
        paragraphs, phrases = [p for p in t.split("\n") if p], [p for p in re.split(fingerprints.PHRASE_END, t) if p]
        lanes = [sum(seeded[p][i // 2] >> 32 * (i % 2) & 0xFFFFFFFF for p in paragraphs) % (1 << 32) for i in range(32)]
        expected[k] = (len(phrases), lanes, [sum(single[p] >> j & 1 for p in phrases) for j in range(64)])
    got = prints_of(spark, texts)
    assert got == expected

    def near(a, b):
        if a[0] == b[0] and a[2] == b[2]:
            return 1.0
        x, y = (np.array(v[2]) * 2.0 - v[0] for v in (a, b))
        length = np.sqrt((x @ x) * (y @ y))
        return float(np.clip(x @ y / length, 0, 1)) if length else 0.0

    pairs = spark.createDataFrame([(i, j, *expected[i][::2], *expected[j][::2]) for i in texts for j in texts], "i long, j long, n long, a array<bigint>, m long, b array<bigint>")
    for r in pairs.select("i", "j", fingerprints.likeness(F.col("a"), F.col("n"), F.col("b"), F.col("m")).alias("near")).collect():
        assert abs(r.near - near(expected[r.i], expected[r.j])) < 1e-9


def test_fingerprint_of_a_very_long_text(spark):
    """Eleven megabytes of short words: more phrases than any packed lane of a long could have held before."""
    docs = spark.createDataFrame([(1, "wordy " * 1_900_000), (2, "ab\n" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprinted_edits(docs).collect()}
    assert got[1].n_chars == 11_400_000 and got[1].fingerprint.split(":")[1] == f"{1_900_000:x}" and 0 <= got[2].near_next <= 1


def test_next_key(spark, monkeypatch):
    keys = sorted({-(1 << 62), -5, -1, 0, 3, 255, 256, 70000, 1 << 40, (1 << 62) + 7, *range(1000, 1100, 7)})
    monkeypatch.setattr(fingerprints, "ONE_SORT", 4)
    got = {r.k: r.next for r in fingerprints.next_key(spark.createDataFrame([(k,) for k in keys], "k long")).collect()}
    assert got == dict(zip(keys, [*keys[1:], None]))


TEXTS = [
    "", " ", "  a  b ", " a\n\n b\t", "it's  'S 's", "x▁y ▁▁z", "日本語 全角　 x", "😀👍🏽 é  x\x85y \x1c\x1d z", "a​b", "1234 5678\n \n  end \n",
    "a\r\nb", "﷽ ⅷ ½", "<s> </s><unk> <0x0A>", "###", prose(5, 300), "word" * 3000,
]


def test_byte_level_bpe(spark, docs, none):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*TEXTS, *(t for _, t, *_ in rows() if t)]
    encoder, decoder = bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text) and decoder.decode(ids) == text and decoder.raw(ids) == text.encode()
    got = bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN)
    assert got.count() == len(rows()) and bpe.token_digests(none, RANKS, public_tokenizers.PATTERN).count() == 0
    empty = got.where("doc_id = 1").first()
    assert (empty.n_tokens, empty.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).where("doc_id = 7").first().decoded == prose(1, 6000)


def test_transducer_forgets(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 5)
    ranks = bpe.read_ranks(RANKS)
    coder = bpe.Transducer(ranks)
    merges = bpe.Merges(ranks)
    for word in VOCABULARY * 2:
        assert coder.encode(word.encode()) == [ranks[t] for t in merges.apply(word.encode())]


def test_transducer_starts_anew_within_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 40)
    monkeypatch.setattr(bpe, "MOST_MOVES", 400)
    ranks = bpe.read_ranks(RANKS)
    coder, merges = bpe.Transducer(ranks), bpe.Merges(ranks)
    known, begun = [], coder.states
    for word in VOCABULARY * 3:
        known += list(begun.values())[:1] if begun is not coder.states else []
        begun = coder.states
        assert coder.encode(word.encode()) == [ranks[t] for t in merges.apply(word.encode())]
        # a word of n bytes makes n states and a move for each open token and byte
        assert len(coder.states) <= 40 + 64 and len(coder.moves) <= 400 + 64 * 64
    # states that were dropped hold no others, so they go without the garbage collector
    gone = [state for state in known if state not in coder.states.values()]
    assert not any(gone)


def test_workers_free_what_other_operators_keep():
    made = []
    make = lambda: made.append(0) or made
    assert common.kept("one", b"x", make) is common.kept("one", b"x", make) and len(made) == 1
    common.keep_only("one")
    assert common.kept("one", b"x", make) and len(made) == 1
    common.keep_only(None)
    assert not common._KEPT


def test_coders_go_when_another_operator_runs(spark):
    texts = spark.createDataFrame([(1, "a few words")], "doc_id long, text string").coalesce(1)

    def names():
        return lambda rows: {"n": [len(common._KEPT)] * len(rows["doc_id"])}

    bpe.token_digests(texts, RANKS, public_tokenizers.PATTERN).collect()
    assert common.map_rows(texts, names, "n int").first().n == 0


def test_decoder_mends_broken_bytes():
    ranks = bpe.read_ranks(RANKS)
    single = {t: i for t, i in ranks.items() if len(t) == 1}
    for data in (b"a\xff b", "é€😀".encode(), b"\xe2\x82", b"\xf0\x9f\x98x", b"\xc3\xc3\xa9", b"\x80\x80", b"\xed\xa0\x80"):
        assert bpe.Decoder(ranks).decode([single[bytes((b,))] for b in data]) == data.decode("utf-8", "replace")


def test_token_counts(docs, none):
    from sentencepiece import SentencePieceProcessor

    proto = open(MODEL, "rb").read()
    counter = token_counts.Counter(proto, token_counts.prove(proto))
    library = SentencePieceProcessor(model_file=MODEL)
    for text in TEXTS:
        assert counter.count(text) == len(library.encode(text)), text
    got = {r.doc_id: r for r in token_counts.token_counts(docs, MODEL).where("doc_id <> 4").collect()}
    expected = {i: t or "" for i, t, *_ in rows() if i not in (4, None)}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {
        i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in expected.items()
    }
    assert token_counts.token_counts(none, MODEL).count() == 0


def brute_passages(texts, least):
    """Pairs (document, smaller document) that share ``least`` consecutive words."""
    runs = defaultdict(set)
    for doc_id, words in texts.items():
        for i in range(len(words) - least + 1):
            runs[tuple(words[i : i + least])].add(doc_id)
    return {d for ids in runs.values() if len(ids) > 1 for d in ids if d != min(ids)}


def test_repeated_passages(docs, none):
    got = substring_dedup.repeated_passages(docs).collect()
    texts = {i: (t or "").lower().split() for i, t, *_ in rows() if i is not None and i != 4}
    assert brute_passages(texts, 51) <= {r.doc_id for r in got}
    for r in got:
        x, y = texts[r.doc_id][r.begin : r.end], texts[r.match_doc_id][r.match_begin : r.match_begin + r.n_words]
        assert r.n_words >= 50 and r.match_doc_id < r.doc_id
        common = sum(x[i : i + 5] == y[i : i + 5] for i in range(len(x) - 4))
        assert common / (2 * (len(x) - 4) - common) >= 0.79 or r.similarity < 1
    assert substring_dedup.repeated_passages(none).count() == 0


def covered(spark, texts):
    """Places of each document that a passage of ``repeated_passages`` covers."""
    got = substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    out = defaultdict(set)
    for r in got:
        out[r.doc_id].update(range(r.begin, r.end))
    return out


def brute_covered(texts, least=50):
    """Places of each document in runs of ``least`` words that stand at an earlier place too."""
    first, out = {}, defaultdict(set)
    for doc_id, text in sorted(texts):
        words = text.split(" ")
        for i in range(len(words) - least + 1):
            if first.setdefault(tuple(words[i : i + least]), (doc_id, i)) != (doc_id, i):
                out[doc_id].update(range(i, i + least))
    return out


def test_equal_passages_are_covered_whole(spark):
    passage, around = prose(71, 55).split(" "), prose(72, 400).split(" ")
    edited = [*passage[:18], "odd", *passage[19:37], "other", *passage[38:]]
    texts = [(1, [*around[:200], *edited, *around[200:]]), (2, [*around[:200], *passage, *around[200:]])]
    texts += [(3, [*prose(73, 90).split(" "), *passage, *prose(74, 70).split(" ")])]
    texts = [(i, " ".join(words)) for i, words in texts]
    pick = random.Random(5)
    for i in range(4, 40):
        begin = pick.randrange(0, 330)
        texts.append((i, " ".join([prose(i, pick.randrange(30)), *around[begin : begin + pick.randrange(40, 70)], prose(-i, 5)]).strip()))
    got, wanted = covered(spark, texts), brute_covered(texts)
    assert wanted[3] and all(places <= got[doc_id] for doc_id, places in wanted.items())


def hashed(words):
    return substring_dedup.Text(substring_dedup.WordHashes().of(" ".join(words)))


def aligned_around(x, y):
    """Stretches that start from any common shingle of two lists of words."""
    pair, out = substring_dedup.Pair(hashed(x), hashed(y)), set()
    for i, j in itertools.product(range(len(x) - 4), range(len(y) - 4)):
        if x[i : i + 5] == y[j : j + 5]:
            out.update(substring_dedup.matched(pair.aligned(i, j)))
    return out


def likeness(x, y):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (x, y))
    return (x & y).total() / (x | y).total()


def test_near_passages_with_insertions(spark):
    passage = prose(81, 90).split(" ")
    head, tail, other = (prose(i, 40).split(" ") for i in (82, 83, 84))
    for changed_passage in (
        [*passage[:45], "odd", *passage[45:]],
        [*passage[:45], *passage[46:]],
        [*passage[:30], "odd", *passage[30:60], *passage[61:]],
        [*passage[:45], *"four words of more".split(), *passage[45:]],
    ):
        x, y = [*head, *changed_passage, *tail], [*other, *passage]
        found = aligned_around(x, y)
        for begin, end, begin_y, similarity in found:
            assert (begin, end, begin_y) == (40, 40 + len(changed_passage), 40)
            assert abs(similarity - likeness(changed_passage, passage)) < 1e-9 and similarity >= 0.8
        assert found or likeness(changed_passage, passage) < 0.8
    assert found
    # a good stretch followed by text that is aligned worse: the stretch stays, beyond its first run
    rest = prose(85, 60).split(" ")
    bad = [w if i % 7 else f"new{i}" for i, w in enumerate(rest)]
    found = aligned_around([*passage[:45], "odd", *passage[45:], *bad], [*passage, *rest])
    assert max(end - begin for begin, end, _, _ in found) >= 91
    texts = [(1, " ".join([*other, *passage])), (2, " ".join([*head, *passage[:45], "odd", *passage[45:], *tail]))]
    assert covered(spark, texts)[2] >= set(range(40, 131))


def test_repeats_inside_a_document(spark):
    passage = prose(91, 60).split(" ")
    near = [*passage[:30], "odd", *passage[30:]]
    gap = lambda seed: prose(seed, 45).split(" ")
    changed_passage = [w if i % 9 else f"new{i}" for i, w in enumerate(passage)]
    texts = [
        (1, [*gap(92), *passage]),
        (2, [*passage, *gap(93), *passage, *gap(94), *changed_passage, *gap(95), *near]),
        (3, [*gap(96), *prose(97, 70).split(" "), *gap(98), *prose(97, 70).split(" ")]),
        (4, ["so", "on"] * 60),
        (5, [*prose(101, 60).split(" "), *gap(102), *prose(101, 60).split(" "), *prose(103, 2000).split(" ")]),
    ]
    texts = [(i, " ".join(words)) for i, words in texts]
    got, wanted = covered(spark, texts), brute_covered(texts)
    assert all(places <= got[doc_id] for doc_id, places in wanted.items()) and wanted[2] and wanted[3] and wanted[4]
    assert got[2] >= {*range(60), *range(105, 165), *range(315, 376)} and not got[2] & {*range(175, 200)}
    assert got[5] == {*range(105, 165)}


def test_near_passages_are_found(spark):
    """Passages of the least length at the least similarity: one word of 50 changed, 41 of 51 shingles."""
    texts, trials = [], 400
    for i in range(trials):
        passage = prose(1000 + i, 50).split(" ")
        other = [w if k != 9 + i % 32 else "odd" for k, w in enumerate(passage)]
        texts += [(k, " ".join([*prose(5000 + k, 60).split(" "), *words, *prose(9000 + k, 60).split(" ")])) for k, words in ((i, passage), (trials + i, other))]
        assert likeness(passage, other) == 41 / 51
    got = covered(spark, texts)
    assert sum(got[trials + i] >= set(range(60, 110)) for i in range(trials)) >= 0.985 * trials


def near_covered(texts):
    """Places of each document that a match with any earlier document, or an earlier place, covers: all places of every
    signature that two texts share are compared."""
    known, out = [], defaultdict(set)
    for doc_id, text in sorted(texts):
        mine = substring_dedup.Text(substring_dedup.WordHashes().of(text))
        places = defaultdict(list)
        for key, at in zip(*substring_dedup.seeds(mine.words)):
            places[key].append(at)
        for other, other_places in [*known, (mine, places)]:
            met = sorted((i, j) for k in places.keys() & other_places.keys() for i in places[k] for j in other_places[k] if other is not mine or j < i)
            for begin, end, _, _ in substring_dedup.matches_at(substring_dedup.Pair(mine, other, int(other is mine)), met) if met else []:
                out[doc_id].update(range(begin, end))
        known.append((mine, places))
    return out


def test_passages_unlike_the_first_place_of_their_lists(spark):
    """All signatures of the second and third passage stand in the first text too, which matches neither of them."""
    texts = []
    for i in range(0, 60, 6):
        p = prose(20000 + i, 50).split(" ")
        around = lambda k, words: " ".join([*prose(30000 + k, 60).split(" "), *words, *prose(40000 + k, 60).split(" ")])
        versions = [p[:37], p, [*p[:37], "odd", *p[38:]], p[:37], [*p[:37], *p[38:], "even"], [*p[:37], "new", *p[38:]]]
        texts += [(i + k, around(i + k, words)) for k, words in enumerate(versions)]
    got, wanted = covered(spark, texts), near_covered(texts)
    assert all(wanted[i + 2] >= set(range(60, 110)) and wanted[i + 5] >= set(range(60, 110)) for i in range(0, 60, 6))
    assert all(places <= got[doc_id] for doc_id, places in wanted.items())
    assert not any(got[i] or got[i + 1] or got[i + 3] for i in range(0, 60, 6))


@pytest.mark.parametrize("block", [512, 7])
def test_all_near_passages_are_covered(spark, monkeypatch, block):
    """Common lines, near copies of several families, families that share passages, repeats inside a text."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    pick, texts = random.Random(77), []
    lines = [prose(50000 + i, n).split(" ") for i, n in enumerate((26, 30, 44, 48, 60, 90, 150))]
    for i in range(150):
        words = prose(51000 + i, pick.randrange(5, 30)).split(" ")
        for _ in range(pick.randrange(1, 5)):
            line = list(pick.choice(lines))
            for _ in range(pick.choice((0, 1, 1, 2, 3))):
                k = pick.randrange(len(line))
                line[k : k + pick.randrange(2)] = [f"new{pick.randrange(40)}"] * pick.randrange(2)
            words += [*line[pick.choice((0, 0, 5)) :], *prose(pick.randrange(10**6), pick.choice((0, 1, 4, 20))).split(" ")]
        texts.append((i, " ".join(words)))
    texts += [(200 + i, texts[i][1]) for i in range(0, 150, 10)]
    got, wanted = covered(spark, texts), near_covered(texts)
    assert sum(map(len, wanted.values())) > 10000
    assert all(places <= got[doc_id] for doc_id, places in wanted.items())


def test_filter_of_pairs_keeps_all_that_match():
    """Whatever word of a match is not covered yet, the pair of texts is not left out."""
    pick, seen = random.Random(9), 0
    for i in range(300):
        p = prose(60000 + i, pick.randrange(50, 130)).split(" ")
        x, y = list(p), list(p)
        for words in (x, y):
            for _ in range(pick.randrange(3)):
                k = pick.randrange(len(words))
                words[k : k + pick.randrange(3)] = [f"new{pick.randrange(9)}"] * pick.randrange(3)
        x, y = prose(61000 + i, 30).split(" ") + x + prose(62000 + i, 30).split(" "), prose(63000 + i, 9).split(" ") + y
        mine, other = hashed(x), hashed(y)
        at = np.flatnonzero(np.isin(mine.names, other.names))
        for begin, end, _, _ in aligned_around(x, y) if i < 40 else substring_dedup.matched(substring_dedup.Pair(mine, other).aligned(int(at[len(at) // 2]), int(np.flatnonzero(other.names == mine.names[at[len(at) // 2]])[0]))):
            for place in {begin, end - 1, pick.randrange(begin, end)}:
                seen += 1
                assert substring_dedup.may_add(at, np.concatenate([[0], np.cumsum(np.arange(len(x)) == place)]))
    assert seen > 300


def test_all_near_passages_are_candidates():
    """One word of 50 changed: every pair has a signature in common, at the same place of the passage."""
    draw = np.random.default_rng(12)
    words = lambda n: draw.integers(0, 1 << 60, n).astype(np.uint64)
    for i in range(4000):
        passage, (begin, other_begin) = words(50), draw.integers(0, 80, 2)
        changed = passage.copy()
        changed[i % 50] += np.uint64(1)
        places = []
        for start, inner in ((begin, passage), (other_begin, changed)):
            keys, at = substring_dedup.seeds(np.concatenate([words(start), inner, words(40)]))
            places.append(set(zip(keys.tolist(), (at - start).tolist())))
        assert places[0] & places[1]


def test_texts_are_signed_together():
    """Words are looked up and runs are hashed for many texts at once, as for each text alone."""
    draw = np.random.default_rng(4)
    texts = [None, "", " ", "A b\x0ba\x1cA \u00c9 \u00e9", *(prose(k, 40 * k) for k in range(9))]
    texts += [" ".join(draw.choice(["a", "b", "C"], n)) for n in draw.integers(0, 200, 60)]
    together, starts = SliceHashes().of(texts)
    alone = [WordHashes().of(t) for t in texts]
    assert [together[a:b].tolist() for a, b in zip(starts, starts[1:])] == [a.tolist() for a in alone]
    for find in (substring_dedup.seeds, substring_dedup.picked):
        got, want = find(together, starts), [find(a) for a in alone]
        place = 1 if find is substring_dedup.seeds else 2
        for k, column in enumerate(got):
            moved = [(w[k].astype(np.int64) + (start if k >= place else 0)).tolist() for w, start in zip(want, starts)]
            assert column.astype(np.int64).tolist() == [v for m in moved for v in m]


def test_centres_are_those_of_compact_windows():
    draw = np.random.default_rng(5)
    for most in (1, 2, 3, 10, 1000):
        for n in range(0, 60, 3):
            values = draw.integers(1, most + 1, n).astype(np.uint64)
            assert substring_dedup.centres(values, 7).tolist() == substring_dedup.compact_windows(values, 7)[1].tolist()


def test_entries_move_once(spark):
    """Signatures go through one shuffle and no join until they meet the first place of their list."""
    entries = spark.createDataFrame([(k % 3, k, 0, 7) for k in range(9)], "key long, doc_id long, part long, at int")
    met = substring_dedup.behind_first(entries, ["key"], "at")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted((r.key, r.doc_id, r.first.doc_id) for r in met.collect()) == sorted((k % 3, k, k % 3) for k in range(3, 9))


def test_matches_have_a_long_equal_run():
    pick, seen = random.Random(8), 0
    for _ in range(20000):
        runs, i, j = [], 0, 0
        for _ in range(pick.randrange(1, 6)):
            n = pick.randrange(5, 40)
            runs.append((i, j, n))
            gap = pick.choice([(1, 0), (0, 1), (1, 1), (2, 1)])
            i, j = i + n + gap[0], j + n + gap[1]
        for begin, end, _, _ in substring_dedup.matched(runs):
            seen += 1
            assert max(n for b, _, n in runs if begin <= b < end) >= substring_dedup.ALIKE
    assert seen > 100


def test_longest_similar_stretch():
    pick = random.Random(6)
    for _ in range(300):
        runs, i, j = [], 0, 0
        for _ in range(pick.randrange(1, 9)):
            n = pick.randrange(5, 60)
            runs.append((i, j, n))
            i, j = i + n + pick.randrange(4), j + n + pick.randrange(1, 4)
        best = 0
        for p, q in itertools.combinations_with_replacement(range(len(runs)), 2):
            same = sum(n - 4 for _, _, n in runs[p : q + 1])
            lost = sum(b[0] - a[0] + b[1] - a[1] - 2 * a[2] + 8 for a, b in zip(runs[p:q], runs[p + 1 : q + 1]))
            if same >= 4 * lost:
                best = max(best, min(runs[q][k] + runs[q][2] - runs[p][k] for k in (0, 1)))
        got = substring_dedup.matched(runs)
        assert len(got) > 0 if best >= 50 else not got
        if got:
            assert got[0][1] - got[0][0] >= best and all(similarity >= 0.8 for *_, similarity in got)


def test_compact_windows():
    pick = np.random.default_rng(3)
    for n in (1, 5, 40, 200):
        values = pick.integers(0, n // 2 + 1, n).astype(np.uint64)
        begin, centre, end = substring_dedup.compact_windows(values, 4)
        seen = Counter()
        for b, c, e in zip(begin, centre, end):
            for i in range(b, c + 1):
                for j in range(c, e + 1):
                    seen[i, j] += 1
                    assert values[c] == values[i : j + 1].min()
        assert all(seen[i, j] == 1 for i in range(n) for j in range(i + 3, n))


def test_chat_round_trip(spark):
    pieces = ["\\", "### Assistant:\n", "</turn>", "<part image 1/>", "\\h", "\\\\e", ":\n", "#", "x", "é😀", "\n", " "]
    pick = random.Random(5)
    turns = []
    for conv in range(30):
        for turn in range(pick.randrange(1, 5)):
            text = "".join(pick.choice(pieces) for _ in range(pick.randrange(9)))
            turns.append((conv, pick.choice([turn, None]), pick.choice(["user", "assistant", "", None, "a:\nb"]), pick.choice([text, None])))
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chats = chat.formatted(frame)
    found = {r.conv_id: r for r in chats.collect()}
    assert {r.conv_id: r.loss_chars for r in chat.read_back(chats).collect()} == {
        c: sum(len(t[3] or "") for t in turns if t[0] == c and t[2] == "assistant") for c in found
    }
    for conv, row in found.items():
        mine = sorted(
            ((t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] or "") for t in turns if t[0] == conv),
        )
        assert chat.read_turns(row.formatted) == [(role, text) for _, _, _, role, text in mine]
    assert chat.formatted(frame.limit(0)).count() == 0


def test_chat_parts(spark):
    part = "array<struct<type:string,text:string,uri:string,units:double>>"
    parts = [("text", "see <part image 1/>", None, None), ("image", None, "s3://x/1.png", 2.0), ("audio", None, "a.wav", 1.5), ("video", None, "v", 3.0)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {part}")
    row = chat.formatted(frame).first()
    assert row.formatted == "### user:\nsee \\pimage 1/><part image 1/><part audio 2/><part video 3/>\n</turn>\n### assistant:\n\n</turn>\n"
    assert [(a.number, a.type, a.tokens) for a in row.attachments] == [(1, "image", 512), (2, "audio", 38), (3, "video", 0)]
    assert row.attached_tokens == 550 and [(m.begin, m.length) for m in row["mask"]] == [(row.formatted.rindex("\n\n</turn>") + 1, 0)]


def test_html_layout(spark):
    page = """<!doctype html><html><head><title>A &amp; B</title><style>.x, #y{display:none}</style><body><h1>Head</h1><p>One<b> two
    <p>three<br>four <span class=x>no</span><ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>tail<table><tr><td>name<td>value
    <tr><td>longer name<td>1<tr><td colspan=2>all</table><pre> a\n  b</pre><details><summary>S</summary>hid</details><div hidden>no</div>
    <script>if(a<b)"</p>"</script><p style="display: none">no</p>end &copy; <"""
    title, text = html_layout.page_text(page)
    assert title == "A & B"
    assert text == (
        "Head\n\nOne two\n\nthree\nfour\n\n- a\n- b\n  3. x\n  4. y\n- c\n\ntail\n\nname         value\nlonger name  1\nall\n\n a\n  b\n\nS\nend © <"
    )
    assert html_layout.page_text("<div><b>" * 20000 + "x" + "</p>" * 20000)[1] == "x"
    frame = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", "a  <b>c</i> d"), (3, "v", "a  <b>c</i> d")], "page_id long, url string, html string")
    got = html_layout.visible_text(frame).collect()
    assert sorted((r.page_id, r.text, r.n_lines) for r in got) == [(1, "", 0), (2, "", 0), (3, "a c d", 1), (3, "a c d", 1)]
    assert html_layout.visible_text(frame.limit(0)).count() == 0


def test_html_head_without_end():
    text = lambda page: html_layout.page_text(page)
    assert text("<html><head><title>T</title><h1>News</h1><p>text") == ("T", "News\n\ntext")
    assert text("<head><meta charset=x>\n<style>.x{display:none}</style> free <b>text</b><p class=x>no") == ("", "free text")
    assert text("<head><template><div>no</div></template><script>no</script><title>T</title></head><body>yes") == ("T", "yes")
    assert text("<head><title>T</title><body>one<head>two</head>three") == ("T", "onetwothree")


def test_html_media_rules():
    page = "<head><style>{}</style><body><p class=nav>nav<p class=x>x"
    text = lambda css: html_layout.page_text(page.replace("{}", css))[1].split()
    for condition in ("print", "(max-width: 600px)", "screen and (max-width:40em)", "not all", "not screen", "speech, print", "(width < 50rem)", "(odd)"):
        assert text(f"@media {condition}{{.nav,article{{display:none}}}} .x{{display:none}}") == ["nav"], condition
    for condition in ("screen", "all", "only screen and (min-width:600px)", "print, screen", "not print", "(600px <= width <= 2000px)", "not (odd)"):
        assert text(f"/* }} */ @import url(a;b); @media {condition}{{.nav{{color:red;display:none}}}}") == ["x"], condition
    assert text("@supports (display:grid){@media print{.x{display:none}} .nav{display:none}}") == ["x"]
    assert text("@keyframes k{from{display:none}} @media print{.x{display:none}") == ["nav", "x"]
    assert html_layout.page_text("<style media=print>p{display:none}</style><p>a")[1] == "a"


def test_raking():
    random_weights = np.random.default_rng(1).random((4, 3, 2)) * np.array([1, 5, 2, 9])[:, None, None]
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.3, 0.7])]
    fitted = mixing.rake(random_weights, targets)
    for axis, target in enumerate(targets):
        assert np.allclose(fitted.sum(axis=tuple(i for i in range(3) if i != axis)), target, atol=1e-6)
    factors = fitted * random_weights.sum() / random_weights
    scale = mixing.keeping_factor(random_weights, factors, 0.8)
    assert abs((random_weights * np.minimum(1, scale * factors)).sum() / random_weights.sum() - 0.8) < 1e-6


def test_sampling(docs, none):
    got = mixing.sampled(docs).toPandas()
    assert len(got) == len(rows())
    tokens = {i: len((t or "").split()) for i, t, *_ in rows() if i not in (4, None)}
    assert {i: n for i, n in zip(got.doc_id, got.tokens) if i in tokens} == tokens
    assert abs((got.tokens * got.probability).sum() / got.tokens.sum() - mixing.KEEP) < 1e-4
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and kept.count() == int(got.sampled.sum())
    assert mixing.sampled(none).count() == 0 and mixing.mixed(none).count() == 0


def test_weights_meet_the_marginals(spark):
    full = [(i, prose(i, 250 + i % 40), ("en", "de")[i % 2], ("a", "b", "c")[min(i % 5, 2)], None) for i in range(120)]
    full += [(200 + i, prose(i, 5), ("en", "de")[i % 2], ("a", "b", "c")[i % 3], None) for i in range(12)]
    got = mixing.sampled(spark.createDataFrame(full, SCHEMA)).toPandas()
    for dim, power in mixing.POWERS.items():
        before = got.groupby(dim).tokens.sum() / got.tokens.sum()
        wanted = before**power / (before**power).sum()
        after = (got.tokens * got.weight).groupby(got[dim]).sum()
        assert np.allclose(after[wanted.index] / after.sum(), wanted, atol=1e-6)


def test_every_source_meets_its_marginal(spark, monkeypatch):
    """More sources than fit any list of the largest: each has its own share, on the driver and as tables."""
    few = [(i, prose(i, 3 + i % 7 + 12 * (i % 350 < 5)), ("en", "de")[i // 350 % 2], f"s{i % 350}", None) for i in range(1400)]
    docs = spark.createDataFrame(few, SCHEMA)
    frames = [mixing.sampled(docs).toPandas()]
    monkeypatch.setattr(mixing, "MOST_CELLS", 100)
    monkeypatch.setattr(mixing, "ROUNDS", 6)
    frames.append(mixing.sampled(docs).toPandas())
    for got in frames:
        before = got.groupby("source").tokens.sum() / got.tokens.sum()
        wanted = before**0.5 / (before**0.5).sum()
        after = (got.tokens * got.weight).groupby(got.source).sum()
        assert np.abs(after / after.sum() - wanted).max() < 1e-5
        assert abs((got.tokens * got.probability).sum() / got.tokens.sum() - mixing.KEEP) < 1e-4
    one, two = (f.sort_values("doc_id") for f in frames)
    assert np.allclose(one.weight, two.weight, rtol=1e-3) and np.allclose(one.probability, two.probability, rtol=1e-3)


def test_given_targets_of_many_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 12), "en", f"s{i % 300}", None) for i in range(600)], SCHEMA)
    rows = mixing.weighed(docs)
    targets = {"source": {f"s{k}": 1.0 + k % 3 for k in range(300)}}
    for most in (mixing.MOST_CELLS, 100):
        monkeypatch.setattr(mixing, "MOST_CELLS", most)
        got = mixing.fitted_cells(rows, {"source": 1.0}, 0.5, targets).toPandas().set_index("source")
        assert len(got) == 300 and got.probability.min() > 0
        assert all(abs(got.weight[f"s{k}"] - (1 + k % 3) / 2) < 1e-9 for k in range(300))


def test_non_negative_risk():
    pick = np.random.default_rng(2)
    positive = [[0, int(x)] for x in pick.integers(2, 30, 60)]
    unlabelled = [[int(x), int(y)] for x, y in pick.integers(1, 30, (300, 2))] + positive[:30]
    weights, bias = toxicity.fit(toxicity.Sparse(positive, 30), toxicity.Sparse(unlabelled, 30), 0.1)
    margins = [(toxicity.Sparse(r, 30).times(weights) + bias).mean() for r in (positive, unlabelled[:300])]
    assert margins[0] > 0 > margins[1] and weights[0] > 1.5 * np.abs(weights[1:]).max()


@pytest.fixture(scope="module")
def toxic(spark):
    marked = [(i, f"{prose(i, 40)} {'Rotten' if i % 9 == 0 else 'fine'}, {prose(i + 5000, 20)}", i % 9 == 0) for i in range(900)]
    texts = [(i, t, "en", "s", None) for i, t, _ in marked] + [(None, None, None, None, None), (2000, "", "en", "s", 0)]
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in marked if i % 2 or b] + [(None, 1), (5, None), (9, 0)], "doc_id long, toxic int")
    return spark.createDataFrame(texts, SCHEMA), labels, {i for i, _, b in marked if b}


def test_toxicity(toxic, none):
    texts, labels, bad = toxic
    got = toxicity.scored(texts, labels).collect()
    assert len(got) == 902 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.doc_id for r in got if r.predicted} == bad
    assert toxicity.clean(texts, labels).count() == 902 - len(bad)
    assert {r.score for r in toxicity.scored(texts, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.scored(none, labels).count() == 0 and toxicity.clean(none, labels).count() == 0
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert [(r.doc_id, r.score) for r in toxicity.scored(texts, flipped).collect()] == [(r.doc_id, r.score) for r in got]


def test_clean_scores_short_slices(spark, monkeypatch):
    class Checked(toxicity.Model):
        def scores(self, rows):
            assert len(rows) <= 256
            return np.array([0.9 if row else 0.1 for row in rows])

    monkeypatch.setattr(toxicity, "train", lambda docs, labels: Checked(["=bad"], np.zeros((1, 1)), np.zeros(1), 0.1))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "so Bad").when(F.col("id") % 3 == 1, "fine").alias("text"), F.current_timestamp().alias("at"))
    kept = toxicity.clean(docs.coalesce(1), docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i in range(3000) if i % 3}


def test_pipeline_stages(spark, toxic, tmp_path):
    texts, labels, bad = toxic
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = texts.unionByName(spark.createDataFrame(rows(), SCHEMA).withColumn("doc_id", F.col("doc_id") + 5000))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == before.columns and docs.exceptAll(before).count() == 0 and 0 < docs.count() < before.count(), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, last)) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert not bad & {r.doc_id for r in last} and len(last) == docs.count()


SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    from tests.oracle import compare, connect

    assert compare(connect(SF_DIR), queries.ORACLES[name], queries.QUERIES[name](spark, SF_DIR)) == ""


def test_all_queries_are_there():
    assert [q.split("_")[0] for q in queries.QUERIES] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]
    assert len(corpus_pipeline.STAGES) == 5
