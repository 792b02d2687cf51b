"""Periodic runs, collocations and quality rules against brute force, on odd rows, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektorloom.llm import collocations, periodic_runs, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def loops(seed, count):
    """Word sequences of few words with loops in them, at the borders, in each other and next to each other."""
    pick, out = random.Random(seed), []
    for _ in range(count):
        k = pick.choice([1, 2, 2, 3, 5, 40])
        words = [f"w{pick.randrange(k)}" for _ in range(pick.randrange(150))]
        for _ in range(pick.randrange(4)):
            base = [f"w{pick.randrange(k + 1)}" for _ in range(pick.randrange(1, 12))]
            at = pick.randrange(len(words) + 1)
            words[at:at] = (base * 9)[: pick.randrange(10, 70)]
        out.append(words)
    return out


def all_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and not any(w[i : j + q - r] == w[i + r : j + q] for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def documents(spark):
    said = [(i, " ".join(w)) for i, w in enumerate(loops(1, 250))]
    said += [(9000, None), (9001, ""), (9002, " \n\t\v\f\r "), (None, " ".join(["é", "ß"] * 20)), (None, None), (9003, "A a " * 30)]
    said += [(9004, "x y\x1cz " * 24), (7, "same id " * 20), (7, "same id " * 20), (9005, " ".join(f"v{i % 7000}" for i in range(30000)))]
    rows = [(i, t, "en", "a", None) for i, t in said]
    clash = [F.lit(3).alias(c) for c in ("row", "said", "runs", "words", "n_words", "best", "votes", "n_lines", "good", "n", "name", "path", "f", "a")]
    return said, spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *clash)


def test_runs_against_brute_force(spark, monkeypatch):
    said, docs = documents(spark)
    found = periodic_runs.with_runs(docs)
    assert set(found.columns) == {*docs.columns, "collapsed"} and found.where("source = 'a' AND row = 3 AND said = 3").count() == len(said)
    got = Counter((r.doc_id, tuple((x.start, x["length"], x.period) for x in r.runs), r.collapsed, r.n_words) for r in found.collect())
    expected = Counter()
    for doc_id, text in said:
        words = WORD.findall(text or "")
        runs = all_runs(words) if doc_id != 9005 else [(0, 30000, 7000)]
        stay = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        expected[(doc_id, tuple(runs), " ".join(stay), len(words))] += 1
    assert got == expected and sum(map(bool, (k[1] for k in got))) > 100
    assert periodic_runs.with_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_run_digests_against_brute_force(spark):
    said, docs = documents(spark)
    expected = Counter()
    for doc_id, text in said:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = all_runs(words) if n < 5000 else [(0, 30000, 7000)]
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        lines = "".join("{},{},{}\n".format(*r) for r in runs)
        stay = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        milli = 1000 * best[1] // best[2] if runs else None
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(stay))]
        expected[(doc_id, len(runs), *best, milli, *digests)] += 1
    out = periodic_runs.run_digests(docs)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, out.collect())) == expected
    assert periodic_runs.run_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_loops_are_the_contracts(spark):
    texts = [(i, " ".join(f"v{k}" for k in range(i % 50))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", "text", periodic_runs.looped(F.col("doc_id"), F.col("text")).alias("new"))
    rewritten = 0
    for r in docs.collect():
        h, words = zlib.crc32(str(r.doc_id).encode()), r.text.split()
        n = len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            rewritten += 1
        assert r.new.split() == words
    assert rewritten > 15


def test_very_long_runs():
    """A loop of two million words, and one of a word that fills the text."""
    from vektorloom.llm.factors import joined

    base = [b"%d" % i for i in range(600_000)]
    words, _ = joined([base * 3 + base[:200_000], [b"x"] * 100_000])
    start, length, period = periodic_runs.runs_of(words, 2_000_000)
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == [(0, 2_000_000, 600_000), (2_000_001, 100_000, 1)]


def phrases_by_hand(rows, least, top, covered):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in often.items():
            longer = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if len(p) < 2 or any(100 * b >= covered * a for b in longer):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def talk(seed):
    pick = random.Random(seed)
    stock = ["the the the the", "New York Times", "in the house", "a", "b", "é è", "x.y", "one, two", "tab\tbed", "form\x0bfeed", "to\x1cbe", "the", "the"]
    rows = [(pick.choice(["en", "de", None, "", "und"]), " ".join(pick.choice(stock) for _ in range(pick.randrange(60)))) for _ in range(250)]
    return [*rows, ("en", None), ("en", ""), (None, None), ("fr", " . ;\n"), *rows[:3]]


@pytest.mark.parametrize("least, top, hot", [(3, 2000, None), (5, 7, 4), (20, 2000, 30)])
def test_collocations_against_brute_force(spark, monkeypatch, least, top, hot):
    rows = talk(least)
    if hot:  # most prefixes exceed the budget of a subtree
        monkeypatch.setattr(collocations, "SUBTREE", hot)
    docs = spark.createDataFrame([(i, t, lang, "a", None) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(5)
    clash = [F.lit(3).alias(c) for c in ("name", "word", "n", "rank", "path", "f", "subtree")]
    got = sorted(map(tuple, collocations.collocations(docs.select("*", *clash), least, top).collect()))
    assert got == phrases_by_hand(rows, least, top, 80) and len({r[0] for r in got}) == 4
    assert any(len(r[2].split()) == 4 for r in got) or top < 100


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b c", "en", "s", 5)], SCHEMA)).count() == 0


def test_walk_closes_nodes_over_blocks():
    pick = np.random.default_rng(5)
    leaves = pick.integers(0, 3, (400, 5))
    leaves = leaves[np.lexsort(leaves.T[::-1])]
    n = pick.integers(1, 9, 400)
    for depth in (4, 5):
        level, found = collocations.Level(depth), Counter()
        cuts = [0, 0, 1, 2, 90, 90, 91, 400]
        parts = [level.passed(leaves[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        for paths, totals in [*parts, level.closed()]:
            for path, total in zip(paths.tolist(), totals.tolist(), strict=True):
                assert tuple(path) not in found
                found[tuple(path)] = total
        expected = Counter()
        for path, k in zip(leaves[:, :depth].tolist(), n.tolist(), strict=True):
            expected[tuple(path)] += k
        assert found == expected


def test_shared_names_take_another_seed(spark, monkeypatch):
    seeds = []

    def words(texts, seed):
        seeds.append(seed)
        return spark.createDataFrame([("en", "a", 1, 3), ("en", "b", 2 if seed else 1, 3)], "lang string, word string, name long, n long")

    monkeypatch.setattr(collocations, "counted_words", words)
    assert collocations.vocabulary(None)[1] == 1 and seeds == [0, 1]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**18
    rows = [([1], 3 * big), ([2], 2 * big), ([3], 2 * big + 1), ([1, 2], big + 7), ([2, 3], big + 5), ([1, 2, 3], big)]
    phrases = spark.createDataFrame(rows, "path array<bigint>, f bigint")
    got = {tuple(r.path): (r.score, r.l, r.r) for r in collocations.scored(phrases).collect()}
    assert got[(1, 2)] == (2000000 * (big + 7) // (5 * big), 3 * big, 2 * big)
    assert got[(1, 2, 3)] == (2000000 * big // (4 * big + 5), 3 * big, big + 5)
    left = collocations.uncovered(collocations.scored(phrases), phrases)
    assert [tuple(r.path) for r in left.collect()] == [(1, 2, 3)]


def counts_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_counts_against_brute_force(spark):
    said, docs = documents(spark)
    pick = random.Random(4)
    odd = ["a\nb\na\n\n\na \na", "#a|b <c> $ % & *", "É É!! É x", "\r\n".join(["one two"] * 5), "the " * 7, "the " * 8, "the " * 9]
    odd += ["\n".join(pick.choice(["x y", "z", "", " "]) for _ in range(30)) for _ in range(40)]
    extra = spark.createDataFrame([(20000 + i, t, "en", "a", None) for i, t in enumerate(odd)], SCHEMA)
    texts = Counter((i, *counts_by_hand(t)) for i, t in [*said, *((20000 + i, t) for i, t in enumerate(odd))])
    out = quality_rules.kept(docs.select(*extra.columns).unionByName(extra)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == texts
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.good >= 0.5)
    judged = quality_rules.judged(docs)
    assert {*docs.columns} - {"text"} <= {*judged.columns} and judged.where("n_lines <> 3 AND row = 3").count() == len(said)
    assert quality_rules.kept(spark.createDataFrame([], SCHEMA)).count() == 0
    empty = quality_rules.kept(docs.where("doc_id >= 9000 AND doc_id < 9003")).collect()
    assert len(empty) == 3 and not any(r.kept for r in empty)


def em_by_hand(votes, rounds=200):
    """The same model, text by text."""
    rules = len(votes[0])
    belief = [0.75 if "b" in v else 0.05 for v in votes]
    for _ in range(rounds):
        prior = (sum(belief) + 1) / (len(votes) + 2)
        bad, good = [], []
        for j in range(rules):
            voted = [(p, v[j]) for p, v in zip(belief, votes, strict=True) if v[j] != "-"]
            good.append((sum(1 - p for p, x in voted if x == "b") + 0.2) / (sum(1 - p for p, _ in voted) + 4))
            bad.append(max(good[-1], (sum(p for p, x in voted if x == "b") + 2) / (sum(p for p, _ in voted) + 4)))
        belief = []
        for v in votes:
            one, two = prior, 1 - prior
            for j, x in enumerate(v):
                one *= {"b": bad[j], "g": 1 - bad[j], "-": 1}[x]
                two *= {"b": good[j], "g": 1 - good[j], "-": 1}[x]
            belief.append(one / (one + two))
    return prior, bad, good, belief


def test_estimation_against_rows(spark):
    pick = random.Random(8)
    truth = [pick.random() < 0.2 for _ in range(600)]
    chance = [(0.7, 0.02), (0.5, 0.05), (0.9, 0.1), (0.3, 0.01)]
    votes = ["".join(pick.choice("bg-") if pick.random() < 0.05 else "b" if pick.random() < chance[j][not t] else "g" for j in range(4)) for t in truth]
    prior, bad, good, belief = em_by_hand(votes)
    got = quality_rules.estimated(dict(Counter(votes)))
    assert abs(got.bad - prior) < 1e-6 and np.allclose(got.of_bad, bad, atol=1e-6) and np.allclose(got.of_good, good, atol=1e-6)
    rows = spark.createDataFrame(list(zip(range(600), votes, strict=True)), "i long, v string").select("i", got.good(F.col("v")).alias("good")).collect()
    assert np.allclose([r.good for r in sorted(rows)], 1 - np.array(belief), atol=1e-6)
    right = sum((p > 0.5) == t for p, t in zip(belief, truth, strict=True))
    assert right >= 560 and all(b > g for b, g in zip(got.of_bad, got.of_good, strict=True))


def test_verdicts_agree_with_labels(spark):
    """No label is used for the verdicts; of the labelled texts that the base rules let pass, few are judged wrongly."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = quality_rules.kept(docs).join(labels, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    good, bad = [r for r in seen if r.quality == 1], [r for r in seen if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) > 100
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad) > 10
