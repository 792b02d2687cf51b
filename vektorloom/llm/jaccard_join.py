"""Exact Jaccard join of shingle sets by block lists, with answers derived from a similar set's answers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektorloom.llm.common import join_groups, map_rows, sent_if_few, settled, settled_in
from vektorloom.llm.components import components
from vektorloom.llm.words import WordHashes, mixed, shingles, signed
from vektorloom.session import remove_folder

#: Size classes grow by this factor, so that sets of one link lie in the same or in neighbouring classes.
GROWTH = 1.25

#: Factor between the steps of excess.
STEP = 1.1

#: Sets of a list whose pairs are all answered at once: in the first round, and at most (twice as many in each round).
CLOSED, MOST_CLOSED = 8, 64

#: What a set's entries are made from.
ENTRY = ("cls", "comp", "lead", "excess", "step", "steps", "diff")


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles link when ``of * |intersection| >= part * |union|``.

    With N elements in both sets together and D in only one of them this is ``(of + part) * D <= (of - part) * N``.
    """

    words: int = 5
    part: int = 4
    of: int = 5

    @property
    def per_difference(self) -> int:
        return self.of + self.part

    @property
    def per_element(self) -> int:
        return self.of - self.part

    def differences(self, size: int, largest: int) -> int:
        """How many elements a set of this size and a linked one up to ``largest`` can differ in."""
        return self.per_element * (size + largest) // self.per_difference

    def blocks(self, largest: int) -> int:
        """A third more blocks than linked sets up to this size can differ in, so that small blocks need no list."""
        most = self.differences(largest, largest)
        return most + most // 3 + 2


def size_edges() -> np.ndarray:
    """Smallest sizes of the size classes."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * GROWTH)))
    return np.array(edges)


_EDGES = size_edges()


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    return np.unique(shingles(words, size))


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit name of a set, from its sorted elements."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def block_keys(tokens: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of the index lists that a set belongs to.

    In the order of their hashes, the elements are cut at fixed places into blocks. A list holds the sets that agree
    in one whole block of one size class. A set has part in its own class and in all up to the class of the largest
    set it may link with; so two linked sets share the class of the larger one.

    Of its blocks there, small ones are skipped: a set that can differ from linked ones in d elements joins the lists
    of its d + 1 largest blocks and of all as large as these. Linked sets agree in one of the d + 1 of either set; of
    the two, the set whose least block is the larger one has a block that the other has too, and does not skip.
    Empty blocks and those of single frequent elements, in which unlike sets agree, thus seldom have a list.
    """
    n, out = len(tokens), [np.zeros(0, np.uint64)]
    if not n:
        return out[0]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens), dtype=np.uint64)])
    own, above = np.searchsorted(_EDGES, [n, n * rule.of // rule.part], "right") - 1
    for size_class in range(int(own), int(above) + 1):
        largest = int(_EDGES[size_class + 1]) - 1
        most, blocks = rule.differences(n, largest), rule.blocks(largest)
        if most:  # without a difference, linked sets are equal
            first = np.arange(blocks, dtype=np.uint64) * np.uint64((1 << 64) // blocks)
            cuts = np.append(np.searchsorted(tokens, first), n)
            sizes = np.diff(cuts)
            listed = np.flatnonzero(sizes >= np.partition(sizes, blocks - 1 - most)[blocks - 1 - most])
            place = listed.astype(np.uint64) + np.uint64(size_class << 40)
            out.append(mixed((sums[cuts[listed + 1]] - sums[cuts[listed]]) ^ mixed(place + np.uint64(1))))
    return np.concatenate(out)


def only_in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Elements of the sorted ``x`` that the sorted ``y`` lacks."""
    if not len(x) or not len(y):
        return x
    return x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] != x]


def united(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([x, y]))


def document_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n, cls, keys``: size and name of each document's set, and its lists. Empty sets have no name; sets of
    documents without an id have no lists."""

    def make():
        words = WordHashes()

        def work(rows):
            sets = [shingle_set(words.of(t), rule.words) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"],
                "n": [len(s) for s in sets],
                "cls": [set_id(s) if len(s) else None for s in sets],
                "keys": [signed(block_keys(s, rule)) if i is not None else [] for i, s in zip(rows["doc_id"], sets)],
            }

        return work

    return map_rows(_texts(docs), make, "doc_id long, n long, cls long, keys array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def needed_sets(docs: DataFrame, names: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """``cls, tokens`` (sorted, packed) of the named sets, from one document each."""
    ids = sent_if_few(settled(names.join(classes, "cls").select("doc_id").distinct(), "ids"))

    def make():
        words = WordHashes()

        def work(rows):
            sets = [shingle_set(words.of(t), rule.words) for t in rows["text"]]
            return {"cls": [set_id(s) if len(s) else None for s in sets], "tokens": [s.tobytes() for s in sets]}

        return work

    found = map_rows(_texts(docs).join(ids, "doc_id", "left_semi"), make, "cls long, tokens binary")
    return found.join(names, "cls", "left_semi").dropDuplicates(["cls"])


ANSWER = "cls long, lead long, n long, many boolean, linked boolean, added long, diff binary"


def answer(rows: dict[str, list], differences, rule: Rule) -> dict[str, list]:
    """Answers from what sets and their leaders have alone."""
    out = {c: rows[c] for c in ("cls", "lead", "n", "many")} | {"linked": [], "added": [], "diff": []}
    for n, lead_n, many, (added, missing) in zip(rows["n"], rows["lead_n"], rows["many"], differences):
        differ = rule.per_difference * (len(added) + len(missing))
        out["linked"].append(differ <= rule.per_element * (n + lead_n))
        out["added"].append(len(added))
        out["diff"].append(np.concatenate([added, missing]).tobytes() if many else b"")
    return out


def with_followers(pairs: DataFrame) -> DataFrame:
    """Pairs with ``many``: whether they are ``open`` and their leader has other followers that are; if not, no more is
    derived from them."""
    followers = pairs.groupBy("lead").agg(F.count(F.when(F.col("open"), True)).alias("followers"))
    return pairs.join(followers, "lead").withColumn("many", F.expr("open AND followers > 1"))


def compared(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Each set against the leader of its list: ``cls, lead, n, many, linked, added, diff``.

    ``pairs`` has ``cls, lead, many``. ``diff`` is left empty without ``many``; else it has the elements in only one of
    the two: first ``added`` ones that the leader lacks, then those that only the leader has. All later answers of its
    list are derived from it.
    """
    own = sets.select("cls", F.col("tokens").alias("own"))
    theirs = sets.select(F.col("cls").alias("lead"), F.col("tokens").alias("theirs"))
    met = pairs.join(own, "cls").join(theirs, "lead").select("cls", "lead", "many", "own", "theirs")

    def make():
        def work(rows):
            both = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(rows["own"], rows["theirs"])]
            rows |= {"n": [len(x) for x, _ in both], "lead_n": [len(y) for _, y in both]}
            return answer(rows, ((only_in(x, y), only_in(y, x)) for x, y in both), rule)

        return work

    return map_rows(met, make, ANSWER)


def derived(pairs: DataFrame, departures: DataFrame, rule: Rule) -> DataFrame:
    """The same answers for sets that both have departures from one centre (that of leader ``via``): their difference
    is that of their departures, and the sets themselves are not needed again."""
    own = departures.select("cls", F.col("lead").alias("via"), "n", "added", "diff")
    theirs = own.select(F.col("cls").alias("lead"), "via", F.col("n").alias("lead_n"), F.col("added").alias("lead_added"), F.col("diff").alias("lead_diff"))
    met = with_followers(pairs).join(own, ["cls", "via"]).join(theirs, ["lead", "via"])

    def make():
        def work(rows):
            def differences():
                for added, diff, lead_added, lead_diff in zip(*(rows[c] for c in ("added", "diff", "lead_added", "lead_diff"))):
                    x, y = np.frombuffer(diff, np.uint64), np.frombuffer(lead_diff, np.uint64)
                    x_more, x_less, y_more, y_less = x[:added], x[added:], y[:lead_added], y[lead_added:]
                    yield (
                        united(only_in(x_more, y_more), only_in(y_less, x_less)),
                        united(only_in(y_more, x_more), only_in(x_less, y_less)),
                    )

            return answer(rows, differences(), rule)

        return work

    columns = met.select("cls", "lead", "many", "n", "lead_n", "added", "diff", "lead_added", "lead_diff")
    return map_rows(columns, make, ANSWER)


def centred(answers: DataFrame, rule: Rule) -> DataFrame:
    """Followers of leaders that have not settled all of them: ``cls, lead, n, excess, added, diff``.

    Differences between two sets are the same from any third set, so the leader gives way to its followers' centre:
    the elements that most of them have, of those near the leader if these are the most (any centre gives right
    answers). From there sets that changed in their own ways share next to nothing.
    ``diff`` has the elements in which a set departs from the centre, first the ``added`` ones that the centre lacks,
    and ``excess`` is ``per_difference * |diff| - per_element * |set|``: sets x and y differ in
    |diff x| + |diff y| - 2 |both| elements, so they link exactly if their diffs share at least
    ``(excess x + excess y) / (2 * per_difference)`` elements.
    """
    answers = answers.where("many")
    nearer = F.octet_length("diff") <= 4 * F.col("n")  # 8 bytes an element: differs in half as many as it has
    leads = answers.groupBy("lead").agg(
        F.count("*").alias("followers"), F.min("linked").alias("settled"), F.count(F.when(nearer, True)).alias("nearer")
    )
    few_near = F.col("nearer") * 2 < F.col("followers")
    voters = F.when(few_near, F.col("followers")).otherwise(F.col("nearer")).alias("voters")
    unsettled = answers.join(leads.where("NOT settled").select("lead", "nearer", few_near.alias("all_vote"), voters), "lead")

    def elements():
        def work(rows):
            out = {"lead": [], "followers": [], "element": [], "missing": []}
            for lead, followers, added, diff in zip(rows["lead"], rows["voters"], rows["added"], rows["diff"]):
                found = signed(np.frombuffer(diff, np.uint64))
                out["lead"] += [lead] * len(found)
                out["followers"] += [followers] * len(found)
                out["element"] += found
                out["missing"] += [False] * added + [True] * (len(found) - added)
            return out

        return work

    columns = unsettled.where(nearer | F.col("all_vote")).select("lead", "voters", "added", "diff")
    counts = map_rows(columns, elements, "lead long, followers long, element long, missing boolean")
    counts = counts.groupBy("lead", "followers", "element", "missing").count().where("2 * count > followers")
    moved = counts.groupBy("lead").agg(F.collect_list(F.struct("element", "missing")).alias("moved"))

    def make():
        def work(rows):
            out = {"cls": rows["cls"], "lead": rows["lead"], "n": rows["n"], "excess": [], "added": [], "diff": []}
            for n, added, diff, moved in zip(rows["n"], rows["added"], rows["diff"], rows["moved"]):
                elements = np.frombuffer(diff, np.uint64)
                flips = [np.sort(np.array([m["element"] for m in moved or [] if m["missing"] is side], np.int64).view(np.uint64)) for side in (False, True)]
                # an element that the centre has against the leader departs for those that agree with the leader
                more = united(only_in(elements[:added], flips[0]), only_in(flips[1], elements[added:]))
                less = united(only_in(elements[added:], flips[1]), only_in(flips[0], elements[:added]))
                out["excess"].append(rule.per_difference * (len(more) + len(less)) - rule.per_element * n)
                out["added"].append(len(more))
                out["diff"].append(np.concatenate([more, less]).tobytes())
            return out

        return work

    met = unsettled.join(moved, "lead", "left").select("cls", "lead", "n", "added", "diff", "moved")
    return map_rows(met, make, "cls long, lead long, n long, excess long, added long, diff binary")


def cores(departures: DataFrame) -> DataFrame:
    """``departures`` with the set nearest to the centre (``core``), the ``step`` of a set's excess, and per leader the
    ``steps`` with the least excess and the most departures of each.

    Two sets whose excesses add up to zero or less link without sharing departures, and then both link with the core:
    these have step 0. The others are put into steps in which the excess grows by the factor STEP.
    """
    least = departures.groupBy("lead").agg(F.min("excess").alias("least"), F.min_by("cls", F.struct("excess", "cls")).alias("core"))
    near = F.col("excess") + F.col("least") <= 0
    step = F.when(near, 0).otherwise(1 + F.floor(F.log(F.greatest(F.col("excess"), F.lit(1))) / F.log(F.lit(STEP)))).cast("int")
    stepped = departures.join(least, "lead").withColumn("step", step).drop("least")
    most = F.max(F.shiftright(F.octet_length("diff"), 3)).alias("most")
    steps = stepped.groupBy("lead", "step").agg(F.min("excess").alias("least"), most)
    return stepped.join(steps.groupBy("lead").agg(F.collect_list(F.struct("step", "least", "most")).alias("steps")), "lead")


def derived_entries(departures: DataFrame, marks: DataFrame, rule: Rule) -> DataFrame:
    """``key, cls, comp, via``: lists of sets that share a leader ``via``, a departure from the centre, and a pair of steps.

    Two sets near the core are connected already. Any other two must share departures, so by the prefix rule one of
    the first ``|diff| - least overlap + 1``. The least overlap follows from the least excess in the other's step;
    steps in which no set departs so often are left out, so that sets far from the centre meet only their like.
    """
    met = departures.where(F.exists("steps", lambda s: s["step"] > 0))
    met = met.join(marks.select(F.col("node").alias("cls"), "comp"), "cls", "left")
    met = met.withColumn("comp", F.coalesce("comp", "cls"))

    def make():
        def work(rows):
            out = {"key": [], "cls": [], "comp": [], "via": []}
            for cls, comp, lead, excess, step, steps, diff in zip(*(rows[c] for c in ENTRY)):
                elements = np.frombuffer(diff, np.uint64)
                place = mixed(np.array([lead], np.int64).view(np.uint64))
                for other in steps:
                    if step or other["step"]:
                        overlap = max(1, -(-(excess + other["least"]) // (2 * rule.per_difference)))
                        if overlap > min(other["most"], len(elements)):
                            continue
                        prefix = elements[: len(elements) - overlap + 1]
                        low, high = sorted((step, other["step"]))
                        out["key"] += signed(mixed(prefix ^ (place + np.uint64(low << 32 | high))))
                        out["cls"] += [cls] * len(prefix)
                        out["comp"] += [comp] * len(prefix)
                        out["via"] += [lead] * len(prefix)
            return out

        return work

    return map_rows(met.select(*ENTRY), make, "key long, cls long, comp long, via long")


def leaders(entries: DataFrame, comp: str, via: str, closed: int = 0) -> DataFrame:
    """``cls, lead, via, open``: the pairs that answer the lists that join two components.

    Lists of up to ``closed`` sets give all their pairs of two components, so these answers end them. The sets of a
    longer list meet its smallest set, and the list stays ``open``. Few lists join components, so they are sent to the
    entries if they are few enough; if not, the entries are shuffled.
    """
    members = entries.select("key", "cls", F.col(comp).alias("comp"), F.col(via).alias("via"))
    lists = members.groupBy("key").agg(F.min("cls").alias("lead"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("sets"))
    wanted = settled(lists.where("low <> high").select("key", "lead", (F.col("sets") > closed).alias("open")), "lists")
    met = members.join(sent_if_few(wanted), "key")
    if closed:
        met = settled(met, "met")
    pairs = met.where("open AND cls <> lead").select("cls", "lead", "via", "open")
    if closed:
        others = met.where("NOT open").select("key", F.col("cls").alias("lead"), F.col("comp").alias("other"))
        short = met.where("NOT open").drop("lead").join(others, "key").where("cls > lead AND comp <> other")
        pairs = pairs.union(short.select("cls", "lead", "via", "open"))
    return pairs.groupBy("cls", "lead").agg(F.min("via").alias("via"), F.max("open").alias("open"))


def closest(met: DataFrame) -> DataFrame:
    """``cls, lead, many``: each set with the leader that it shares most lists with."""
    shares = met.where("cls <> lead").groupBy("cls", "lead").agg(F.count("*").alias("lists"))
    best = shares.groupBy("cls").agg(F.max_by("lead", F.struct("lists", "lead")).alias("lead"))
    return best.withColumn("many", F.lit(False))


def list_members(documents: DataFrame) -> DataFrame:
    """``key, cls, lead``, once each: the lists that different sets meet in, their members, and the smallest of these."""
    entries = documents.select("cls", F.explode("keys").alias("key"))
    lists = entries.groupBy("key").agg(F.min("cls").alias("lead"), F.max("cls").alias("last")).where("lead <> last")
    return entries.join(sent_if_few(settled(lists.select("key", "lead"), "lists")), "key").select("key", "cls", "lead").distinct()


def linked_by(answers: DataFrame) -> DataFrame:
    return answers.where("linked").select(F.col("cls").alias("a"), F.col("lead").alias("b"))


def joined(marks: DataFrame, links: DataFrame) -> DataFrame:
    """``marks`` when ``links`` are added to those that they are of."""
    return components(marks.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(links))


def linked_sets(docs: DataFrame, documents: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame | None:
    """``node, comp`` of all sets that link with another one, None if no lists meet.

    First each set is held against the one leader that it shares most lists with. This links most of what is to be
    linked, and a list whose members are in one component needs no answers. Every other list is answered by its
    leader; sets that this does not settle go into the lists derived from their diffs. Of these, short ones are answered
    whole, and the leaders of long ones come later in the order of names, until no long list joins two components.
    """
    met = settled(list_members(documents), "members")
    if met.isEmpty():
        return None
    names = settled(met.select("cls").distinct(), "names")
    sets, at_sets = settled_in(needed_sets(docs, names, classes, rule), "sets")
    marks = components(settled(linked_by(compared(closest(met), sets, rule)), "links"))
    members = met.select("key", "cls").join(marks.select(F.col("node").alias("cls"), "comp"), "cls", "left")
    pairs = settled(leaders(members.withColumn("comp", F.coalesce("comp", "cls")), "comp", "cls"), "pairs")
    if pairs.isEmpty():
        remove_folder(docs.sparkSession, at_sets)
        return marks
    return joined_lists(pairs, sets, at_sets, marks, rule)


def joined_lists(pairs: DataFrame, sets: DataFrame, at_sets: str, marks: DataFrame, rule: Rule) -> DataFrame:
    """``marks`` when the lists that join components are answered too."""
    spark, closed = sets.sparkSession, CLOSED
    answers, at_answers = settled_in(compared(with_followers(pairs), sets, rule), "answers")
    remove_folder(spark, at_sets)
    # of the tables with differences only the last one is kept; links are two numbers
    while True:
        links = settled(linked_by(answers), "links")
        centre, at_centre = settled_in(centred(answers, rule), "centred")
        remove_folder(spark, at_answers)
        departures, at_departures = settled_in(cores(centre), "departures")
        remove_folder(spark, at_centre)
        near = departures.where("step = 0 AND cls <> core").select(F.col("cls").alias("a"), F.col("core").alias("b"))
        marks = joined(marks, links.union(near))
        pairs = settled(leaders(derived_entries(departures, marks, rule), "comp", "via", closed), "pairs")
        stay_open = pairs.agg(F.max("open")).first()[0]  # null: there are no pairs
        if not stay_open:
            marks = marks if stay_open is None else joined(marks, linked_by(derived(pairs, departures, rule)))
            remove_folder(spark, at_departures)
            return marks
        answers, at_answers = settled_in(derived(pairs, departures, rule), "answers")
        remove_folder(spark, at_departures)
        closed = min(2 * closed, MOST_CLOSED)


def grouped(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (smallest ``doc_id`` reachable by links).

    Equal sets are one class throughout, so copies are never paired. Texts without words, and null texts, have the
    empty set and link with nothing; neither do rows without an id, whose component is null. Rows that repeat an id
    are looked at with all their texts and are told apart by these only. Other columns are not read. An empty table
    gives no rows. Sets and blocks are named by 64-bit hashes.
    """
    documents = settled(document_sets(docs, rule), "document-sets")
    named = documents.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = settled(named.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size")), "classes")
    marks = linked_sets(docs, documents, classes.select("cls", "doc_id"), rule)
    if marks is None:
        groups = classes.withColumnRenamed("doc_id", "component_id")
    else:
        first = marks.join(classes.select(F.col("cls").alias("node"), "doc_id"), "node")
        first = first.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        of_class = marks.join(first, "comp").select(F.col("node").alias("cls"), "component_id")
        groups = classes.join(of_class, "cls", "left").select("cls", "size", F.coalesce("component_id", "doc_id").alias("component_id"))
    named_only = documents.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls"))
    return join_groups(named_only, settled(groups, "groups"), "cls", "size").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for those that ``grouped`` puts behind a smaller id.

    Rows without an id stay; rows that share an id stay or go together.
    """
    behind = grouped(docs, rule)
    stays = behind.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"))
    gone = sent_if_few(settled(stays.where("stays = 0").select(F.col("doc_id").alias("_gone")), "gone"))
    whole = docs.select(F.col("doc_id").cast("long").alias("_gone"), F.struct(*docs.columns).alias("_row"))
    return whole.join(gone, "_gone", "left_anti").select("_row.*")


