"""Spelling variants: words one edit apart, found through an index of variable-length grams.

* The gram dictionary holds every gram of ``SHORT`` code points of the words, and of each gram that occurs more than
  ``frequent`` times also its extensions, up to ``LONG`` code points. It is bounded by the alphabet.
* A word is decomposed from left to right into the longest dictionary gram at each place, without those that
  another one covers.
* Affected-gram bounds, by word and gram: an edit after the gram leaves it alone if it lies behind its end (one place
  further if the dictionary could extend the gram), an edit before it does if what lies between can't be the inner
  part of a longer gram. So every edit leaves alone the grams of the left up to one bound or those of the right from
  another on. The lists of a side's grams are merged by keying on them together, which is the word's beginning (or
  end) at a gram's edge. A word looks into one merged list for each side, the pair of least length that leaves no
  edit uncovered.
* Words whose shortest pair is longer than ``longest`` (or that have no pair: short ones) are looked up exactly
  by what is left without one of their code points, so no list is ever large and no partner is dropped.
* Candidates are verified by edit distance.

Roots come from pointer doubling over the forms; a form has at least twice its word's occurrences, so there are no cycles.

Defined results: null and empty texts hold no words, a null id counts as empty in the damage's key; repeated rows
count each; ties go to the smallest word by code points; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
SHORT, LONG = 2, 3
FREQUENT, LONGEST = 50, 512
DAMAGED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3


def word_runs(documents: DataFrame) -> DataFrame:
    """doc_id (as text), run: every run of letters with A-Z in lower case."""
    found = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    run = F.col("run")
    return found.withColumn("run", F.when(F.lower(run) == run, run).otherwise(F.translate(run, UPPER, LOWER)))


def misspelt(runs: DataFrame) -> DataFrame:
    """word: of every ``DAMAGED``-th run, by crc32 of id and run, one code point is gone."""
    h, run = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")), F.col("run")
    at = (F.col("h") % F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return runs.withColumn("h", h).select(F.when(F.col("h") % DAMAGED == 0, less).otherwise(run).alias("word"))


def vocabulary(words: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words of so many code points and occurrences."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT) -> list[str]:
    """The grams that words are decomposed into; at most as many as the alphabet has strings of ``LONG`` code points."""
    size = F.length("word")

    def grams(q: int) -> Column:
        return F.when(size >= q, F.transform(F.sequence(F.lit(1), size - q + 1), lambda p: F.substring("word", p, F.lit(q)))).otherwise(F.array().cast("array<string>"))

    counts = words.select(F.explode(F.concat(*map(grams, range(SHORT, LONG + 1)))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    n = dict(map(tuple, counts.collect()))
    out = {g for g in n if len(g) == SHORT}
    level = out
    for q in range(SHORT + 1, LONG + 1):
        level = {g for g in n if len(g) == q and g[:-1] in level and n[g[:-1]] > frequent}
        out |= level
    return sorted(out)


class Grams:
    """A prefix-closed dictionary with what decomposition and bounds need of it."""

    def __init__(self, grams: list[str]):
        self.all = set(grams)
        self.longest = max(map(len, grams), default=0)
        self.extended = {g[:-1] for g in grams if len(g) > SHORT}
        self.inner = {g[i:] for g in grams for i in range(1, len(g))}

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """(start, last place) of the word's grams."""
        out, far = [], -1
        for p in range(len(word) - SHORT + 1):
            e = p + SHORT
            while e < len(word) and e - p < self.longest and word[p : e + 1] in self.all:
                e += 1
            if e - 1 > far:
                far = e - 1
                out.append((p, far))
        return out

    def lists(self, word: str) -> Iterator[tuple[str, int]]:
        """(merged list, bound). ``L`` + beginning: edits whose untouched left part has at least ``bound`` code
        points leave these grams alone. ``R`` + end: edits whose untouched right part starts at ``bound`` at the latest do."""
        for p, e in self.decompose(word):
            yield "L" + word[: e + 1], e + 1 + (word[p : e + 1] in self.extended)
            b = p
            while b >= 0 and word[b : e + 1] in self.inner:
                b -= 1
            yield "R" + word[p:], b


def index(words: DataFrame, grams: list[str]) -> DataFrame:
    """word, n, list, bound: one row for each merged list that a word stands in."""
    shared = words.sparkSession.sparkContext.broadcast(grams)  # bounded by the alphabet
    made: list[Grams] = []

    def each(batches):
        g = made[0] if made else Grams(shared.value)
        made[:] = [g]
        for b in batches:
            for part in (b.slice(k, 2_000) for k in range(0, b.num_rows, 2_000)):
                w, n, k, at = [], [], [], []
                for word, count in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for name, bound in g.lists(word):
                        w.append(word), n.append(count), k.append(name), at.append(bound)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.string()), pa.array(at, pa.int32())], ["word", "n", "list", "bound"])

    return words.select("word", "n").mapInArrow(each, "word string, n long, list string, bound int")


def probes(indexed: DataFrame, longest: int = LONGEST) -> DataFrame:
    """word, left, right: the pair of lists of least length that covers every edit, if it is no longer than ``longest``.

    Left list and right list cover together what either does: the untouched left part is that long, or the
    untouched right part starts before. They leave nothing out when the left bound does not exceed the right one.
    """
    size = indexed.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") <= longest)
    known = indexed.join(size, "list").select("word", F.struct("size", "bound", "list").alias("x"), F.col("list").startswith("L").alias("is_left"))
    sides = known.groupBy("word").agg(F.sort_array(F.collect_list(F.when(F.col("is_left"), F.col("x")))).alias("ls"), F.sort_array(F.collect_list(F.when(~F.col("is_left"), F.col("x")))).alias("rs"))  # a word's own lists
    pairs = F.flatten(F.transform("ls", lambda a: F.transform(F.filter("rs", lambda b: b["bound"] >= a["bound"]), lambda b: F.struct((a["size"] + b["size"]).alias("size"), a["list"].alias("left"), b["list"].alias("right")))))
    return sides.select("word", F.array_min(pairs).alias("best")).where(F.col("best.size") <= longest).select("word", "best.left", "best.right")


def _near(pairs: DataFrame) -> DataFrame:
    """word, other, n_other of candidates that are one edit apart."""
    close = (F.abs(F.length("word") - F.length("other")) <= 1) & (F.col("word") != F.col("other"))
    return pairs.where(close).where(F.levenshtein("word", "other", 1) == 1).select("word", "other", "n_other")


def near_by_lists(chosen: DataFrame, indexed: DataFrame) -> DataFrame:
    """Partners from the two merged lists of each word."""
    asks = chosen.select("word", F.explode(F.array("left", "right")).alias("list"))
    held = indexed.select(F.col("word").alias("other"), F.col("n").alias("n_other"), "list")
    return _near(asks.join(held, "list"))


def _without_one(word: Column) -> Column:
    """(key, place) of the word itself (place -1) and of what is left without the code point at each place."""
    cut = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.struct(F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word))).alias("key"), i.alias("place")))
    return F.concat(F.array(F.struct(word.alias("key"), F.lit(-1).alias("place"))), cut)


def near_by_deletion(rest: DataFrame, words: DataFrame) -> DataFrame:
    """Partners of words without a pair of short lists: both without the same place, or one without any of its places."""
    asks = rest.select("word", F.explode(_without_one(F.col("word"))).alias("a")).select("word", "a.key", F.col("a.place").alias("asked"))
    held = words.select(F.col("word").alias("other"), F.col("n").alias("n_other"), F.explode(_without_one(F.col("word"))).alias("b")).select("other", "n_other", "b.key", F.col("b.place").alias("place"))
    fits = ((F.col("asked") == F.col("place")) & (F.col("asked") >= 0)) | ((F.col("asked") == -1) != (F.col("place") == -1))
    return _near(asks.join(held, "key").where(fits))


def forms(words: DataFrame, near: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest n, where it has at least twice the word's."""
    best = near.distinct().groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("minus"), F.col("other"))).alias("x"))
    out = words.join(best, "word", "left")
    fits = -F.col("x.minus") >= 2 * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("x.other")).alias("form"), F.when(fits, -F.col("x.minus")).alias("form_n"))


def roots(found: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of every word that has a form: each round doubles how far a word looks."""
    links = scratch.put(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = scratch.put(links.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "links")
        moved = not further.where("moved").isEmpty()
        scratch.drop(links)
        links = further.drop("moved")
        links._scratch_path = further._scratch_path
        if not moved:
            return links


def variants(words: DataFrame, frequent: int = FREQUENT, longest: int = LONGEST) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    scratch = Scratch(words.sparkSession)
    words = scratch.put(words, "words")
    indexed = scratch.put(index(words, gram_dictionary(words, frequent)), "index")
    chosen = scratch.put(probes(indexed, longest), "probes")
    rest = words.join(chosen, "word", "left_anti")
    near = near_by_lists(chosen, indexed).union(near_by_deletion(rest, words))
    found = scratch.put(forms(words, near), "forms")
    scratch.drop(indexed, chosen)
    out = found.join(roots(found, scratch), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """The variants among the misspelt words of documents."""
    return variants(vocabulary(misspelt(word_runs(documents))))
