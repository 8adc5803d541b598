"""Spelling variants by PartEnum signatures: words within one edit, found by exact equi-joins over letter multisets.

Words are runs of letters of the texts with at least ``letters`` code points and ``least`` occurrences. A word is read as the
vector of its letter multiset: one replaced letter changes two of its components, an inserted or deleted one changes one. The
letters are dealt to ``parts`` parts of the vector, so a replacement leaves all but two parts alone and an insertion all but one:

- words of equal length sign every choice of all parts but two,
- words whose lengths differ by one sign every choice of all parts but one, under the shorter length.

Words within the distance agree in a signature, always. A multiset forgets the order, so a signature is posted twice: with the
word's first half (of the shorter length) and with its last, one of which an edit leaves alone. That keeps the groups of a
signature small, also for anagrams. The equi-join evaluates the edit distance inside, so only near pairs leave it.

A word's form is its near word of most occurrences (ties: least in code-point order) if it has ``times`` those of the word.
Forms have more occurrences than their words, so they make no circles; roots follow by pointer jumping.

``letters_of_run`` may change a run before it is counted. Null and empty texts have no words; texts of any length are read whole,
and a run may be as long as the text. Repeated rows count again; null ids are written as empty text. An empty table gives an empty
result. Only doc_id and text are read, so further columns don't matter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

#: The letters of a run, and letters by falling frequency in European prose, those not named follow by code point.
RUN = "[A-Za-z\\u00C0-\\u00FF]"
FREQUENT = "esaintrlodumcpghvbfqyjzxkw"


def alphabet() -> str:
    return FREQUENT + "".join(map(chr, range(0xC0, 0x100)))


def misspelt(run: Column, doc_id: Column, one_in: int = 199) -> Column:
    """``run``, without one of its code points where ``one_in`` divides the checksum of ``<doc_id>:<run>``."""
    mark = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
    at = (mark % F.char_length(run)).cast("int")
    return F.when(mark % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def words(docs: DataFrame, letters: int, least: int, one_in: int | None) -> DataFrame:
    """(word, n)"""
    runs = docs.select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({RUN}{{{letters},}})"), 1)).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("id", lowered.alias("run"))
    runs = runs.select((misspelt(F.col("run"), F.col("id"), one_in) if one_in else F.col("run")).alias("word")).filter(F.char_length("word") >= letters)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def signatures(known: DataFrame, parts: int) -> DataFrame:
    """(role, sig, word, n): role 0 for words of equal length, 1 and 2 for the shorter and the longer of two lengths."""
    size = F.char_length("word")
    spread = known.select("word", "n", size.alias("size"), F.array_join(F.array_sort(F.split("word", "")), "").alias("bag"))
    own = ["".join(alphabet()[p::parts]) for p in range(parts)]

    def keys(role: int, left_out: int, shorter: Column) -> list[Column]:
        half = F.floor(shorter / 2).cast("int")
        ends = F.substring("word", F.lit(1), half), F.substring("word", F.col("size") - (shorter - half) + 1, shorter - half)
        bags = [(k, F.translate("bag", "".join(own[p] for p in out), "")) for k, out in enumerate(combinations(range(parts), left_out))]
        return [F.struct(F.lit(role).alias("role"), F.xxhash64(F.lit(2 * k + side), shorter, bag, end).alias("sig")) for k, bag in bags for side, end in enumerate(ends)]

    every = keys(0, 2, F.col("size")) + keys(1, 1, F.col("size")) + keys(2, 1, F.col("size") - 1)
    return spread.select("word", "n", F.explode(F.array(*every)).alias("s")).select("s.role", "s.sig", "word", "n")


def near_pairs(known: DataFrame, parts: int = 5) -> DataFrame:
    """(word, near, n): each word with each word one edit away and its count, in both directions."""
    posted = stored(signatures(known, parts))
    left = posted.filter("role < 2").select("role", "sig", "word", "n")
    right = posted.filter("role <> 1").select((F.col("role") > 0).cast("int").alias("role_r"), F.col("sig").alias("sig_r"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    ordered = (F.col("role") == 1) | (F.col("word") < F.col("near"))
    one_edit = F.levenshtein("word", "near", 1) == 1
    met = left.hint("shuffle_merge").join(right, (F.col("role") == F.col("role_r")) & (F.col("sig") == F.col("sig_r")) & ordered & one_edit)
    met = stored(met.select("word", "near", "n", "near_n").distinct())
    return met.select("word", "near", F.col("near_n").alias("n")).union(met.select("near", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        new = stored(now.join(ahead, now.root == ahead["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, letters: int = 6, least: int = 5, times: int = 5, one_in: int | None = 199, parts: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``docs`` (doc_id, text)."""
    known = stored(words(docs, letters, least, one_in))
    best = near_pairs(known, parts).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("neg"), "near")).alias("best"))
    out = known.join(best, "word", "left")
    takes = -F.col("best.neg") >= times * F.col("n")
    out = stored(out.select("word", F.when(takes, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("best.neg")).alias("form_n")))
    return out.join(roots(out.filter(F.col("form").isNotNull())), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
