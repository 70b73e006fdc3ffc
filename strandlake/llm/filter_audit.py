"""Filter interaction audit: what each of five filters removes, in every order of applying them.

Method: a relational word pipeline. Words are exploded and aggregated by (document, word),
then by document, for totals and distinct words; the flags that need no words come from a scan of
their own and are outer-joined. Each document ends as a mask of five bits, bit k set where filter k
fails it. By part and label, 32 conditional counts, one a mask, hold all that the 120 orders need: the
document is removed by the first filter of an order whose bit is set.

The words are not shuffled: documents are dealt once, by identifier and hash of the text, and both aggregations
and the outer join keep that partitioning. Copies are compared by 128-bit hashes of texts; a group of copies is one
row a (part, label) after the map side, however large.

Defined cases: null text is empty; null part is the empty string. Rows of one identifier are
documents of their own: the smallest identifier of a text passes the filter for copies in all its rows. Rows
without identifier come after all others: they are copies of any row with identifier that has their
text, and of none without. A null or repeated label counts as 1 if any of its rows says 1. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters by bit: few words, few distinct words, many capitals, signs, copies.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 3
SIGNS = r"[#$%&*|]"
_SPACES = r"[\x20\x09-\x0D]+"
#: What stands for a document: identifier (or hash of the text), whether it has none, hash of the text, part.
KEY = ["id", "no_id", "h1", "h2", "part"]
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame, text: str, doc_id: str, part: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h1 = F.xxhash64(body)
    own = F.col(f"`{doc_id}`").cast("long")
    return docs.select(F.coalesce(own, h1).alias("id"), own.isNull().alias("no_id"), h1.alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("text"))


def word_totals(keyed: DataFrame) -> DataFrame:
    """id, h2, words and distinct_words of each text under an identifier, in all its rows alike."""
    # Between two spaces more every text splits into two empty strings and its words, so that they count its rows.
    padded = F.concat(F.lit(" "), "text", F.lit(" "))
    words = keyed.select("id", "h2", padded.alias("text")).repartition("id", "h2").select("id", "h2", F.explode(F.split("text", _SPACES)).alias("word"))
    counts = words.groupBy("id", "h2", "word").agg(F.count(F.lit(1)).alias("n"))
    is_word = F.col("word") != ""
    rows = F.sum(F.when(~is_word, F.col("n"))) / 2
    return counts.groupBy("id", "h2").agg((F.sum(F.when(is_word, F.col("n")).otherwise(0)) / rows).cast("long").alias("words"), F.count(F.when(is_word, 1)).alias("distinct_words"))


def text_flags(keyed: DataFrame) -> DataFrame:
    """KEY, copies (rows of the key), capitals and signs as flags."""
    capitals = 100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_CAPITALS_PERCENT * F.length("text")
    flags = keyed.select(*KEY, capitals.alias("capitals"), F.col("text").rlike(SIGNS).alias("signs"))
    return flags.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.max("capitals").alias("capitals"), F.max("signs").alias("signs"))


def masks(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """Counts n of documents by part, good, toxic (labels) and mask."""
    keyed = _keyed(docs, text, doc_id, part)
    both = word_totals(keyed).join(text_flags(keyed), ["id", "h2"], "full_outer")
    words = F.col("words")
    fails = [words < MIN_WORDS, 100 * F.col("distinct_words") < MIN_DISTINCT_PERCENT * words, F.col("capitals"), F.col("signs")]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    marked = marked.withColumn("no_id", F.lit(False))
    flagged = both.select(*KEY, "copies", mask.alias("mask")).join(marked, ["id", "no_id"], "left").fillna(False, ["good", "toxic"])
    who = F.when(~F.col("no_id"), F.col("id"))
    rank = F.coalesce(who, F.lit(_LAST))
    groups = flagged.groupBy("h1", "h2", "part", "good", "toxic", "mask").agg(F.sum("copies").alias("n"), F.min(rank).alias("first"), F.min_by("copies", rank).alias("n_first"))
    passes = F.when(F.col("first") == F.min("first").over(Window.partitionBy("h1", "h2")), F.col("n_first")).otherwise(0)
    split = groups.withColumn("passes", passes)
    sides = F.array(F.struct("mask", F.col("passes").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))
    return split.select("part", "good", "toxic", F.inline(sides)).where("n > 0")


def _any(mask: Column, bits: Column) -> Column:
    return mask.bitwiseAND(bits) != 0


def interactions(counted: DataFrame) -> DataFrame:
    """The report over all orders of FILTERS, from counts by part, good, toxic and mask."""
    wide = counted.groupBy("part", "good", "toxic").agg(*[F.sum(F.when(F.col("mask") == m, F.col("n")).otherwise(0)).alias(f"m{m}") for m in range(32)])
    long = wide.select("part", "good", "toxic", F.inline(F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(120 // max(1, m.bit_count())).cast("long").alias("share"), F.col(f"m{m}").alias("n")) for m in range(32)])))
    orders = F.lit(" ".join("".join(x) for x in permutations(FILTERS)))
    place = {k: F.instr(F.col("filter_order"), x) for k, x in enumerate(FILTERS)}
    bits = lambda holds: sum((F.when(holds(place[k]), 1 << k).otherwise(0) for k in place), F.lit(0))
    # 600 rows a mask, part and label: bounded by the number of parts, not of documents.
    spread = long.groupBy("part", "mask", "share").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    spread = spread.select("*", F.explode(F.split(orders, " ")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    spread = spread.withColumns({"own": bits(lambda at: at == F.col("step")), "before": bits(lambda at: at < F.col("step"))})
    mask, own, before = F.col("mask"), F.col("own"), F.col("before")
    fails, gone = _any(mask, own), _any(mask, before)

    def total(of: str | Column, when: Column) -> Column:
        return F.sum(F.when(when, F.col(of) if isinstance(of, str) else of).otherwise(0)).cast("long")

    return spread.groupBy("part", "filter_order", "step").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", mask == own).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
        total(F.col("n") * F.col("share"), fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """One row per part, order and step."""
    return interactions(masks(docs, labels, text, doc_id, part))
