"""Similar names inside a block, found by shared rare grams instead of pairing the block."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from catloom.functions.values import bind
from catloom.runtime import cut_lineage


@F.pandas_udf(T.IntegerType())
def _common_subsequence(left: pd.Series, right: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, one bit-parallel step per character."""

    def lcs(a: str, b: str) -> int:
        masks: dict[str, int] = {}
        for i, ch in enumerate(a):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for ch in b:
            hit = row & masks.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(a) - row.bit_count()

    return pd.Series([lcs(a, b) for a, b in zip(left, right)], dtype="int32")


# Declared non-deterministic so that no filter on the result makes Spark compute it twice.
common_subsequence = _common_subsequence.asNondeterministic()


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100: twice the common subsequence over both lengths, rounded half to even."""
    return F.bround(F.lit(200.0) * common_subsequence(a, b) / (F.length(a) + F.length(b)), 0).cast("int")


def letter_signature(c: Column) -> Column:
    """64-bit set of the (letter, n-th occurrence) pairs of a text.

    A letter occurrence missing on the other side costs one edit, so the number of bits set here and
    not there is a lower bound of the edits (colliding bits can only lower it further).
    """

    def fold(letters: Column) -> Column:
        marks = F.transform(letters, lambda x, i: F.pmod(F.xxhash64(x, i - F.array_position(letters, x)), F.lit(64)))
        bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), m.cast("int"))
        return F.aggregate(marks, F.lit(0).cast("long"), lambda acc, m: acc.bitwiseOR(bit(m)))

    return bind(F.array_sort(F.split(c, "")), fold)


MATCHES = 5  # common grams asked of a pair, as far as its lengths promise as many


def gram_size(share: float) -> int:
    """The longest grams of which ``share`` edits per character still leave a third of a text's own."""
    return max([q for q in range(1, 6) if (2 * q - 1) * share <= 0.65], default=1)


def edit_share(lo: int) -> float:
    """Insertions and deletions per character of both texts up to which a ratio rounds to ``lo``."""
    return (201 - 2 * lo) / 200


def _edits(total: Column, lo: int) -> Column:
    """Insertions and deletions allowed between texts of ``total`` characters, in whole numbers."""
    return F.call_function("div", total * (201 - 2 * lo), F.lit(200)).cast("int")


def rare_grams(texts: DataFrame, lo: int) -> DataFrame:
    """The grams under which each text is filed: (_key, _id, _len, _sig, _pos, _single), rarest of its block first.

    Grams of a text with q - 1 marks at both ends are numbered by occurrence, so they form a set of length + q - 1. A text
    that d edits separate from another loses at most q per deletion and q - 1 per insertion, over all lengths the
    other may have at most ``lost``; so two such texts share MATCHES of their first ``lost`` + MATCHES in any common order.
    """
    share = edit_share(lo)
    q = gram_size(share)
    marked = F.concat(F.lit("\u0002" * (q - 1)), F.col("_text"), F.lit("\u0003" * (q - 1)))
    places = F.sequence(F.lit(1), F.col("_len") + (q - 1))
    grams = bind(marked, lambda t: F.transform(places, lambda i: F.struct(F.substr(t, i, F.lit(q)).alias("g"), i.alias("i"))))

    def numbered(ordered: Column) -> Column:
        return bind(F.transform(ordered, lambda x: x["g"]), lambda only: F.transform(ordered, lambda x, i: F.struct(
            x["g"].alias("g"), x["i"].alias("i"), (i + 1 - F.array_position(only, x["g"])).alias("n"))))

    rows = texts.withColumn("_g", F.explode(bind(F.array_sort(grams), numbered)))
    last = F.max(F.col("_g.n")).over(Window.partitionBy("_id", "_g.g"))
    rows = rows.select("_id", "_len", "_sig", F.xxhash64("_block", "_g.g", "_g.n").alias("_key"), F.col("_g.i").alias("_pos"), (last == 0).alias("_single"))
    often = rows.groupBy("_key").agg(F.count("*").alias("_often"))
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("_often", "_key"))
    # As the shorter text it loses most beside one of its own length, as the longer one beside the shortest or the longest partner.
    size, spread = F.col("_len"), 2 * share / (1 + share)
    lost = F.floor(size * max((2 * q - 1) * share, ((2 * q - 1) * share * (2 - spread) + spread) / 2) + 1e-6)
    ranked = rows.join(often.hint("merge"), "_key").withColumn("_rank", rank)
    return ranked.where(F.col("_rank") <= lost + MATCHES).drop("_often", "_rank")


def candidate_pairs(filed: DataFrame, lo: int) -> DataFrame:
    """Pairs (_ia, _ib) of filed texts that no bound tells apart: lengths, places, letters, number of common grams."""
    q = gram_size(edit_share(lo))
    x = filed.select(*[F.col(c).alias(c + "x") for c in filed.columns])
    y = filed.select(*[F.col(c).alias(c + "y") for c in filed.columns])
    gap, total = F.col("_leny") - F.col("_lenx"), F.col("_lenx") + F.col("_leny")
    edits = _edits(total, lo)
    only = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    shift = F.col("_posy") - F.col("_posx")
    # The one text's characters move right by its insertions and left by its deletions.
    near = (shift * 2 <= edits + gap) & (shift * 2 >= gap - edits)
    # Both sides grow with the data, so the join is a sort-merge join, which AQE splits at hot grams.
    met = x.join(y.hint("merge"), F.col("_keyx") == F.col("_keyy")).where(
        (F.col("_idx") < F.col("_idy")) & (F.abs(gap) <= edits) & (near | ~(F.col("_singlex") & F.col("_singley")))
        & (only("_sigx", "_sigy") + only("_sigy", "_sigx") <= edits))
    shorter = F.least("_lenx", "_leny")
    parity = edits - F.pmod(edits - F.abs(gap), F.lit(2))
    kept = shorter + (q - 1) - F.call_function("div", (2 * q - 1) * parity - F.abs(gap), F.lit(2))
    met = met.select(F.col("_idx").alias("_ia"), F.col("_idy").alias("_ib"), F.least(F.lit(MATCHES), F.greatest(F.lit(1), kept)).cast("int").alias("_asked"))
    return met.groupBy("_ia", "_ib", "_asked").agg(F.count("*").alias("_met")).where("_met >= _asked").select("_ia", "_ib")


def fuzzy_pairs(df: DataFrame, block: str, text: str, key: str, lo: int = 80) -> DataFrame:
    """Pairs of distinct texts in a block with a ratio of at least ``lo``: (block, id_a, id_b, text_a, text_b, ratio).

    Exact copies are folded first, each text standing for its smallest key; ``id_a < id_b``.

    The ratio reaches ``lo`` only if insertions and deletions stay below a share of both lengths. Such texts have most of their
    grams in common, so it is enough to file each under its rarest few (:func:`rare_grams`): pairs that share fewer than
    the promised number are never similar, and nothing else is lost. Only ids, lengths, places and letter sets
    are joined; texts are attached to distinct candidates, screened with the built-in edit distance, and only
    survivors reach Python. Null and empty texts take no part.
    """
    texts = df.groupBy(block, text).agg(F.min(key).alias("_id")).where(F.length(text) > 0)
    texts = texts.select(F.col(block).alias("_block"), F.col(text).alias("_text"), "_id", F.length(text).alias("_len"), letter_signature(F.col(text)).alias("_sig"))
    # The grams outweigh the texts many times over, so the texts are spread before they are cut up.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = cut_lineage(texts.repartition(tasks, "_id"))
    pairs = candidate_pairs(cut_lineage(rare_grams(texts, lo)), lo)
    a = texts.select("_block", F.col("_id").alias("_ia"), F.col("_text").alias("_a"))
    b = texts.select(F.col("_id").alias("_ib"), F.col("_text").alias("_b"))
    near = pairs.join(a, "_ia").join(b, "_ib").where(F.levenshtein("_a", "_b") <= _edits(F.length("_a") + F.length("_b"), lo))
    scored = near.repartition(tasks, "_ia", "_ib").withColumn("ratio", indel_ratio(F.col("_a"), F.col("_b"))).where(F.col("ratio") >= lo)
    return scored.select(F.col("_block").alias(block), F.col("_ia").alias("id_a"), F.col("_ib").alias("id_b"),
                         F.col("_a").alias("text_a"), F.col("_b").alias("text_b"), "ratio")
