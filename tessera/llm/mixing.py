"""Mixing sources to target weights: capped water-filling, seeded repetitions. DataFrame functions only.

Sources are filled by weight like vessels of different width until the mix holds
its share of all words; a source that would pass its greatest number of epochs is
clamped there and what it can't take is shared again among the others by weight,
until none is above. A source's target is then some whole passes over its
documents and a rest. The rest takes documents in the order of a seeded 60-bit
hash of their id; the hash at which a source's words reach its rest is found digit
by digit, from sums per (source, digit), so no document is sorted or moved and a
hot source never meets in one task. The document at that hash is cut.
"""

from __future__ import annotations

from decimal import Decimal
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import row_positions
from .common import written

WEIGHTS = (5, 2, 1)     # of the first, second and third source by name, and so on in turn
SHARE_PERCENT = 150     # words of the mix, in percent of all words
EPOCHS = 2              # no source, and no document, is taken more often
KEY_BITS, DIGIT_BITS = 60, 12

_SPACE = r"\x20\x09-\x0D"
_SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts as empty. One character per word is held at most."""
    started = F.ltrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.length(F.regexp_replace(started, f"[^{_SPACE}]++[{_SPACE}]*+", "x")).cast("long")


def sample_key(doc_id: Column, seed: str) -> Column:
    """A document's place in its source's order: the first 60 bits of the MD5 of seed and id; 0 without an id."""
    name = F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))
    return F.coalesce(F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long"), F.lit(0).cast("long"))


def _exact(value) -> Column:
    return F.lit(Decimal(value)).cast("decimal(38,0)")


def _level(sources: DataFrame, share_percent: int, epochs: int) -> tuple[int, int] | None:
    """Words per unit of weight that fill the mix, as a fraction; None where every source is taken whole.

    ``sources`` has ``weight`` and ``size``. A round clamps every source that the
    level of the round before fills over its cap and shares the excess out among
    the rest by weight. Levels only rise, so a clamped source stays clamped and
    the level alone is kept between rounds; each round is one aggregate over one
    row per source.
    """
    size, weight = F.col("size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    level = None
    while True:
        over = F.lit(False) if level is None else size * _exact(epochs * level[1]) < weight * _exact(level[0])
        row = sources.agg(
            F.sum(size).alias("all"), F.sum(F.when(over, size)).alias("clamped"),
            F.sum(F.when(~over, weight)).alias("weight")).first()
        if not row["weight"]:
            return None
        num = share_percent * int(row["all"] or 0) - 100 * epochs * int(row["clamped"] or 0)
        den = 100 * int(row["weight"])
        common = gcd(num, den) or 1
        now = (num // common, den // common)
        if now == level:
            return level
        level = now


def _targets(sources: DataFrame, share_percent: int, epochs: int) -> DataFrame:
    """``sources`` with ``target`` (double), ``whole`` (passes over the source) and ``rest`` (words beyond them)."""
    size, weight = F.col("size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    level = _level(sources, share_percent, epochs)
    cap = F.col("size") * F.lit(epochs)
    if level is None:
        target, words = cap.cast("double"), cap
    else:
        filled = weight * _exact(level[0])
        over = size * _exact(epochs * level[1]) < filled
        target = F.when(over, cap.cast("double")).otherwise(filled.cast("double") / F.lit(float(level[1])))
        words = F.when(over, cap).otherwise(F.floor(filled / _exact(level[1])).cast("long"))
    out = sources.withColumns({"target": target, "words": words})
    whole = F.coalesce(F.expr("words div nullif(size, 0)"), F.lit(0).cast("long"))
    return out.withColumn("whole", whole).withColumn("rest", F.col("words") - F.col("whole") * F.col("size")).drop("words")


def _same_source(left: DataFrame, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["source"])


def _cuts(narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """Where each source's rest ends: ``source``, ``cut_key``, ``cut_rest`` (words to take at that key), ``cut_words``.

    One digit of the key a round, ``KEY_BITS / DIGIT_BITS`` rounds at every size.
    A source has 4,096 sums a round at most. A source without a rest has no row.
    """
    cuts = sources.where("rest > 0").select("source", F.lit(0).cast("long").alias("cut_key"),
                                            F.col("rest").alias("cut_rest"))
    so_far = Window.partitionBy("source").orderBy("digit")
    for low in range(KEY_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        here = F.shiftright(narrow["key"], low + DIGIT_BITS) == cuts["cut_key"]
        sums = (narrow.join(cuts, _same_source(narrow, cuts) & here)
                .select(narrow["source"], "cut_key", "cut_rest", F.shiftright("key", low).alias("digit"), "size")
                .groupBy("source", "cut_rest", "digit").agg(F.sum("size").alias("cut_words")))
        reached = sums.withColumn("upto", F.sum("cut_words").over(so_far))
        before = F.col("upto") - F.col("cut_words")
        cuts = written(reached.where((F.col("upto") >= F.col("cut_rest")) & (before < F.col("cut_rest")))
                       .select("source", F.col("digit").alias("cut_key"), (F.col("cut_rest") - before).alias("cut_rest"),
                               "cut_words"), "cuts")
        if low:
            cuts = cuts.drop("cut_words")
    return cuts


def _narrow(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"), sample_key(F.col("doc_id"), seed).alias("key"))


def mixing_plan(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
                epochs: int = EPOCHS) -> DataFrame:
    """One row per source of ``narrow`` (doc_id, source, size, key): source, weight, size, target, whole and the cut."""
    sizes = written(narrow.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    ranked = row_positions(sizes, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = written(ranked.select("source", "size", weight.cast("long").alias("weight")), "weights")
    sources = written(_targets(sources, share_percent, epochs), "targets")
    cuts = _cuts(narrow, sources)
    return written(sources.join(cuts, _same_source(sources, cuts), "left").drop(cuts["source"]), "mix-plan")


def _taken(size: Column, key: Column, plan: DataFrame) -> Column:
    """Words taken of a document: whole passes, and the rest's share."""
    share = F.floor(plan["cut_rest"].cast("decimal(19,0)") * size.cast("decimal(19,0)")
                    / F.nullif(plan["cut_words"], F.lit(0)).cast("decimal(19,0)")).cast("long")
    rest = F.when(key < plan["cut_key"], size).when(key == plan["cut_key"], share).otherwise(F.lit(0))
    return plan["whole"] * size + rest


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
            epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """What the mix takes of each row of ``docs``.

    Returns ``doc_id``, ``size`` (words), ``source_size``, ``target`` (of its
    source) and ``taken`` (words, repeats counted). Sources are weighted in the
    order of their names by code point, null last. A source's taken words are its
    target rounded down, less one word per row at most where rows share the key of
    the cut: those (repeated ids, rows without id) are cut alike, in proportion.

    A null or empty text has no words and is taken with none. Null is a source
    of its own. Repeated rows count each and get the same result. Other columns
    are not read. An empty table gives an empty result; a table without words has
    targets of 0. Where the share can't be reached within ``epochs``, every source
    is taken ``epochs`` times.
    """
    narrow = written(_narrow(docs, seed), "mix-sizes")
    plan = mixing_plan(narrow, weights, share_percent, epochs)
    return (narrow.join(plan, _same_source(narrow, plan))
            .select("doc_id", narrow["size"], plan["size"].alias("source_size"), "target",
                    _taken(narrow["size"], narrow["key"], plan).alias("taken")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
          epochs: int = EPOCHS, seed: str = "mix", copy: str = "mix_copy") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, repeated as :func:`mixture` says, with ``copy`` from 1.

    A cut copy's text is its first words, joined by single spaces. Rows of which
    nothing is taken, such as empty texts, don't appear. ``copy`` must not be a
    column of ``docs``.
    """
    if copy in docs.columns:
        raise ValueError(f"docs has a column {copy}")
    plan = mixing_plan(written(_narrow(docs, seed), "mix-sizes"), weights, share_percent, epochs)
    size, key = word_count(docs["text"]), sample_key(docs["doc_id"], seed)
    same = docs["source"].cast("string").eqNullSafe(plan["source"])
    rows = docs.join(plan, same).select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), size.alias("size"),
                                        _taken(size, key, plan).alias("taken"))
    rows = rows.where("taken > 0").withColumn("copy", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    first = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"[^{_SPACE}]+"), F.lit(0)), F.lit(1),
                                 left.cast("int")), " ")
    text = F.when(left < F.col("size"), first).otherwise(F.col("row.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
                       F.col("copy").alias(copy))
