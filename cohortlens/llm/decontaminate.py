"""Benchmark decontamination by template canonicalisation, on DataFrame functions alone.

Texts become templates: numbers, names (capitalised words, wherever they stand)
and units after a number are replaced by typed placeholders, other words are
lower-cased.  The lower-cased words themselves are compared too, so that a copy
in other case is found.  The five-word windows of documents are hash-joined with those of
the benchmark items.  A document contains an item if windows near one diagonal
(document place minus item place) cover ``THRESHOLD`` or more of the item's and
if the slots are consistent: the same item value must stand for the same
document value, as in a question whose numbers and names were changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.scratch import stored

#: Words of a window, least share of an item's windows, least share of consistent slots, plain words a window needs.
WINDOW, THRESHOLD, CONSISTENCY, PLAIN = 5, 0.8, 0.8, 2
#: Rows broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Units that count as such after a number.
UNITS = (
    "mm cm m km in ft yd mi miles mile meters metres meter metre inches inch feet foot yards mg g kg lb lbs oz grams gram kilograms pounds "
    "ml l liters litres liter litre s sec seconds second min minutes minute h hr hours hour days day weeks week months month years year "
    "usd eur dollars dollar euros euro cents cent percent kmh mph"
).split()
_NAME, _POINT, _NUM, _UNIT = "\u0001", "\u0002", "\u0003", "\u0004"
_EDGE = " \t\n\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NOT_WORD = r"[\s\p{Punct}]+"


def _marked(text: Column) -> Column:
    """``text`` with names marked and each number one token of its own."""
    named = F.regexp_replace(text, r"(?<![\p{L}\p{N}])\p{Lu}", f"{_NAME}$0")
    one = F.regexp_replace(F.regexp_replace(named, r"(?<=\d)[.,:/](?=\d)", _POINT), r"(?<=\d)(?=\p{L})|(?<=\p{L})(?=\d)", " ")
    return F.btrim(F.when(named.rlike("[0-9]"), one).otherwise(named), F.lit(_EDGE))


def _template(marked: Column) -> Column:
    """Template tokens, place by place those of the marked text."""
    plain = F.lower(F.regexp_replace(marked, rf"{_NAME}[^\s\p{{Punct}}]+", _NAME))
    numbers = F.regexp_replace(plain, rf"(?<![\p{{L}}{_NAME}])\d[\d{_POINT}]*", _NUM)
    units = F.regexp_replace(numbers, rf"{_NUM}([\s\p{{Punct}}]+)(?:{'|'.join(UNITS)})(?=[\s\p{{Punct}}]|$)", f"{_NUM}$1{_UNIT}")
    return F.split(F.when(plain.rlike("[0-9]"), units).otherwise(plain), _NOT_WORD, -1)


def _words(text: Column) -> Column:
    """Text whose lower-cased words stand for themselves."""
    return F.btrim(F.lower(text), F.lit(_EDGE))


def _windows(tokens: Column) -> Column:
    """Hashes of all windows; null for shorter texts.  The token array is bound
    once, so that it isn't split again for every window."""

    def of(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(t) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(t, i, WINDOW)))
        return F.when(F.size(t) >= WINDOW, each)

    return F.transform(F.array(tokens), of)[0]


def _slots(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.isin(_NAME, _NUM, _UNIT))


def benchmark_windows(items: DataFrame, item_id: str, text: str, plain: bool = False) -> DataFrame:
    """``item_id, item_pos, h, types, values, of`` -- one row per distinct window
    with enough plain words; ``of`` counts those of the item."""
    base = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    marked = base.select("item_id", (_words if plain else _marked)(F.col("text")).alias("m")).where("item_id IS NOT NULL")
    v = F.split("m", _NOT_WORD, -1)
    split = marked.select("item_id", v.alias("v"), (v if plain else _template(F.col("m"))).alias("t")).where(F.size("t") >= WINDOW)
    split = stored(split)  # a small table; keeps the splits from being repeated below
    at = split.select("item_id", "v", "t", F.posexplode(_windows(F.col("t"))).alias("item_pos", "h"))
    start = F.col("item_pos") + 1
    w = at.select("item_id", "item_pos", "h", F.slice("t", start, WINDOW).alias("types"), F.slice("v", start, WINDOW).alias("values"))
    w = w.where(F.size(_slots(F.col("types"))) <= WINDOW - PLAIN).dropDuplicates(["item_id", "h"])
    return stored(w.join(w.groupBy("item_id").agg(F.count(F.lit(1)).alias("of")), "item_id"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    consistency: float = CONSISTENCY,
) -> DataFrame:
    """One row per document and benchmark item it contains: ``doc_id, item_id,
    matched, windows`` (of the item), ``coverage, slots, slot_consistency,
    kind`` ('verbatim', or 'reparameterised' if a slot value differs).

    Null, empty and shorter texts (fewer than five words) contain nothing, and
    items like that are contained nowhere.  Rows with a null id are left out.
    Repeated documents give one row per id and item.  Empty tables give none;
    extra columns are ignored.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    out = stored(_contained(*read, threshold, consistency, plain=False))
    return out.unionByName(_contained(*read, threshold, consistency, plain=True).join(out.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti"))


def _contained(docs: DataFrame, items: DataFrame, threshold: float, consistency: float, plain: bool) -> DataFrame:
    """What ``contaminated`` finds by templates, or by the ``plain`` words."""
    bench = benchmark_windows(items, "item_id", "text", plain)
    probe = bench.select("item_id", "item_pos", "h", "types", "values")
    probe = F.broadcast(probe) if probe.count() <= BROADCAST_ROWS else probe
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    marked = base.select("doc_id", (_words if plain else _marked)(F.col("text")).alias("m"))
    tokens = F.split("m", _NOT_WORD, -1) if plain else _template(F.col("m"))
    each = marked.select("doc_id", "m", F.posexplode(_windows(tokens)).alias("doc_pos", "h"))
    hit = each.join(probe, "h").withColumn("slotted", F.size(_slots(F.col("types"))) > 0)
    found = F.slice(F.split("m", _NOT_WORD, -1), F.col("doc_pos") + 1, WINDOW)
    hits = stored(
        hit.select(
            "doc_id",
            "item_id",
            "item_pos",
            (F.col("doc_pos") - F.col("item_pos")).alias("diagonal"),
            F.when(F.col("slotted"), F.arrays_zip("types", "values", found.alias("found"))).alias("slots"),
        )
    )
    on = ["doc_id", "item_id"]
    best = hits.groupBy(*on, "diagonal").agg(F.count(F.lit(1)).alias("n")).groupBy(*on)
    best = best.agg(F.max(F.struct("n", -F.col("diagonal"))).alias("b")).select(*on, (-F.col("b.col2")).alias("best"))
    sizes = bench.select("item_id", "of").distinct()
    slack = F.ceil((1 - threshold) * F.col("of")) + WINDOW
    near = hits.join(best, on).join(sizes, "item_id").where(F.abs(F.col("diagonal") - F.col("best")) <= slack)
    near = stored(near)
    cover = near.groupBy(*on, "of", "item_pos").agg(F.lit(1).alias("one")).groupBy(*on, "of").agg(F.count("one").alias("matched"))
    cover = cover.withColumn("coverage", F.col("matched") / F.col("of")).where(F.col("coverage") >= threshold)
    pair = near.select(*on, F.explode("slots").alias("s")).where(F.col("s.types").isin(_NAME, _NUM, _UNIT))
    pair = pair.groupBy(*on, F.col("s.types").alias("type"), F.lower("s.values").alias("value"), F.lower("s.found").alias("found"))
    by_value = pair.agg(F.count(F.lit(1)).alias("n")).groupBy(*on, "type", "value")
    other = F.sum(F.when(F.col("value") == F.col("found"), 0).otherwise(F.col("n")))
    by_value = by_value.agg(F.max("n").alias("agreed"), F.sum("n").alias("n"), other.alias("changed"))
    slots = by_value.groupBy(*on).agg(
        F.sum("n").alias("slots"), (F.sum("agreed") / F.sum("n")).alias("slot_consistency"), F.sum("changed").alias("changed")
    )
    out = cover.join(slots, on, "left").withColumn("slot_consistency", F.coalesce("slot_consistency", F.lit(1.0)))
    return out.where(F.col("slot_consistency") >= consistency).select(
        *on,
        "matched",
        F.col("of").alias("windows"),
        "coverage",
        F.coalesce("slots", F.lit(0)).cast("bigint").alias("slots"),
        "slot_consistency",
        F.when(F.coalesce("changed", F.lit(0)) > 0, "reparameterised").otherwise("verbatim").alias("kind"),
    )
