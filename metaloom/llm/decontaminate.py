"""Benchmark decontamination (operator 3): template windows, a hash join, and slot consistency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.scale import cut_lineage, maybe_broadcast

#: Typed placeholders: private characters that lower-casing and the clean-up leave alone.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
#: Units of measure that count as such right after a number.
UNITS = (
    "km|cm|mm|kg|mg|ml|ms|hz|khz|mhz|ghz|kb|mb|gb|tb|mph|kmh|usd|eur|gbp|miles?|meters?|metres?|feet|foot|inch(?:es)?|yards?|grams?|pounds?|ounces?|tons?|"
    "lit(?:er|re)s?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|percent|dollars?|euros?|cents?|watts?|volts?|m|g|l|s|h|w|v"
)
NUMBER_UNIT = rf"(?<![\p{{L}}\p{{N}}])([0-9]+(?:[.,:/][0-9]+)*)\s?(%|(?i:{UNITS})(?![\p{{L}}\p{{N}}]))"
#: Takes a number behind its placeholder along, so that digits after its point or comma are not found again.
PLAIN_NUMBER = rf"(?<![\p{{L}}\p{{N}}{NUMBER}]){NUMBER}?([0-9]+(?:[.,:/][0-9]+)*)"
CAPITALISED = r"(?=\p{Lu})(?<=[^.!?:;|\s]\s)(\p{Lu}[\p{L}'-]*)"
MARKS = rf"[^\p{{L}}\p{{N}}\s{NUMBER}-{NAME}]+"

WIDTH = 5  # words of a window
SHARE = 0.8  # of an item's windows, in line or in a band of places, make a match
RUN = 12  # so many windows in line (16 words) do so too: a long part of an item
LITERALS = 2  # words of a window that must be no placeholders


def template_words(text: Column, values: bool) -> Column:
    """Words of a text in lower case without marks; numbers, units after numbers and names become placeholders.

    A name is a capitalised word that does not start a sentence or line of cells. With
    ``values`` the placeholder is followed by the word it stands for.
    """
    v = (lambda g: f"${g}") if values else (lambda g: "")
    text = F.regexp_replace(text, NUMBER_UNIT, f" {NUMBER}{v(1)} {UNIT}{v(2)} ")
    text = F.regexp_replace(text, PLAIN_NUMBER, f" {NUMBER}{v(1)} ")
    text = F.regexp_replace(text, CAPITALISED, f"{NAME}{v(1)}")
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), MARKS, ""), r"\s+", " ")), " ")


def _is_slot(word: Column) -> Column:
    return (word >= F.lit(NUMBER)) & (word < F.lit("\ue003"))


def _templates(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(_is_slot(w), F.substring(w, 1, 1)).otherwise(w))


def _hashes(words: Column, width: int) -> Column:
    """Hash of each window of a word array, which must be a column (a lambda would compute an expression anew each time)."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a computed column behind a generator, so that later lambdas read it instead of computing it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _windows(df: DataFrame, width: int) -> DataFrame:
    return df.where(F.size("template") >= width).select("*", F.posexplode(_hashes(F.col("template"), width)).alias("place", "hash"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, items, share, reworded): documents that hold an item of ``benchmark`` (item_id, text), whole or nearly so.

    1. Texts of both sides become template words; the hashes of all document windows are
       joined with those of the items. Only hashes leave the scan, and only if the table of
       items is too large to broadcast (its size is checked) are they shuffled.
    2. For documents with a hit, windows are lined up: by item and by distance of places. A
       line with ``share`` of the item's windows, or with ``run`` of them, is a candidate, and
       so is a band of places with ``share`` of the item's windows on any lines, which holds
       copies with words put in or taken out.
    3. Its slots must be consistent, see ``_matches``, unless ``share`` of the item's windows,
       or ``run`` of them on one line, are there to the value. ``reworded`` tells that some value differs: a re-parameterised
       question.

    Items shorter than ``width`` are matched as a whole; windows with fewer than two literal
    words are left out. ``items`` lists the matched item ids in rising order, ``share`` is the
    best share of windows found. Null or empty texts hold nothing. Rows with equal id and
    text are one row here; null ids are allowed; without items the result is empty.
    """
    items = _once(benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text")), "words", template_words(F.col("text"), True))
    items = cut_lineage(_once(items.drop("text"), "template", _templates(F.col("words"))).withColumn("width", F.least(F.size("words"), F.lit(width))).where(F.col("template")[0] != ""))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # at most ``width`` numbers
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text <> ''").withColumn("text_hash", F.xxhash64("text"))
    keys = rows.select("doc_id", "text_hash")
    if not widths:
        return keys.limit(0).select("*", F.array().cast("array<bigint>").alias("items"), F.lit(0.0).alias("share"), F.lit(False).alias("reworded"))

    def per_width(make):
        parts = [make(w) for w in widths]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    literal = F.size(F.filter(F.slice("template", F.col("place") + 1, F.col("width")), lambda w: ~_is_slot(w)))
    listed = cut_lineage(per_width(lambda w: _windows(items.where(F.col("width") == w), w)).where(literal >= F.least(F.lit(LITERALS), F.col("width"))).select("item_id", F.col("width"), F.col("place").alias("item_place"), "hash", F.slice("words", F.col("place") + 1, F.col("width")).alias("item_words")))
    totals = listed.groupBy("item_id").agg(F.count("*").alias("windows"))

    scanned = _once(rows, "template", template_words(F.col("text"), False)).select("doc_id", "text_hash", "template")
    wanted = listed.select("hash", "width").distinct()
    hits = per_width(lambda w: _windows(scanned, w).select("doc_id", "text_hash", "hash").join(maybe_broadcast(wanted.where(F.col("width") == w).select("hash")), "hash", "left_semi"))
    suspects = cut_lineage(hits.select("doc_id", "text_hash").distinct())

    near = suspects.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    texts = rows.join(maybe_broadcast(near), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = _once(texts, "words", template_words(F.col("text"), True)).drop("text")
    texts = cut_lineage(_once(texts, "template", _templates(F.col("words"))))
    found = per_width(
        lambda w: _windows(texts, w).select("doc_id", "text_hash", "place", "hash", F.slice("words", F.col("place") + 1, w).alias("doc_words")).join(maybe_broadcast(listed.where(F.col("width") == w).drop("width")), "hash")
    )
    hits = cut_lineage(found.select("doc_id", "text_hash", "item_id", "place", "item_place", (F.col("place") - F.col("item_place")).alias("shift"), _slot_pairs(F.col("item_words"), F.col("doc_words")).alias("pairs")))
    lines = _matches(hits, ["doc_id", "text_hash", "item_id", "shift"], totals, share, run)
    lines = lines.drop("shift").unionByName(_matches(_banded(hits, items, totals, share), ["doc_id", "text_hash", "item_id", "band"], totals, share, None).drop("band"))
    return lines.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.round(F.max("share"), 9).alias("share"), F.bool_or("differs").alias("reworded"))


def _banded(hits: DataFrame, items: DataFrame, totals: DataFrame, share: float) -> DataFrame:
    """Hits once per band of places they lie in, one hit for each item window of a band.

    Bands begin every quarter of the item's words and are seven quarters long, so each stretch
    of the document of one and a half times the item's length lies within one. Of several
    hits of an item window the one on the line with most hits in the band counts. Only items
    with ``share`` of their windows somewhere in the document are looked at.
    """
    pair = ["doc_id", "text_hash", "item_id"]
    whole = hits.groupBy(*pair).agg(F.size(F.collect_set("item_place")).alias("all")).join(maybe_broadcast(totals), "item_id").where(F.col("all") / F.col("windows") >= share)
    whole = whole.join(maybe_broadcast(items.select("item_id", F.greatest(F.ceil(F.size("words") / 4), F.lit(1)).alias("step"))), "item_id")
    whole = cut_lineage(whole.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("item_id").alias("_item"), "step"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")) & (F.col("item_id") == F.col("_item"))
    last = F.floor(F.col("place") / F.col("step"))
    banded = hits.join(maybe_broadcast(whole), same).select(*pair, "item_place", "shift", "pairs", F.explode(F.sequence(last - 6, last)).alias("band"))
    banded = banded.withColumn("line", F.count("*").over(Window.partitionBy(*pair, "band", "shift")))
    best = Window.partitionBy(*pair, "band", "item_place").orderBy(F.desc("line"), "shift")
    return banded.withColumn("order", F.row_number().over(best)).where("order = 1").drop("order", "line", "shift")


def _slot_pairs(item_words: Column, doc_words: Column) -> Column:
    """Different pairs (a, b) of values at the placeholders of two windows with equal templates."""
    pairs = F.zip_with(item_words, doc_words, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.array_distinct(F.filter(pairs, lambda p: _is_slot(p["a"])))


def _matches(hits: DataFrame, keys: list[str], totals: DataFrame, share: float, run: int | None) -> DataFrame:
    """(keys, share, differs): the groups of hits that are a copy of their item, by windows and by slots.

    A group needs ``share`` of the item's windows, or ``run`` of them where that is given. Its
    slots, those of matched windows only, must be consistent: a value of the item stands for one
    value of the document and a unit or name of the document for one of the item; two numbers may
    get the same new value. With ``share`` of the windows, or ``run`` of a line, alike to the value
    no slots are asked: so long a passage of the item is a leak whatever stands around it.
    """
    literal = ~F.exists("pairs", lambda p: p["a"] != p["b"])
    groups = hits.groupBy(*keys).agg(
        F.size(F.collect_set("item_place")).alias("found"), F.size(F.collect_set(F.when(literal, F.col("item_place")))).alias("literal"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    groups = groups.join(maybe_broadcast(totals), "item_id").withColumn("share", F.col("found") / F.col("windows"))
    enough, verbatim = F.col("share") >= share, F.col("literal") / F.col("windows") >= share
    if run is not None:
        enough, verbatim = enough | (F.col("found") >= run), verbatim | (F.col("literal") >= run)
    distinct = lambda values: F.size(F.array_distinct(values)) == F.size(values)
    typed = F.filter("pairs", lambda p: F.substring(p["a"], 1, 1) != NUMBER)
    consistent = distinct(F.transform("pairs", lambda p: p["a"])) & distinct(F.transform(typed, lambda p: p["b"]))
    differs = F.exists("pairs", lambda p: p["a"] != p["b"])
    return groups.where(enough & (consistent | verbatim)).select(*keys, "share", differs.alias("differs"))


def _with_leaks(docs: DataFrame, leaks: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    found = leaks.select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash"), F.struct("items", "share", "reworded").alias("_leak"))
    same = docs[id_col].cast("long").eqNullSafe(F.col("_leak_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_leak_hash"))
    return docs.join(maybe_broadcast(found), same, how)


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, items, share, reworded) of every row, see ``find_leaks``; clean rows have no items and share 0."""
    leaks = cut_lineage(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    leak = F.col("_leak")
    return _with_leaks(rows, leaks, "doc_id", "text", "left").select(
        "doc_id", leak.isNotNull().alias("contaminated"), F.coalesce(leak["items"], F.array().cast("array<bigint>")).alias("items"), F.coalesce(leak["share"], F.lit(0.0)).alias("share"), F.coalesce(leak["reworded"], F.lit(False)).alias("reworded")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, that hold no item."""
    leaks = cut_lineage(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col))
    return _with_leaks(docs, leaks, id_col, text_col, "left_anti")
