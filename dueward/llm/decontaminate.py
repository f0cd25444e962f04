"""Benchmark decontamination by question templates.

Numbers, names and units become typed placeholders, so that a question with other parameters keeps its template.
Template windows of ``WINDOW`` tokens are hashed and joined by equality. A document and an item make a pair when the
matched windows cover half of the item, or a run of them covers ``RUN`` tokens in one piece. Only the windows of
alignments whose slots agree count: within one shift of the item against the document, one value of the item always
stands for the same value of the document, otherwise the match is chance. So a page may hold an item several times, with
other values each time. A pair is re-parameterised if its verbatim alignments alone are not enough.

Only built-in functions run. Every window of every whole text is looked up. The distinct window hashes of the benchmark (8
bytes each) and its windows are each broadcast when their own counted number is at most ``BROADCAST_WINDOWS``; beyond that
the same join is left to a shuffle by hash. Only matched windows are carried on, so a passage that a third of all documents share costs a
few rows for each of them.

Windows with fewer than ``MIN_LITERALS`` other tokens than slots would match by chance as templates; they are matched with
the values of their slots, so that verbatim copies of items made of numbers or names are found. ``n_windows`` and
``item_windows`` count both kinds; half of an item's templates, as far as it has any, is enough too.

Items shorter than a window are looked up at their own length; items or texts without tokens match nothing. Null texts
count as empty. Rows are told apart by (id, text): equal rows give one result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dueward.llm.common import documents_of, stored, text_or_empty

WINDOW = 8
RUN = 13
COVERAGE = 0.5
CONSISTENCY = 0.85
MIN_LITERALS = 4
BROADCAST_WINDOWS = 1_000_000
# Units that may follow a number.
UNITS = (
    "km|m|cm|mm|mi|miles?|feet|foot|ft|inch(?:es)?|kg|g|mg|lbs?|pounds?|ounces?|oz|l|ml|lit(?:er|re)s?|gallons?|"
    "hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|"
    "met(?:er|re)s?|kilomet(?:er|re)s?|kilograms?|grams?|mph|kmh|%|€|\\$|°"
)
_NUMBER = r"[0-9]++(?:[.,:/][0-9]++)*+"
_NAME = r"(?<=[\p{Ll}\p{N},;][ ])\p{Lu}\p{Ll}++(?:[ -]\p{Lu}\p{Ll}++)*+"
_TOKEN = "[\x01-\x03][^\x04]*+\x04|[\\p{L}\\p{M}]++"


def tokens(text: Column) -> Column:
    """Lower-case words; a slot is its type (1 number, 2 name, 3 unit), its value and an end mark."""
    marked = F.regexp_replace(text, "[\x01-\x04]", " ")
    marked = F.regexp_replace(marked, _NAME, " \x02$0\x04 ")
    marked = F.regexp_replace(marked, f"({_NUMBER})(?: ?({UNITS})(?![\\p{{L}}]))", " \x01$1\x04 \x03$2\x04 ")
    marked = F.regexp_replace(marked, f"(?<![\x01\x02\x030-9.,:/]){_NUMBER}", " \x01$0\x04 ")
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), 0)


def _is_slot(token: Column) -> Column:
    return token < F.lit("\x05")


def _windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` with ``tokens`` to one row per window: ``at, size, hash, exact, slots`` (null when the text has none).

    ``exact`` windows have too few literals for a template: their hash is that of the tokens' values, whatever their type
    (a capital after a small letter makes a name, so the word that opens an item may be one in the document), and they
    have no slots to compare.
    """
    shaped = rows.withColumn("has_slots", F.exists("tokens", _is_slot)).withColumn(
        "shape", F.when(F.col("has_slots"), F.transform("tokens", lambda t: F.when(_is_slot(t), F.substring(t, 1, 1)).otherwise(t))).otherwise(F.col("tokens")))

    def of_size(size: int) -> Column:
        def slotted(at: Column) -> Column:
            return F.struct(at.alias("at"), F.when(F.col("has_slots"), F.filter(F.slice("tokens", at, size), _is_slot)).alias("slots"))

        def window(w: Column) -> Column:
            exact = F.coalesce(F.size(w["slots"]), F.lit(0)) > size - min(MIN_LITERALS, size)
            values = F.transform(F.slice("tokens", w["at"], size), lambda t: F.translate(t, "\x01\x02\x03\x04", ""))
            hashed = F.when(exact, F.xxhash64(values, F.lit("exact"))).otherwise(F.xxhash64(F.slice("shape", w["at"], size)))
            return F.struct(w["at"].alias("at"), F.lit(size).alias("size"), hashed.alias("hash"), exact.alias("exact"), F.when(~exact, w["slots"]).alias("slots"))

        last = F.size("tokens") - size + 1
        none = F.array().cast("array<struct<at:int,size:int,hash:bigint,exact:boolean,slots:array<string>>>")
        return F.when(last >= 1, F.transform(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), slotted), window)).otherwise(none)

    every = of_size(sizes[0]) if len(sizes) == 1 else F.concat(*(of_size(s) for s in sizes))
    return shaped.select(*(c for c in rows.columns if c != "tokens"), F.inline(every))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN, coverage: float = COVERAGE,
                 consistency: float = CONSISTENCY, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id, item, n_windows, item_windows, run_tokens, slot_consistency, reparameterised)`` of every contaminated pair."""
    items = documents_of(benchmark, item_column, item_text).select(
        F.xxhash64(item_column, item_text).alias("item_key"), F.col(item_column).alias("item"), tokens(text_or_empty(item_text)).alias("tokens"))
    items = items.dropDuplicates(["item_key"]).withColumn("own", F.least(F.size("tokens"), F.lit(window))).where("own > 0")
    sizes = sorted(r.own for r in items.select("own").distinct().collect())
    kind, item_kind = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    if not sizes:
        return docs.sparkSession.createDataFrame([], (
            f"`{id_column}` {kind}, `{item_column}` {item_kind}, n_windows long, item_windows long, run_tokens long, "
            "slot_consistency double, reparameterised boolean"))
    asked = _windows(items, sizes).where("size = own")
    asked = asked.select("item_key", "item", "size", F.col("at").alias("item_at"), "hash", "exact", F.col("slots").alias("item_slots"))
    own_windows = W.partitionBy("item_key")
    asked = asked.withColumn("item_windows", F.count("*").over(own_windows)).withColumn(
        "item_templates", F.count_if(~F.col("exact")).over(own_windows))
    asked = stored(asked)
    # Both sides by their own rows: many items of one template have few hashes but many windows.
    windows, hashes = asked.count(), asked.select("hash").distinct()
    if windows <= BROADCAST_WINDOWS:
        asked = F.broadcast(asked)
    if windows <= BROADCAST_WINDOWS or hashes.count() <= BROADCAST_WINDOWS:
        hashes = F.broadcast(hashes)
    texts = documents_of(docs, id_column, text_column).select(
        F.col(id_column).alias("doc"), F.xxhash64(id_column, text_column).alias("doc_key"), tokens(text_or_empty(text_column)).alias("tokens"))
    seen = _windows(texts, sizes).drop("exact").join(hashes, "hash", "left_semi")
    # Matched windows are few; stored, so that the three counts below do not read the texts again.
    matched = stored(seen.join(asked, ["hash", "size"]).withColumn("shift", F.col("at") - F.col("item_at")))
    pair = ["doc_key", "doc", "item_key", "item"]
    islands = matched.groupBy(*pair, "shift", "item_at", "size", "exact", "item_windows", "item_templates").agg(F.first("slots").alias("slots"), F.first("item_slots").alias("item_slots"))
    islands = islands.withColumn("island", F.col("item_at") - F.row_number().over(W.partitionBy(*pair, "shift").orderBy("item_at")))
    slots = F.explode_outer(F.arrays_zip(F.coalesce("item_slots", F.array()).alias("theirs"), F.coalesce("slots", F.array()).alias("ours")))
    # One alignment is one shift of a pair: only within it must a value of the item keep its meaning.
    values = islands.where("size(slots) > 0").select("doc_key", "item_key", "shift", slots.alias("s")).select("doc_key", "item_key", "shift", "s.theirs", "s.ours")
    agreed = (
        values.groupBy("doc_key", "item_key", "shift", "theirs").agg(F.countDistinct("ours").alias("n"), F.max(F.col("theirs") != F.col("ours")).alias("other"))
        .groupBy("doc_key", "item_key", "shift").agg(F.avg((F.col("n") == 1).cast("double")).alias("agreement"), F.max("other").alias("other")))
    islands = (
        islands.join(agreed, ["doc_key", "item_key", "shift"], "left")
        .withColumn("agreement", F.coalesce("agreement", F.lit(1.0))).withColumn("other", F.coalesce("other", F.lit(False)))
        .where(F.col("agreement") >= consistency))
    runs = islands.groupBy(*pair, "shift", "other", "island").agg((F.count("*") + F.first("size") - 1).alias("tokens"))
    verbatim, template = ~F.col("other"), ~F.col("exact")
    places = lambda chosen: F.size(F.collect_set(F.when(chosen, F.col("item_at"))))
    found = islands.groupBy(*pair).agg(
        places(F.lit(True)).cast("long").alias("n_windows"), places(template).alias("n_templates"),
        places(verbatim).alias("n_verbatim"), places(verbatim & template).alias("n_verbatim_templates"),
        F.first("item_windows").alias("item_windows"), F.first("item_templates").alias("item_templates"))
    longest = runs.groupBy(*pair).agg(
        F.max("tokens").alias("run_tokens"), F.coalesce(F.max(F.when(~F.col("other"), F.col("tokens"))), F.lit(0)).alias("run_verbatim"))
    # The alignment with the most windows gives the pair its consistency.
    leading = (
        islands.groupBy("doc_key", "item_key", "shift").agg(F.count("*").alias("n"), F.first("agreement").alias("agreement"))
        .groupBy("doc_key", "item_key").agg(F.max(F.struct("n", "agreement")).alias("leading")))

    def enough(n: str, n_templates: str, run_tokens: str) -> Column:
        # A variant with other values can only have the templates, so they count by themselves too.
        of_templates = (F.col("item_templates") > 0) & (F.col(n_templates) >= coverage * F.col("item_templates"))
        return (F.col(n) >= coverage * F.col("item_windows")) | of_templates | (F.col(run_tokens) >= run)

    return (
        found.join(longest.drop("doc", "item"), ["doc_key", "item_key"]).join(leading, ["doc_key", "item_key"])
        .withColumn("slot_consistency", F.col("leading.agreement"))
        .withColumn("reparameterised", ~enough("n_verbatim", "n_verbatim_templates", "run_verbatim"))
        .where(enough("n_windows", "n_templates", "run_tokens"))
        .select(F.col("doc").alias(id_column), F.col("item").alias(item_column), "n_windows", "item_windows",
                F.col("run_tokens").cast("long").alias("run_tokens"), "slot_consistency", "reparameterised"))
