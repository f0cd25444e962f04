"""Personal data: typed patterns, and terms that give the protected entities away.

Patterns find the base spans. What remains can still reveal an entity: a term that hardly occurs in texts without it.
Over the whole corpus, ``p(entity | term) = texts with both / texts with the term`` and the pointwise mutual
information ``log2(p(entity | term) / p(entity))`` estimate how strongly a term discloses an entity. A term that
exceeds both thresholds, seen with the entity in enough different texts, becomes a span of kind ``term`` wherever it
stands, in every text, with or without the entity; base spans stay as they are, and words that touch one belong to it.
Protected are the values themselves and their parts, which many values share: the domain and the name of an address, the
network of an IP address, the issuer of a card, the area of a phone number. A term may meet the thresholds of a frequent
part by chance, so for parts its texts must also be unlikely enough under the part's own frequency: the Chernoff bound of
their number, times the pairs of terms and parts that could be tried, must stay below ``FALSE_ALARMS``.

``sanitised`` generalises terms that carry digits or a capital letter and removes the others.

Only built-in functions run. Terms and entities count as together anywhere in a text. All counts are over different
texts and are pre-aggregated before they are shuffled, by 64-bit hashes of terms, so an entity or term with a third of all
rows is one counter per task. A text makes a row for each pair of an entity and a term whose counts alone can still
meet the thresholds. The hashes of repeated texts, the entities, the disclosing terms and the rows with a disclosing term are each
broadcast when they are at most ``BROADCAST_ROWS``; beyond that the same joins shuffle the texts. The rows with their base
spans and the rows with a disclosing term are written to the shared folder; what only leads to the disclosing terms stays on
the executors' disks meanwhile, so small partitions make no small files.

Null texts count as empty and have no span. Rows are told apart by (id, text): equal rows get equal results, and copies
of a text count once as evidence. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueward.llm.common import documents_of, held_on_disk, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns, written so that a failed run of characters is not tried again from inside.
_NAME = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]+"
#: Stands for covered letters and digits; no term has it.
COVERED = "\x01"
MASKED_TERM = rf"[\p{{L}}\p{{N}}{COVERED}]+"
MIN_TEXTS = 2
MIN_SHARE = 0.5
MIN_BITS = 3.0
#: Terms that may be taken for disclosing a part by chance, in the whole corpus.
FALSE_ALARMS = 0.01
BROADCAST_ROWS = 1_000_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def added(total: Column, at: Column) -> Column:
        d = F.substring(F.reverse(digits), at, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(at % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), added) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(12, 19) & _luhn(_digits(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _placed(text: Column, pattern: str, offset: Column) -> Column:
    """Array of (start, end, value) of the matches, in code points: what stands between the matches gives their places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(offset.cast("int").alias("at"), empty.alias("found"))

    def add(state: Column, pair: Column) -> Column:
        first = state["at"] + F.length(pair["0"])
        last = first + F.length(pair["1"])
        one = F.struct(first.alias("start"), last.alias("end"), pair["1"].alias("value"))
        return F.struct(last.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda a, b: F.struct(a.alias("0"), b.alias("1")))
    return F.aggregate(pairs, start, add, lambda state: state["found"])


def _base(text: Column) -> Column:
    """Array of (start, rank, end, kind, entity), by start and then by kind."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,entity:string>>")

    def of_kind(rank: int, kind: str) -> Column:
        def span(s: Column) -> Column:
            value = F.lower(s["value"]) if kind in ("email", "ip") else _digits(s["value"])
            return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
                            F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), value).alias("entity"))

        mark = {"email": "@", "ip": ".", "phone": "+"}.get(kind, "")
        seen = F.contains(text, F.lit(mark)) & F.rlike(text, F.lit(PATTERNS[kind]))
        matches = F.filter(_placed(text, PATTERNS[kind], F.lit(0)), lambda s: _holds(kind, s["value"]))
        return F.when(seen, F.transform(matches, span)).otherwise(none)

    found = [of_kind(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def _protected(base: Column) -> Column:
    """Array of (e, part): hashes of the values of a row's base spans, and of the parts that other values may share."""
    def of_span(s: Column) -> Column:
        value = F.substring_index(s["entity"], ":", -1)
        net = F.concat_ws(".", F.slice(F.split(value, r"\."), 1, 2))
        parts = F.when(s["kind"] == "email", F.array(F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)),
                                                     F.concat(F.lit("name:"), F.regexp_replace(F.substring_index(value, "@", 1), "[0-9._%+-]+", "")))
                       ).when(s["kind"] == "ip", F.array(F.concat(F.lit("net:"), net))
                       ).when(s["kind"] == "card", F.array(F.concat(F.lit("issuer:"), F.substring(value, 1, 6)))
                       ).otherwise(F.array(F.concat(F.lit("area:"), F.substring(value, 1, 4))))
        named = F.filter(parts, lambda p: p != "name:")
        whole = F.array(F.struct(F.xxhash64(s["entity"]).alias("e"), F.lit(False).alias("part")))
        return F.concat(whole, F.transform(named, lambda p: F.struct(F.xxhash64(p).alias("e"), F.lit(True).alias("part"))))

    return F.array_distinct(F.flatten(F.transform(base, of_span)))


def _evidence(with_both: Column, with_term: Column, with_entity: Column, count: int) -> Column:
    """How unlikely it is, in nats, that so many of a term's texts have the entity by chance (Chernoff's bound)."""
    share, chance = with_both / with_term, with_entity / F.lit(float(count))
    there = share * F.ln(share / chance)
    without = F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - chance))).otherwise(0.0)
    return with_term * F.when(share > chance, there + without).otherwise(0.0)


def _masked(text: Column, base: Column) -> Column:
    """The text, as long as before, with ``COVERED`` for the letters and digits of its base spans."""
    text = F.translate(text, COVERED, " ")

    def cover(state: Column, span: Column) -> Column:
        first = F.greatest(span["start"], state["at"])
        hidden = F.regexp_replace(F.regexp_replace(F.substring(text, first + 1, span["end"] - first), r"[\p{L}\p{N}]", COVERED), f"[^{COVERED}]", " ")
        parts = F.concat(state["parts"], F.array(F.substring(text, state["at"] + 1, first - state["at"]), hidden))
        return F.when(span["end"] > state["at"], F.struct(span["end"].alias("at"), parts.alias("parts"))).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(base, start, cover, lambda state: F.concat(
        F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text))))


def _hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _bare_terms(masked: Column) -> Column:
    """Hashes of the terms that no base span touches."""
    words = F.filter(F.regexp_extract_all(masked, F.lit(MASKED_TERM), 0), lambda w: ~F.contains(w, F.lit(COVERED)))
    return F.array_distinct(F.transform(words, _hash))


def _tagged(masked: Column, wanted: Column) -> Column:
    """Array of (start, rank, end, kind): every place of the wanted terms that no base span touches."""
    words = F.regexp_extract_all(masked, F.lit(MASKED_TERM), 0)
    pairs = F.zip_with(F.slice(F.split(masked, MASKED_TERM, -1), F.lit(1), F.size(words)), words, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("word")))

    def add(state: Column, pair: Column) -> Column:
        first = state["at"] + pair["gap"]
        last = first + F.length(pair["word"])
        one = F.struct(first.alias("start"), F.lit(len(KINDS)).alias("rank"), last.alias("end"), F.lit("term").alias("kind"))
        hit = ~F.contains(pair["word"], F.lit(COVERED)) & F.array_contains(wanted, _hash(pair["word"]))
        return F.struct(last.alias("at"), F.when(hit, F.concat(state["found"], F.array(one))).otherwise(state["found"]).alias("found"))

    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda state: state["found"])


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), _hash))


def _small(df: DataFrame) -> DataFrame:
    """A table that is stored or held, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _term_texts(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """Number of different texts that have a term, for every term; ``copies`` has the contents that several rows share.

    Terms of texts that stand once are counters from the start; only those of copies are told apart by content.
    """
    marked = texts.withColumn("content", F.xxhash64("text")).join(copies.withColumn("copy", F.col("content")), "content", "left")
    return (
        marked.select("copy", F.explode(_terms(F.col("text"))).alias("t")).groupBy("t", "copy").agg(F.count("*").alias("n"))
        .groupBy("t").agg(F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(1)).alias("with_term")))


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_texts: int = MIN_TEXTS,
                  min_share: float = MIN_SHARE, min_bits: float = MIN_BITS, false_alarms: float = FALSE_ALARMS) -> DataFrame:
    """``(id, row_key, base, terms)``: arrays of spans (start, rank, end, kind, entity), both in code points."""
    key = F.struct(F.xxhash64(id_column, "text").alias("a"), F.hash(id_column, "text").alias("b")).alias("row_key")
    texts = documents_of(docs, id_column, text_column).select(F.col(id_column), text_or_empty(text_column).alias("text"))
    rows = stored(
        texts.withColumn("base", _base(F.col("text")))
        .select(
            id_column, key, F.xxhash64("text").alias("content"), "base",
            F.when(F.size("base") > 0, _bare_terms(_masked(F.col("text"), F.col("base")))).alias("bare")))
    contents = held_on_disk(rows.groupBy("content").agg(F.count("*").alias("n")))
    count = contents.count()
    copies = _small(contents.where("n > 1").select("content"))
    telling = held_on_disk(rows.where(F.size("base") > 0).select("content", _protected(F.col("base")).alias("entities"), "bare").dropDuplicates(["content"]))
    bits = lambda share: F.log2(share * count / F.col("with_entity"))
    # No share is above 1, and none above with_entity / with_term: what misses a threshold even so leaves before the pairs are made.
    with_entity = held_on_disk(
        telling.select(F.inline("entities")).groupBy("e", "part").agg(F.count("*").alias("with_entity"))
        .where((F.col("with_entity") >= min_texts) & (bits(F.lit(1.0)) >= min_bits)))
    held = held_on_disk(
        telling.select("content", F.inline("entities")).join(_small(with_entity), ["e", "part"])
        .groupBy("content").agg(F.collect_list(F.struct("e", "part", "with_entity")).alias("held"), F.max("with_entity").alias("most")))
    most = held.agg(F.max("most")).first()[0] or 0
    with_term = held_on_disk(_term_texts(texts, copies).where((F.col("with_term") >= min_texts) & (most / F.col("with_term") >= min_share)))
    tried = with_term.count() * held.select(F.explode("held.e").alias("e")).distinct().count()
    limit = math.log(max(tried, 1) / false_alarms)
    bare = telling.join(held.select("content"), "content", "left_semi").select("content", F.explode("bare").alias("t")).join(with_term, "t")
    both = (
        bare.join(held.where("most > 0"), "content").where(F.col("most") / F.col("with_term") >= min_share)
        .select("t", "with_term", F.explode("held").alias("h")).select("t", "with_term", "h.e", "h.part", "h.with_entity")
        .where(F.col("with_entity") / F.col("with_term") >= min_share)
        .groupBy("e", "part", "t", "with_entity", "with_term").agg(F.count("*").alias("with_both")).where(F.col("with_both") >= min_texts))
    share = F.col("with_both") / F.col("with_term")
    sure = ~F.col("part") | (_evidence(F.col("with_both"), F.col("with_term"), F.col("with_entity"), max(count, 1)) >= limit)
    disclosing = held_on_disk(both.where((share >= min_share) & (bits(share) >= min_bits) & sure).select("t").distinct())
    hits = stored(
        texts.select(key, F.explode(_terms(F.col("text"))).alias("t")).join(_small(disclosing), "t")
        .groupBy("row_key").agg(F.collect_set("t").alias("wanted")))
    for table in (disclosing, with_term, held, with_entity, telling, contents):
        table.unpersist()
    found = (
        texts.select("text", key).join(_small(hits), "row_key").withColumn("masked", _masked(F.col("text"), _base(F.col("text"))))
        .select("row_key", _tagged(F.col("masked"), F.col("wanted")).alias("terms")).dropDuplicates(["row_key"]))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return rows.join(found, "row_key", "left").select(
        id_column, "row_key", "base", F.coalesce("terms", none).alias("terms"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    short = lambda spans: F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "rank", "end", "kind"))))
    every = F.array_sort(F.concat(short(F.col("base")), short(F.col("terms"))))
    return found.select(
        id_column, *(counted(k) for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(every).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitised(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **limits: float) -> DataFrame:
    """``(id, text)``: base spans become ``<kind>``; disclosing terms become ``<term>`` or go. Of overlapping spans the first counts."""
    texts = documents_of(docs, id_column, text_column).select(
        F.col(id_column), text_or_empty(text_column).alias("text"),
        F.struct(F.xxhash64(F.col(id_column), text_or_empty(text_column)).alias("a"),
                 F.hash(F.col(id_column), text_or_empty(text_column)).alias("b")).alias("row_key"))
    brief = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    spans = personal_data(docs, id_column, text_column, **limits).select(
        "row_key", F.array_sort(F.concat(F.transform("base", brief), F.transform("terms", brief))).alias("spans")
    ).dropDuplicates(["row_key"])
    text = F.col("text")

    def cut(state: Column, s: Column) -> Column:
        value = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        general = F.when(s["kind"] != "term", F.concat(F.lit("<"), s["kind"], F.lit(">"))).when(
            F.rlike(value, F.lit(r"[\p{N}\p{Lu}]")), F.lit("<term>")).otherwise(F.lit(""))
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        taken = F.struct(s["end"].alias("at"), F.concat(state["out"], kept, general).alias("out"))
        return F.when(s["start"] >= state["at"], taken).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,kind:string>>")), start, cut,
                       lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))
    return texts.join(spans, "row_key", "left").select(id_column, done.alias("text"))
