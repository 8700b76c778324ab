"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Numbers (grouped and decimal ones are one slot), names (capitalised words; words all in capitals are
not) and units (after a number) become typed placeholders, everything else its lower-case word, so a question
asked again with other parameters has the same template. A capitalised word that opens a sentence may
be a name or not: the benchmark's windows are indexed in both readings. Windows of ``WINDOW`` template words of the documents are hash-joined with
those of the benchmark. Matches are gathered by alignment (document, item, shift), and windows count
as far as their slots are consistent (``_judged``): a value of the item stands for one value in the
document, a name also the other way round. An item leaked if enough consistent windows match.

The window table of the benchmark is broadcast only after its rows have been counted
(``BROADCAST_ROWS``); beyond that both sides are shuffled by the window hash. The document ids that
matched at all are treated the same way for the second look at their texts.

Items too short for that, or with too few windows of ``LITERALS`` plain words, are found as whole
verbatim copies (``_verbatim``), however short they are.

Edge cases: null texts and texts without a word never match; repeated items each match; rows that share a
doc_id are reported under that id once; a null doc_id or item_id is a group like any other;
extra columns are ignored by ``leaks`` and kept by ``drop_leaks``; empty tables give no leak; a text of any length
is one row of its words and their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land

WINDOW = 8
LITERALS = 5  # plain words a window must have: placeholders alone prove nothing
SHARE = 0.3  # of an item's windows, or ENOUGH windows, whichever is fewer
ENOUGH = 6
BROADCAST_ROWS = 200_000
# Units that may follow a number (fixed values).
UNITS = ("kg|mg|g|km|cm|mm|m|ml|l|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|ft|inch(?:es)?|"
         "meters?|metres?|grams?|pounds?|lbs?|litres?|liters?|dollars?|euros?|cents?|percent|usd|eur|mph|kmh")
# In marked texts: what opens a slot, the point inside a decimal number, the end of a name that opens a sentence.
_NUMBER, _NAME, _UNIT, _POINT, _OPENER = "\x01", "\x02", "\x03", "\x04", "\x05"
_SEPARATOR = r"[^\p{L}\p{M}\p{N}\x01-\x05]+"
# The patterns open with the class that fails soonest; what stands before follows as a look back.
_UNIT_AT = rf"(?<=\p{{Nd}})\s?((?i:{UNITS}))(?![\p{{L}}\p{{N}}])"
_NUMBER_AT = r"\p{Nd}(?<![\p{L}\p{N}\x04]\p{Nd})[\p{Nd}\x04]*(?!\p{L})"
_NAME_AT = r"\p{Lu}(?<![\p{L}\p{M}\p{N}\x03]\p{Lu})\p{Ll}[\p{L}\p{M}]*"
_REST = r"[\p{L}\p{M}\p{N}\x04]*"


def _bare(text: Column) -> Column:
    """The text without our markers."""
    return F.when(text.rlike(f"[{_NUMBER}-{_OPENER}]"), F.translate(text, _NUMBER + _NAME + _UNIT + _POINT + _OPENER, "")).otherwise(text)


def _plain_numbers(text: Column) -> Column:
    """The text without our markers, every grouped or decimal number one word."""
    grouped = F.regexp_replace(_bare(text), r",(?<=\p{Nd},)(?=\p{Nd}{3}(?!\p{Nd}))", "")
    return F.regexp_replace(grouped, r"\.(?<=\p{Nd}\.)(?=\p{Nd})", _POINT)


def marked(text: Column) -> Column:
    """The text with a marker before every slot value."""
    units = F.regexp_replace(_plain_numbers(text), _UNIT_AT, f" {_UNIT}$1")
    return F.regexp_replace(F.regexp_replace(units, _NUMBER_AT, f"{_NUMBER}$0"), _NAME_AT, f"{_NAME}$0")


def template(text: Column) -> Column:
    """The text with a marker in place of every slot value: ``template_words(marked(text))`` in fewer passes.

    A text without a digit has no numbers and no units.
    """
    units = F.regexp_replace(_plain_numbers(text), _UNIT_AT + _REST, f" {_UNIT}")
    numbers = F.when(text.rlike(r"\p{Nd}"), F.regexp_replace(units, _NUMBER_AT + _REST, _NUMBER)).otherwise(_bare(text))
    slots = F.regexp_replace(numbers, _NAME_AT + _REST, _NAME)
    return F.split(F.lower(slots), _SEPARATOR)


def with_openers(marks: Column) -> Column:
    """A marked text with the names that may be capitalised only for opening a sentence told apart."""
    return F.regexp_replace(marks, r"(?<![\p{L}\p{N},;] )\x02[\p{L}\p{M}]+", f"$0{_OPENER}")


def plain_openers(marks: Column) -> Column:
    """The other reading of ``with_openers``: ordinary words open the sentences."""
    return F.regexp_replace(marks, r"\x02([\p{L}\p{M}]+)\x05", "$1")


def slot_words(marks: Column) -> Column:
    """Words of a marked text; slot values keep their marker."""
    return F.split(F.lower(marks), _SEPARATOR)


def template_words(marks: Column) -> Column:
    """Words of the template, in step with ``slot_words``; a slot is its marker alone."""
    return F.split(F.lower(F.regexp_replace(marks, r"([\x01-\x03])[\p{L}\p{M}\p{N}\x04\x05]+", "$1")), _SEPARATOR)


def _windows(words: Column) -> Column:
    """Hash of every window, from the hashes of its words."""
    n = F.size(words)
    return F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)])))


def _window_rows(texts: DataFrame, key: str) -> DataFrame:
    """(key, at, hash) of every window of ``texts(key, text)``.

    The windows are hashed after the words are exploded, in generated code. The outer form keeps
    Spark from testing the array for emptiness first, which would work the words out twice.
    """
    words = texts.where(F.col("text").isNotNull()).select(
        key, F.transform(template(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    first = words.select(key, "words", F.posexplode_outer("words").alias("at", "first")).where(F.col("at") + WINDOW <= F.size("words"))
    return first.select(key, "at", F.xxhash64("first", *[F.get("words", F.col("at") + j) for j in range(1, WINDOW)]).alias("hash"))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast behind a count; a shuffle join beyond it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _item_windows(items: DataFrame) -> DataFrame:
    """(item_id, at, hash, sure) of the windows that have enough plain words.

    Both readings of the words that open sentences; ``sure`` is the one a copy letter by letter has.
    """
    marks = items.where(F.col("text").isNotNull()).select("item_id", with_openers(marked(F.col("text"))).alias("marks"))
    readings = marks.select("item_id", F.explode(F.array(
        F.struct(F.lit(True).alias("sure"), template_words(F.col("marks")).alias("words")),
        F.struct(F.lit(False).alias("sure"), template_words(plain_openers(F.col("marks"))).alias("words")))).alias("r"))
    words = readings.select("item_id", "r.sure", "r.words").withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = words.select("item_id", "sure", "words", F.posexplode(_windows(F.col("hashes"))).alias("at", "hash"))
    plain = F.size(F.filter(F.slice("words", F.col("at") + 1, WINDOW), lambda w: (F.length(w) > 0) & (w > F.lit(_OPENER))))
    return rows.where(plain >= LITERALS).groupBy("item_id", "at", "hash").agg(F.max("sure").alias("sure"))


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, shift, starts: the item's windows found at that shift in the document."""
    windows = land(_item_windows(items).drop("sure"), "item-windows")
    found = _window_rows(docs.select("doc_id", "text"), "doc_id").join(
        _bounded(windows.withColumnRenamed("at", "item_at")), "hash")
    return found.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.sort_array(F.collect_set("item_at")).alias("starts"))


def _needed(n: Column) -> Column:
    return F.least(F.lit(ENOUGH), F.greatest(F.lit(1), F.ceil(n * F.lit(SHARE)))).cast("long")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (found), item_windows, n_changed (slots with another value).

    The alignment with most consistent windows of every document and item that leaked into it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select("item_id", "text")
    # a copy has the sure windows, so the share that is needed is one of these
    sizes = _item_windows(items).groupBy("item_id").agg(F.countDistinct(F.when(F.col("sure"), F.col("at"))).alias("item_windows"))
    enough = land(alignments(docs, items).join(sizes.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item")))
                  .where(F.size("starts") >= _needed(F.col("item_windows"))).drop("_item"), "alignments")
    # a second look at the texts that matched, for the values of their slots
    ids = _bounded(enough.select(F.col("doc_id").alias("_id")).distinct())
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("_id"), slot_words(marked(F.col("text"))).alias("doc_words"))
    asked = items.where(F.col("text").isNotNull()).select(
        F.col("item_id").alias("_item"), slot_words(with_openers(marked(F.col("text")))).alias("item_words"))
    rows = (enough.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")))
            .join(asked, F.col("item_id").eqNullSafe(F.col("_item"))))
    kept = _judged(rows).where(F.col("n_windows") >= _needed(F.col("item_windows")))
    whole = _verbatim(docs, items, sizes)
    if whole is not None:
        kept = kept.unionByName(whole)
    best = F.max(F.struct("n_windows", (-F.col("n_changed")).alias("same"))).alias("best")
    return kept.groupBy("doc_id", "item_id", "item_windows").agg(best).select(
        "doc_id", "item_id", F.col("best.n_windows").alias("n_windows"), "item_windows", (-F.col("best.same")).alias("n_changed"))


def literal_words(text: Column) -> Column:
    """Lower-case words of a text, slots with their values, without empty ones."""
    return F.filter(F.split(F.lower(F.regexp_replace(_plain_numbers(text), _UNIT_AT, " $1")), _SEPARATOR), lambda w: F.length(w) > 0)


def _verbatim(docs: DataFrame, items: DataFrame, sizes: DataFrame) -> DataFrame | None:
    """Whole copies of the items whose windows could miss one; None without such items.

    What stands around a copy changes how its first and last word are read, so only the windows
    between them are sure to be found. Items that need more than those are looked up by their
    literal words: by a hash of the first ones (at most ``WINDOW``), then word by word. A text is gone
    through once for every number of first words, holding one hash a word and one a place.
    """
    read = items.where(F.col("text").isNotNull()).select("item_id", literal_words(F.col("text")).alias("item_words"), F.size(
        template_words(marked(F.col("text")))).alias("n"), (F.substring(marked(F.col("text")), 1, 1).rlike(_SEPARATOR)).cast("int").alias("lead"))
    read = read.where(F.size("item_words") > 0).distinct()
    inner = _item_windows(items).where("sure").withColumnRenamed("item_id", "_item").join(
        read, F.col("item_id").eqNullSafe(F.col("_item"))).where(
        (F.col("at") > F.col("lead")) & (F.col("at") + WINDOW < F.col("lead") + F.size("item_words"))).groupBy("_item").agg(
        F.countDistinct("at").alias("inner"))
    sized = sizes.withColumnRenamed("item_id", "_sized")
    unsure = read.join(sized, F.col("item_id").eqNullSafe(F.col("_sized")), "left").join(
        inner, F.col("item_id").eqNullSafe(F.col("_item")), "left").where(
        F.coalesce("inner", F.lit(0)) < F.coalesce(_needed(F.col("item_windows")), F.lit(1)))
    first = F.least(F.size("item_words"), F.lit(WINDOW))
    unsure = land(unsure.select("item_id", "item_words", F.coalesce("item_windows", F.lit(1)).cast("long").alias("item_windows"), first.alias("first"),
                                _run_hash(F.transform("item_words", lambda w: F.xxhash64(w)), F.lit(0), first).alias("hash")), "whole-items")
    lengths = [r["first"] for r in unsure.select("first").distinct().collect()]  # at most WINDOW
    if not lengths:
        return None
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_id"), literal_words(F.col("text")).alias("words"))
    hashes = texts.select("doc_id", "text_id", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    each = hashes.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("k")).where(F.size("hashes") >= F.col("k"))
    runs = F.transform(F.sequence(F.lit(0), F.size("hashes") - F.col("k")), lambda i: _run_hash("hashes", i, F.col("k")))
    near = each.select("doc_id", "text_id", F.posexplode(runs).alias("at", "hash"))
    keys = unsure.select("hash", F.col("item_words").alias("whole"), "item_id", "item_windows")
    near = land(near.join(_bounded(keys), "hash").select("doc_id", "text_id", "at", "item_id", "item_windows", "whole").distinct(), "whole-copies")
    ids = _bounded(near.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_id") == F.col("_text"))
    look = texts.join(ids, same, "left_semi").select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"), "words").distinct()
    found = near.join(look, same).where(F.slice("words", F.col("at") + 1, F.size("whole")) == F.col("whole"))
    return found.select("doc_id", "item_id", "item_windows", F.col("item_windows").alias("n_windows"), F.lit(0).cast("long").alias("n_changed")).distinct()


def _run_hash(hashes: Column | str, at: Column, n: Column) -> Column:
    """Hash of the hashes of ``n`` words from ``at`` on."""
    return F.xxhash64(F.slice(hashes, at + 1, n))


def _judged(rows: DataFrame) -> DataFrame:
    """The alignments with ``n_windows`` and ``n_changed`` of their consistent part.

    A number or unit of the item stands for one value, its own where that occurs, else the commonest;
    two of them may stand for the same. Windows with another value are no evidence. A name that stands
    for two names, or two that stand for one, are no evidence where they stand. Inside sentences they
    make the alignment suspect: then only windows that keep all values of the item are evidence. Words
    that open sentences do not, since they may be no names at all.
    """
    name = lambda p: p["a"].startswith(_NAME)
    clash = lambda p, names="names": F.exists(names, lambda q: (q["a"] == p["a"]) != (q["b"] == p["b"]))
    pairs = lambda slots: F.array_distinct(F.transform(slots, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))))
    inside = lambda p, s: p["at"].between(s, s + (WINDOW - 1))

    def stands_for(value: Column) -> Column:
        same = F.filter("slots", lambda p: p["a"] == value)
        count = lambda p: F.size(F.filter(same, lambda q: q["b"] == p["b"]))
        return F.array_max(F.transform(same, lambda p: F.struct((p["b"] == value).alias("own"), count(p).alias("n"), p["b"].alias("b"))))["b"]

    # landed, or every use below would work the slots out anew
    slots = land(rows.select("doc_id", "item_id", "starts", "item_windows", _slots().alias("slots")), "slots")
    slots = slots.withColumn("names", pairs(F.filter("slots", name))).withColumn(
        "inner", pairs(F.filter("slots", lambda p: name(p) & ~p["opener"])))
    slots = slots.withColumn("suspect", F.exists("inner", lambda p: clash(p, "inner"))).withColumn(
        "values", F.array_distinct(F.transform(F.filter("slots", lambda p: ~name(p)), lambda p: p["a"])))
    slots = slots.withColumn("stands", F.map_from_arrays("values", F.transform("values", stands_for)))
    against = lambda p: (F.col("suspect") & (p["a"] != p["b"])) | F.when(
        name(p), clash(p)).otherwise(F.element_at("stands", p["a"]) != p["b"])
    parts = slots.withColumn("bad", F.filter("slots", against)).withColumn(
        "good", F.filter("starts", lambda s: ~F.exists("bad", lambda p: inside(p, s))))
    changed = F.filter("slots", lambda p: (p["a"] != p["b"]) & F.exists("good", lambda s: inside(p, s)))
    return parts.select(
        "doc_id", "item_id", "item_windows", F.size("good").cast("long").alias("n_windows"),
        F.size(F.array_distinct(F.transform(changed, lambda p: F.struct(p["a"], p["b"])))).cast("long").alias("n_changed"))


def _slots() -> Column:
    """(at, item value, document value, opens a sentence of the item) of the slots in the windows found."""
    at = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (WINDOW - 1)))))
    word = lambda i: F.get("item_words", i)
    slots = F.transform(at, lambda i: F.struct(i.alias("at"), F.translate(word(i), _OPENER, "").alias("a"),
                                               F.get("doc_words", i + F.col("shift")).alias("b"), word(i).endswith(_OPENER).alias("opener")))
    slot = lambda w: w.substr(1, 1).isin(_NUMBER, _NAME, _UNIT)
    return F.filter(slots, lambda p: slot(p["a"]) & slot(p["b"]))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` no item leaked into."""
    bad = land(leaks(docs, items).select(F.col("doc_id").alias("_id")).distinct(), "leaking")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]), "left_anti")
