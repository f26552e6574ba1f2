"""Benchmark decontamination by templates, in DataFrame operations only.

Numbers, names and units of texts become typed placeholders; windows of five template words of the benchmark are
indexed by hash and joined with the documents' windows, so a question with other numbers or names still matches.  The
values in the placeholders of a match are then compared: each value of the question must stand for one value throughout.

Texts are read in two ways: with each capitalised word as a name, wherever it stands; and without names and in lower
case, so that case and line breaks do not matter.  Items too short for a template are held against plain words.  A
document holds an item if it does in one of the readings.

Every window of every document is probed.  An item that may miss m of its n windows is sure to share one of any m + 1,
so only its m + 1 windows that the fewest items have bring candidates: wording that many items share brings few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

WINDOW, SIMILARITY = 5, 0.8
#: Template words other than placeholders that a window needs, so that bare lists of numbers match nothing.
LITERALS = 2
#: Bytes of a hash table up to which a side is broadcast, and of one of its rows (a hash and an id).
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 48
#: Readings: names by capitals, no names, plain words. Plain items of fewer words than PLAIN_WORDS must be the whole document.
NAMES, LOWER, PLAIN, PLAIN_WORDS = 0, 1, 2, 3

# Tags of the three types of placeholder, the sign that joins the groups of a number, and units.
NUMBER, NAME, UNIT, JOINT = "\ue000", "\ue001", "\ue002", "\ue003"
UNITS = "kg|mg|g|km|cm|mm|m|mi|ft|lb|oz|l|ml|h|min|s|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|dollars?|euros?|cents?|percent|liters?|litres?"
SPACE = r"[ \t\n\x0b\f\r]"

#: A unit directly after a digit or after white space, in any case.
_UNIT = rf"([0-9]){SPACE}*((?iu:{UNITS}))(?!\p{{L}})"
#: Groups of digits with one of .,:/ between them are one number.
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
_BREAK = rf"[^\p{{L}}\p{{Nd}}{NUMBER}-{JOINT}]+"
_CAPITAL = r"^\p{Lu}\p{Ll}"


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, _BREAK), "")


def _typed(text: Column) -> Column:
    """Words in their case; numbers and units are words of their own, of which the tag alone is left."""
    return _split(F.regexp_replace(F.regexp_replace(text, _UNIT, f"$1 {UNIT} "), _NUMBER, f" {NUMBER} "))


def _valued(text: Column) -> Column:
    """The same words, with the values of numbers and units behind their tags."""
    joined = F.regexp_replace(F.regexp_replace(text, _UNIT, f"$1 {UNIT}$2 "), r"[.,:/](?<=[0-9].)(?=[0-9])", JOINT)
    return _split(F.regexp_replace(joined, rf"[0-9][0-9{JOINT}]*", f" {NUMBER}$0 "))


def _plain(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), "")


def _named(words: Column, name) -> Column:
    """Words in lower case, capitalised ones by name(word)."""
    foreign = lambda w: (w < "a") | (w >= "{")  # noqa: E731  what begins with a-z needs no pattern
    return F.transform(words, lambda w: F.when(foreign(w) & w.rlike(_CAPITAL), name(w)).otherwise(F.lower(w)))


def _tagged(text: Column) -> list[Column]:
    """A text's words in each reading, with values behind the tags."""
    words = _valued(text)
    return [_named(words, lambda w: F.concat(F.lit(NAME), F.lower(w))), F.transform(words, F.lower), _plain(text)]


def _is_tag(first: Column) -> Column:
    return first.isin(NUMBER, NAME, UNIT)


def _template(tagged: Column) -> Column:
    return F.transform(tagged, lambda w: F.when(_is_tag(F.substring(w, 1, 1)), F.substring(w, 1, 1)).otherwise(w))


def _starts(words: Column, k: Column, reading: Column | None = None) -> Column:
    """Where windows of k words begin, from 1; of a plain item below PLAIN_WORDS only if these are all words."""
    fits = (k > 0) & (F.size(words) >= k)
    if reading is not None:
        fits = fits & ((reading != PLAIN) | (k >= PLAIN_WORDS) | (F.size(words) == k))
    return F.when(fits, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))


def _windows(rows: DataFrame, *keys: str) -> DataFrame:
    """(reading, k, keys, at, h, words, values) of rows with reading, k and tagged."""
    rows = rows.withColumn("template", _template(F.col("tagged")))
    reading, k, template, tagged = (F.col(c) for c in ("reading", "k", "template", "tagged"))
    each = F.transform(_starts(template, k, reading), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(template, i, k)).alias("h"), F.slice(template, i, k).alias("words"), F.slice(tagged, i, k).alias("values")))
    return rows.select("reading", "k", *keys, F.inline(each))


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows are within the bound; df is checkpointed."""
    return F.broadcast(df) if df.count() * ROW_BYTES <= BROADCAST_BYTES else df


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of a document and a benchmark item whose template it holds: doc_id, item_id, n_windows, n_matched, similarity, n_slots, verbatim.

    similarity is the share of the item's template windows that the document has, at any places; pairs from `similarity`
    on count, if the slots are consistent: at the offset where most windows match (the smallest of them), each value in
    a placeholder of the item always meets one and the same value in the document.  n_slots counts these values;
    verbatim tells that all are the item's own.  A window has LITERALS other words at least; an item of three words
    or more, but fewer than `window`, has one window, its whole template.  An item without such a window is compared word
    by word, numbers included: its words must stand in the document in a row, and items of one or two words must be all
    of it.  Items without letters (null and empty texts too) match nothing.

    A pair that matches in several readings has the columns of the first of them.

    Rows without doc_id cannot be named in a result and are not searched; rows that share one count as one document.
    Repeated items (same id) count once.  Other columns are ignored.  Empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull())
    index = checkpoint(_index(benchmark, window))
    sizes = index.groupBy("reading", "item_id").agg(F.count(F.lit(1)).alias("n_windows"))
    # The items' rarest windows, one more than may be missing.
    order = Window.partitionBy("reading", "item_id").orderBy("shared", "q")
    ranked = index.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("h"))).withColumn("place", F.row_number().over(order)).join(sizes, ["reading", "item_id"])
    anchors = ranked.filter(F.col("place") <= F.floor(F.col("n_windows") * (1 - similarity) + 1e-9) + 1)
    anchors = checkpoint(anchors.select("h", "reading", "item_id", "k").distinct())
    used = sorted((r["reading"], r["k"]) for r in anchors.select("reading", "k").distinct().collect())  # few: window lengths
    probes = rows.select("doc_id", F.lit(0).cast("long").alias("h")).limit(0)
    for plain in (False, True):
        if any((i == PLAIN) == plain for i, _ in used):
            probes = probes.union(_probes(rows, [(i, k) for i, k in used if (i == PLAIN) == plain]))
    pairs = checkpoint(probes.join(_small(anchors), "h").select("reading", "doc_id", "item_id", "k").distinct())
    return _judge(rows, index, pairs, sizes, similarity)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose document holds no benchmark item, with all their columns; rows without an id stay."""
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(found, docs[id_col] == found["_held"], "left_anti")


def _hashes(words: Column, k: int) -> Column:
    return F.transform(_starts(words, F.lit(k), F.lit(PLAIN)), lambda i: F.xxhash64(F.slice(words, i, k)))


def _probes(rows: DataFrame, used: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, h) of all windows of these readings and lengths; the readings are all PLAIN or none is."""
    if used[0][0] == PLAIN:
        words = rows.select("doc_id", _plain(F.col("text")).alias("w"))
        hashes = [_hashes(F.col("w"), k) for _, k in used]
        return words.select("doc_id", F.explode(F.concat(*hashes)).alias("h"))
    words = rows.select("doc_id", _typed(F.col("text")).alias("w"))
    words = words.select("doc_id", _named(F.col("w"), lambda w: F.lit(NAME)).alias(f"w{NAMES}"), F.transform("w", F.lower).alias(f"w{LOWER}"))
    # The words of a window side by side, so that generated code hashes them; the hash of columns is that of an array, and skips nulls.
    width, windows = max(k for _, k in used), []
    for i, k in used:
        own, n = F.col(f"w{i}"), F.greatest(F.size(f"w{i}") - (k - 1), F.lit(0))
        columns = [F.slice(own, j + 1, n) if j < k else F.array_repeat(F.lit(None).cast("string"), n) for j in range(width)]
        windows.append(F.arrays_zip(*[c.alias(f"c{j}") for j, c in enumerate(columns)]))
    each = words.select("doc_id", F.inline(F.concat(*windows)))
    return each.select("doc_id", F.xxhash64(*each.columns[1:]).alias("h"))


def _index(benchmark: DataFrame, window: int) -> DataFrame:
    """(reading, item_id, k, q, h, words, item_values): an item's windows."""
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    items = items.select("item_id", F.posexplode(F.array(*_tagged(F.col("text")))).alias("reading", "tagged"))
    words = F.size("tagged")
    windows = _windows(items.withColumn("k", F.when(F.col("reading") == PLAIN, words).otherwise(F.least(F.lit(window), words))), "item_id")
    literal = F.size(F.filter("words", lambda w: ~_is_tag(w)))
    lettered = F.exists("words", lambda w: w.rlike(r"\p{L}"))
    windows = windows.filter(F.when(F.col("reading") == PLAIN, lettered).otherwise((literal >= LITERALS) & (F.col("k") >= PLAIN_WORDS)))
    # Plain words stand in only for items that no other reading has.
    first = F.min("reading").over(Window.partitionBy("item_id"))
    windows = windows.withColumn("first", first).filter((F.col("reading") != PLAIN) | (F.col("first") == PLAIN))
    return windows.select("reading", "item_id", "k", F.col("at").alias("q"), "h", "words", F.col("values").alias("item_values"))


def _judge(rows: DataFrame, index: DataFrame, pairs: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """The result for these pairs (reading, doc_id, item_id, k)."""
    pair = ["reading", "doc_id", "item_id"]
    ids = checkpoint(pairs.select("doc_id").distinct())
    candidates = rows.join(_small(ids), "doc_id", "left_semi")
    tagged = candidates.select("doc_id", F.posexplode(F.array(*_tagged(F.col("text")))).alias("reading", "tagged"))
    asked = pairs.groupBy("reading", "doc_id").agg(F.collect_set("k").alias("ks"))  # window lengths, at most as many as there are
    windows = _windows(tagged.join(asked, ["reading", "doc_id"]).select("reading", "doc_id", F.explode("ks").alias("k"), "tagged"), "doc_id").withColumnRenamed("words", "doc_words")
    windows = windows.join(_small(checkpoint(index.select("h").distinct())), "h", "left_semi")
    wanted = pairs.join(index, ["reading", "item_id", "k"])
    matched = windows.join(wanted, ["reading", "doc_id", "k", "h"]).filter(F.col("doc_words") == F.col("words"))
    matched = matched.select(*pair, "q", (F.col("at") - F.col("q")).alias("offset"), F.arrays_zip("item_values", "values").alias("slots"))
    slots = F.filter("slots", lambda s: (F.col("reading") != PLAIN) & _is_tag(F.substring(s["item_values"], 1, 1)))
    matched = checkpoint(matched.withColumn("slots", slots))
    whole = matched.groupBy(*pair).agg(F.count_distinct("q").alias("n_matched")).join(sizes, ["reading", "item_id"])
    whole = whole.withColumn("similarity", F.col("n_matched") / F.col("n_windows")).filter(F.col("similarity") >= similarity)
    offsets = matched.groupBy(*pair, "offset").agg(F.count_distinct("q").alias("n"))
    best = offsets.groupBy(*pair).agg(F.min(F.struct((-F.col("n")).alias("n"), "offset")).alias("best")).select(*pair, F.col("best.offset").alias("offset"))
    values = matched.join(best, [*pair, "offset"]).select(*pair, F.explode("slots").alias("slot")).select(*pair, F.col("slot.item_values").alias("asked"), F.col("slot.values").alias("found")).distinct()
    judged = values.groupBy(*pair).agg(F.count_distinct("asked").alias("n_slots"), F.count(F.lit(1)).alias("n_values"), F.bool_and(F.col("asked") == F.col("found")).alias("verbatim"))
    out = whole.join(judged, pair, "left").filter(F.coalesce(F.col("n_slots") == F.col("n_values"), F.lit(True)))
    rest = ["n_windows", "n_matched", "similarity", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("verbatim", F.lit(True)).alias("verbatim")]
    first = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("reading", *rest)).alias("first"))
    return first.select("doc_id", "item_id", *[F.col(f"first.{c}").alias(c) for c in ("n_windows", "n_matched", "similarity", "n_slots", "verbatim")])
