"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders, so that a question asked
again with other values has the same template. Windows of template words are
hash-joined to those of the benchmark, once as written and once in lower case,
where a capital makes no name: so copies in other case hit too, with other
numbers and units. Hits on one diagonal (place in the
document less place in the item) or on near ones form a candidate. A candidate
is a leak if enough of the item's windows hit and its slots are filled
consistently: one value of the item always stands for one value of the document.

The windows of a document never leave its partition unless they hit. A window of
the benchmark carries a key of its item, not its words; this side is broadcast
while its counted bytes are within BROADCAST_BYTES, and beyond that the same
join shuffles. The words of an item are joined to its candidates alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import measured

#: Words in a window; an item of fewer words is one window.
WINDOW = 5
#: A benchmark window needs so many literal words to hit with other values, or all of its words if it is shorter.
MIN_LITERAL = 3
#: Share of an item's windows that must hit on near diagonals, and of its slots that must be consistent.
MIN_SHARE, MIN_CONSISTENT = 0.5, 0.9
#: Diagonals this near count together, for a word put in or left out.
DRIFT = 2
BROADCAST_BYTES = 32 << 20
#: Bytes that a benchmark window takes in a broadcast table.
WINDOW_BYTES = 96
#: Words that count as units of measure, as fixed values.
UNITS = "km m cm mm kg g mg lb lbs oz mile miles meter meters metre metres foot feet inch inches yard yards hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros cent cents percent liter liters litre litres gallon gallons degree degrees mph kmh".split()
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
_MARK = r"[^\p{L}\p{N}$€£%]"


def words(text: Column) -> Column:
    """Words of a text, cut at white space, without the punctuation at their edges."""
    inner = F.regexp_replace(text, rf"^[\s]*{_MARK}*|{_MARK}*$", "")
    return F.array_remove(F.split(inner, rf"{_MARK}*\s+{_MARK}*"), "")


def template(word: Column) -> Column:
    """The word in lower case, or the placeholder of its type."""
    typed = F.when(word.rlike(r"^\p{Lu}"), F.lit(NAME)).when(word.rlike(r"^[$€£]?[0-9][0-9.,:/]*(?:st|nd|rd|th)?%?$"), F.lit(NUMBER)).otherwise(F.lower(word))
    return F.when(word.rlike(r"^[\p{Lu}0-9$€£]"), typed).when(F.lower(word).isin(UNITS), F.lit(UNIT)).otherwise(F.lower(word))


def folded(word: Column) -> Column:
    """The template of the word whatever its case: numbers and units are slots, names are literal."""
    return template(F.lower(word))


#: What is made of a word before windows are hashed: windows that say too little
#: in the first two forms hit by the words themselves. Documents are hashed in as many forms as the benchmark uses.
FORMS = (template, folded, F.lower)


def is_slot(word: Column) -> Column:
    return template(word).isin(NUMBER, NAME, UNIT)


def windows(rows: DataFrame, keys: list[str], w: int, forms: int = len(FORMS)) -> DataFrame:
    """(keys, place, form, hash): a row for each run of ``w`` words in each of the first ``forms``; places count from 0.

    Every word is hashed once in each form, and a window hashes the hashes of its words.
    """
    hashed = lambda form: F.transform("words", lambda x: F.xxhash64(form(x)))
    codes = rows.select(*keys, (F.size("words") - w + 1).alias("n"), *(hashed(form).alias(f"codes{k}") for k, form in enumerate(FORMS[:forms])))
    at = lambda k, i: F.get(f"codes{k}", i)
    # Null where there are too few words, which gives no row; a filter would hash the words twice.
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))
    hashes = lambda k: F.transform(starts, lambda i: F.xxhash64(*(at(k, i + j) for j in range(w))))
    out = codes.select(*keys, "n", F.posexplode(F.concat(*(hashes(k) for k in range(forms)))).alias("at", "hash"))
    return out.select(*keys, (F.col("at") % F.col("n")).alias("place"), F.floor(F.col("at") / F.col("n")).cast("int").alias("form"), "hash")


def item_windows(items: DataFrame) -> dict[int, DataFrame]:
    """Benchmark windows in the forms in which they say enough, by their length: (item_key, place, form, hash, told, total, told_total).

    Every place has a window. ``total`` counts an item's places, ``told_total``
    those that have a window in the first form, which are ``told``.
    """
    lengths = [r[0] for r in items.where(F.size("words") > 0).select(F.least(F.size("words"), F.lit(WINDOW)).alias("w")).distinct().collect()]
    out = {}
    for w in lengths:
        own = items.where(F.least(F.size("words"), F.lit(WINDOW)) == w)
        own = windows(own.withColumn("item_words", F.col("words")), ["item_key", "item_words"], w)
        run = F.slice("item_words", F.col("place") + 1, w)
        enough = lambda form: F.size(F.filter(run, lambda x: ~is_slot(form(x)))) >= min(w, MIN_LITERAL)
        same, low = enough(lambda x: x), enough(F.lower)
        own = own.where(F.when(F.col("form") == 0, same).when(F.col("form") == 1, low).otherwise(~low))
        own = own.drop("item_words").withColumn("told", (F.min("form").over(Window.partitionBy("item_key", "place")) == 0))
        item = Window.partitionBy("item_key")
        places = lambda which: F.size(F.collect_set(which).over(item))
        own = own.withColumn("total", places(F.col("place"))).withColumn("told_total", places(F.when(F.col("told"), F.col("place"))))
        # A window without capitals is the same in several forms.
        out[w] = own.groupBy("item_key", "place", "hash", "told", "total", "told_total").agg(F.max("form").alias("form"))
    return out


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_key, spots): items of which enough windows hit on near diagonals.

    ``spots`` has (-share, diagonal, hits) of each diagonal where that is so,
    the best first. A place of the item counts on the nearest diagonal it hits.
    """
    found = []
    for w, own in item_windows(items).items():
        own = own.select("item_key", "total", "told_total", F.col("place").alias("at"), "form", "told", "hash")
        last = own.agg(F.max("form")).first()[0]
        side = measured(own.drop("form"), F.lit(WINDOW_BYTES), BROADCAST_BYTES)
        hits = windows(docs, ["doc_id", "text_key"], w, last + 1).drop("form").join(side, "hash")
        lines = hits.groupBy("doc_id", "text_key", "item_key", "total", "told_total", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set(F.struct("at", "told")).alias("places"))
        found.append(lines.withColumn("w", F.lit(w)))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, text_key bigint, item_key bigint, spots array<struct<less:double,diagonal:int,hits:array<struct<at:int,diagonal:int,w:int>>>>")
    lines = reduce(DataFrame.unionAll, found)
    lines = lines.withColumn("own", F.transform("places", lambda p: F.struct(p["at"].alias("at"), F.col("diagonal"), F.col("w"), p["told"].alias("told"))))
    pair = Window.partitionBy("doc_id", "text_key", "item_key")
    near = pair.orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    lines = lines.withColumn("hits", F.flatten(F.collect_list("own").over(near)))
    # Of all windows, or of those that say enough as written: more windows in lower case must not hide a copy with other names.
    places = lambda hits: F.size(F.array_distinct(F.transform(hits, lambda h: h["at"])))
    share = F.greatest(places(F.col("hits")) / F.col("total"), F.when(F.col("told_total") > 0, places(F.filter("hits", lambda h: h["told"])) / F.col("told_total")))
    lines = lines.withColumn("share", share).where(F.col("share") >= MIN_SHARE)
    ordered = F.array_sort(F.transform("hits", lambda h: F.struct(h["at"].alias("at"), F.abs(h["diagonal"] - F.col("diagonal")).alias("off"), h["diagonal"].alias("diagonal"), h["w"].alias("w"))))
    lines = lines.withColumn("ordered", ordered)
    nearest = F.filter("ordered", lambda h, i: (i == 0) | (F.get("ordered", i - 1)["at"] != h["at"]))
    lines = lines.withColumn("nearest", F.transform(nearest, lambda h: F.struct(h["at"].alias("at"), h["diagonal"].alias("diagonal"), h["w"].alias("w"))))
    spot = F.struct((-F.col("share")).alias("less"), F.col("diagonal").alias("diagonal"), F.col("nearest").alias("hits"))
    return lines.groupBy("doc_id", "text_key", "item_key").agg(F.array_sort(F.collect_list(spot)).alias("spots"))


def consistent(item_words: Column, doc_words: Column, hits: Column) -> Column:
    """Share of slot values of the item that stand for one value of the document in whatever case, 1 without slots."""
    aligned = F.array_distinct(
        F.flatten(F.transform(hits, lambda h: F.transform(F.sequence(F.lit(0), h["w"] - 1), lambda j: F.struct(F.get(item_words, h["at"] + j).alias("a"), F.lower(F.get(doc_words, h["at"] + h["diagonal"] + j)).alias("b")))))
    )
    slots = F.filter(aligned, lambda p: is_slot(p["a"]))
    # Distinct pairs of which no earlier pair has the same item value.
    count = F.aggregate(slots, F.struct(F.array().cast("array<string>").alias("values"), F.lit(0).alias("pairs")), lambda s, p: F.struct(F.array_union(s["values"], F.array(p["a"])).alias("values"), (s["pairs"] + 1).alias("pairs")), lambda s: F.when(s["pairs"] == 0, F.lit(1.0)).otherwise(F.size(s["values"]) / s["pairs"]))
    return count


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, leaks), one row per input row.

    ``leaks`` has (item_id, first_word, last_word, share, consistency) of each
    item found. Copies in capitals or lower case are found; in them a name is a
    literal, since nothing tells it from other words. Null or empty texts and items match nothing; windows of few
    literal words hit only by the same words in whatever case. Rows repeated with the same
    id and text get the same result; an empty table gives an empty one. Other
    columns are read only with ``carry``, which adds the input row as ``row``.
    """
    extra = [F.struct("*").alias("row")] if carry else []
    text = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *extra)
    text = text.withColumn("text_key", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    items = items.dropDuplicates(["item_id", "words"]).withColumn("item_key", F.xxhash64("item_id", "words"))
    found = candidates(text.select("doc_id", "text_key", words(F.col("text")).alias("words")), items)
    told = items.select(F.col("item_key").alias("of_key"), "item_id", F.col("words").alias("item_words"))
    told = measured(told, F.coalesce(F.octet_length(F.array_join("item_words", " ")), F.lit(0)) + 48, BROADCAST_BYTES)
    found = found.join(told, F.col("item_key") == F.col("of_key"))
    by_doc = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_id", "item_words", "spots")).alias("found"))
    by_doc = by_doc.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "found")
    joined = text.join(by_doc, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left")
    # A column that is used more than once is computed once, not again for every slot.
    joined = joined.withColumn("own", F.when(F.col("found").isNotNull(), words(F.col("text"))))
    leak = lambda c, p: F.struct(
        c["item_id"].alias("item_id"),
        F.array_min(F.transform(p["hits"], lambda h: h["at"] + h["diagonal"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform(p["hits"], lambda h: h["at"] + h["diagonal"] + h["w"] - 1)).cast("bigint").alias("last_word"),
        (-p["less"]).alias("share"),
        F.when(F.size("own") > 0, consistent(c["item_words"], F.col("own"), p["hits"])).alias("consistency"),
    )
    # Of all places where an item fits, the best of those that are consistent.
    leaks = F.transform("found", lambda c: F.get(F.filter(F.transform(c["spots"], lambda p: leak(c, p)), lambda x: x["consistency"] >= MIN_CONSISTENT), F.lit(0)))
    leaks = F.coalesce(F.array_sort(F.filter(leaks, lambda x: x.isNotNull())), F.array())
    # Exploding the array of this one array keeps the rows as they are, and keeps
    # the optimizer from copying the check into every condition put on its result.
    out = joined.select("doc_id", *["row"] * carry, F.explode(F.array(leaks)).alias("leaks"))
    ids = F.array_distinct(F.transform("leaks", lambda x: x["item_id"]))
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"), "leaks", *["row"] * carry)
