"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Texts are words, words are hashes, and ``GRAM`` neighbouring words give one number per
place. Of every ``SPAN - GRAM + 1`` neighbouring numbers the smallest is kept. Two texts
that share ``SPAN`` words in a row share all numbers inside, hence a kept one: the join
of kept numbers misses no shared span. Documents with a hit are then extended: their
windows of ``SPAN`` words are compared with those of the items by two 64-bit hashes of
all words. Items of fewer words are one window each and are looked up at their length.
Windows that the same items hold are one class, named by two hashes over these items;
a document meets items once per class, so a passage that many items share is short.

Null and empty texts have no words; rows that repeat give the same result each. Items
without an id count their words as hit but are not listed. With an empty table on
either side nothing is hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from brightrow.llm.common import numbered_columns, pick
from brightrow.session import durable

SPAN = 10
GRAM = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A side of a join this small is sent to every executor; beyond, both sides are shuffled.
SMALL_ROWS = 200_000
MAP_BITS = 2**27


def words(text: Column) -> Column:
    """Words of a text in order, an empty array for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(plain, BETWEEN), "")


def _kept(df: DataFrame, column: str) -> DataFrame:
    """Adds ``_kept``: the winnowed numbers of the word array ``column``.

    Numbers that reach over the end may be kept as well; they only add candidates.
    """
    hashed, name = _numbered(df, column, GRAM)
    window, size = SPAN - GRAM + 1, 1
    while size < window:
        step = min(size, window - size)
        hashed = hashed.withColumn(f"_m{size + step}", _beside(name, step, lambda a, b: F.least(a, b)))
        size, name = size + step, f"_m{size + step}"
    return hashed.withColumn("_kept", F.array_distinct(name))


def _numbered(df: DataFrame, column: str, gram: int) -> tuple[DataFrame, str]:
    """Adds one number per place for ``gram`` words from there, and tells its column."""
    hashed = df if "_g1" in df.columns else df.withColumn("_g1", F.transform(column, lambda w: F.xxhash64(w)))
    size, name = 1, "_g1"
    while size < gram:
        step = min(size, gram - size)
        longer = f"_g{size + step}"
        if longer not in hashed.columns:
            hashed = hashed.withColumn(longer, _beside(name, step, lambda a, b: F.xxhash64(a, b)))
        size, name = size + step, longer
    return hashed, name


def _beside(name: str, step: int, combine) -> Column:
    """Each element combined with the one ``step`` further."""
    return F.zip_with(name, F.slice(name, step + 1, F.greatest(F.size(name), F.lit(1))), combine)


def _windows(df: DataFrame, sizes: list[int], wanted: Callable[[int], Column], *keep: str) -> DataFrame:
    """One row per window of the sizes wanted: size, place, two hashes."""

    def of(size: int) -> Column:
        found = F.transform(
            F.sequence(F.lit(1), F.size("_words") - (size - 1)),
            lambda i: F.struct(
                F.lit(size).alias("size"),
                i.alias("at"),
                F.xxhash64(F.slice("_words", i, size)).alias("h"),
                F.xxhash64(F.lit("second"), F.slice("_words", i, size)).alias("g"),
            ),
        )
        none = F.array().cast("array<struct<size:int,at:int,h:bigint,g:bigint>>")
        return F.when((F.size("_words") >= size) & wanted(size), found).otherwise(none)

    each = df.select(*keep, F.explode(F.concat(*[of(n) for n in sizes])).alias("_w"))
    return each.select(*keep, *[F.col(f"_w.{c}").alias(f"_{c}") for c in ("size", "at", "h", "g")])


def _joined(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Broadcast ``small`` only if it is counted to be small; it must be written out."""
    return large.join(F.broadcast(small) if _few(small) else small, on, how)


def _key(by: Column, text: Column) -> Column:
    """Name of a row by id and text; null texts, which never have a hit, are spread over many."""
    none = F.concat(F.lit("none "), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
    return F.coalesce(F.md5(F.concat(F.coalesce(by.cast("string"), F.lit("none")), F.lit(" "), text)), none)


def _find(docs: DataFrame, benchmark: DataFrame, text: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Windows of items in the documents (``_key``, text): ``_key``, place, size and class; items of the classes.

    One pass over the texts finds candidates for windows of every size, one more their windows.
    """
    items = durable(
        pick(benchmark, item, text)
        .select(F.col(item).cast("string").alias("_item"), words(F.col(text)).alias("_words"))
        .withColumn("_size", F.least(F.size("_words"), F.lit(SPAN)))
        .where("_size > 0")
    )
    sizes = sorted(r["_size"] for r in items.select("_size").distinct().collect()) or [SPAN]  # at most SPAN
    marks = durable(_marked(items, sizes, lambda n: F.col("_size") == n, "_size").select("_mark_size", "_mark").distinct())
    split = docs.select("_key", words(F.col(text)).alias("_words"))
    offered = _marked(split, sizes, lambda n: F.lit(True), "_key", every=True)
    met = _joined(offered, marks, ["_mark_size", "_mark"], "leftsemi")
    # The sizes of a candidate are bits of one number.
    bit = F.call_function("shiftleft", F.lit(1), F.col("_mark_size"))
    candidates = durable(met.groupBy("_key").agg(F.bit_or(bit).alias("_sizes")))
    owned = durable(_windows(items, sizes, lambda n: F.col("_size") == n, "_item").drop("_at").distinct())
    near = _near(docs, candidates, text).select("_key", "_sizes", words(F.col(text)).alias("_words"))
    windows = _windows(near, sizes, lambda n: F.col("_sizes").bitwiseAND(1 << n) != 0, "_key")
    found = _joined(windows, durable(_classes(owned)), ["_size", "_h", "_g"])
    return durable(found.select("_key", "_at", "_size", "_c", "_d").distinct()), _owners(owned)


def _marked(df: DataFrame, sizes: list[int], wanted: Callable[[int], Column], *keep: str, every: bool = False) -> DataFrame:
    """Numbers to meet by, with the window size they stand for.

    For whole spans these are the winnowed ones. Short items have one number each, their
    first, which is looked up at ``every`` place of a document.
    """
    parts = []
    for n in sizes:
        if n == SPAN:
            df, numbers = _kept(df, "_words"), F.col("_kept")
        else:
            df, name = _numbered(df, "_words", n)
            numbers = F.array_distinct(name) if every else F.slice(name, 1, 1)
        tagged = F.transform(numbers, _tag(n))
        parts.append(F.when(wanted(n), tagged).otherwise(F.array().cast("array<struct<size:int,mark:bigint>>")))
    # The outer form keeps Spark from repeating the whole expression in a filter below.
    each = df.select(*keep, F.explode_outer(F.concat(*parts)).alias("_m"))
    return each.select(*keep, F.col("_m.size").alias("_mark_size"), F.col("_m.mark").alias("_mark"))


def _tag(size: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(size).alias("size"), m.alias("mark"))


def _near(docs: DataFrame, candidates: DataFrame, text: str) -> DataFrame:
    """The candidate documents with their sizes. Other texts are not moved: see :func:`_sifted`."""
    rows = docs.select("_key", text)
    if _few(candidates):
        return rows.join(F.broadcast(candidates), "_key")
    return _sifted(rows, candidates).where("_maybe").drop("_maybe").join(candidates, "_key")


def _few(small: DataFrame) -> bool:
    return small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def _sifted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``_maybe``, false only for rows whose ``_key`` is not among ``keys``.

    Keys set bits of a map of ``MAP_BITS``, sent to every executor: 16 MB however many they are.
    """
    place = F.pmod(F.xxhash64("_key"), F.lit(MAP_BITS)) + 1
    bits = (
        keys.groupBy(F.bitmap_bucket_number(place).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    )
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.call_function("getbit", byte, (at % 8).cast("int")) == 1
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket", "left")
    return joined.withColumn("_maybe", F.coalesce(found, F.lit(False))).drop("_bucket", "_bits")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", by: str = "doc_id") -> DataFrame:
    """The documents, all columns, without those that hold a window of an item."""
    names = documents.columns
    plain = numbered_columns(documents)
    body = f"_{names.index(text)}"
    keyed = plain.withColumn("_key", _key(F.col(f"_{names.index(by)}"), F.col(body)))
    hits, _ = _find(keyed.select("_key", F.col(body).alias(text)), benchmark, text, "item_id")
    dirty = durable(hits.select("_key").distinct())
    if _few(dirty):
        clean = keyed.join(F.broadcast(dirty), "_key", "leftanti")
    else:
        sifted = _sifted(keyed, dirty)
        doubtful = sifted.where("_maybe").join(dirty, "_key", "leftanti")
        clean = sifted.where("not _maybe").unionByName(doubtful).drop("_maybe")
    return clean.drop("_key").toDF(*names)


def find_contaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", by: str = "doc_id", item: str = "item_id"
) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted texts of ids) and contaminated."""
    docs = pick(documents, by, text).withColumn("_key", _key(F.col(by), F.col(text)))
    hits, owners = _find(docs, benchmark, text, item)
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("_at", "_size"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["_at"] + x["_size"]).alias("end"),
            (a["total"] + F.greatest(F.lit(0), x["_at"] + x["_size"] - F.greatest(a["end"], x["_at"]))).alias("total"),
        ),
        lambda a: a["total"].cast("long"),
    )
    per_key = hits.groupBy("_key").agg(covered.alias("n_hit"))
    listed = (
        _joined(hits.select("_key", "_c", "_d").distinct(), durable(owners), ["_c", "_d"])
        .groupBy("_key")
        .agg(F.array_sort(F.collect_set("_item")).alias("items"))
    )
    results = durable(per_key.join(listed, "_key", "left"))
    sizes = docs.select(by, "_key", F.size(words(F.col(text))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return sizes.join(results, "_key", "left").select(
        by,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _classes(owned: DataFrame) -> DataFrame:
    """Windows with their class: two hashes over the set of items that hold them."""
    first, second = F.xxhash64("_item"), F.xxhash64(F.lit("second"), "_item")
    return owned.groupBy("_size", "_h", "_g").agg(F.bit_xor(first).alias("_c"), F.bit_xor(second).alias("_d"))


def _owners(owned: DataFrame) -> DataFrame:
    """Items with an id per class, taken from one window of the class."""
    one = _classes(owned).groupBy("_c", "_d").agg(F.min(F.struct("_size", "_h", "_g")).alias("_w"))
    one = one.select("_c", "_d", "_w.*")
    return owned.where(F.col("_item").isNotNull()).join(one, ["_size", "_h", "_g"]).select("_c", "_d", "_item")


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As :func:`find_contaminated`, with a digest of the items."""
    found = find_contaminated(documents, benchmark)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
