"""Benchmark decontamination by size-partitioned containment MinHash, in built-in functions only.

A test item is contained in a document if at least `threshold` of its distinct five-word shingles occur there. Items
are put into size classes (powers of two of their shingle counts). An item's sketch is its k smallest shingle hashes,
k = n - ceil(threshold * n) + 1 for n the largest size in its class: a document that holds the threshold share of the
item lacks fewer than k of its shingles, so at least one of the k minima occurs in it. Candidates are the documents
with a sketched hash and enough shingles for the class; each is verified on the shingles themselves.

A table of bits, one for the low bits of each hash that is looked for, goes to all tasks. Only a document's hashes whose bit is set leave its
row, to be joined; likewise only such shingles of a candidate are made into strings. A bit that is set by chance costs a row of the join, no more.

The sketch is of the short side only and is looked up in the whole document: the Jaccard similarity of a 30-word item
and a 20,000-word document is about 0.001, which signatures of whole documents would not find.

Defined results: words are what SEPARATORS (spaces, controls, punctuation) leave, lower-cased; a text of fewer than five words has its
whole word sequence as its one shingle, so such an item is found only in documents of just these words; a text without
words, empty or null has no shingle and is never matched; rows that repeat a doc_id are tested each by itself and the
best containment counts; items that repeat are reported each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcastable, durable

WORDS = 5
THRESHOLD = 0.8
#: ASCII and Latin-1 but for letters and digits, one by one, as the matcher looks single ones up in a table; general and CJK punctuation.
SEPARATORS = "[" + "".join(f"\\x{i:02X}" for i in range(0xC0) if not chr(i).isascii() or not chr(i).isalnum()) + r"\x{2000}-\x{206F}\x{3000}-\x{303F}]"
#: What an entry of a broadcast table takes besides its text.
ENTRY_BYTES = 64
#: Bits for each hash that is looked for, and the most there are of them (2 MB); beyond, more of them are set by chance.
BITS_EACH = 16
MOST_BITS = 1 << 24


def words_of(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), f"{SEPARATORS}+"), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def once(value: Column, name: str) -> Column:
    """value through a generator of one row, so that it is not computed anew wherever it is used."""
    return F.explode(F.array(value)).alias(name)


def shingles_of(words: Column, n: int = WORDS) -> Column:
    """Every run of n words, joined by spaces, in order; the whole sequence where there are fewer."""
    last = F.greatest(F.size(words) - (n - 1), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat_ws(" ", F.slice(words, i, n)))
    return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<string>"))


def hashes_of(words: Column, n: int = WORDS) -> Column:
    """The hash of every run of n words, in order, chained from word to word; absent words leave it as it is."""
    last = F.greatest(F.size(words) - (n - 1), F.lit(1))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(*[F.get(words, i + j if j else i) for j in range(n)])))


def needed(n: Column | str, threshold: float) -> Column:
    """The fewest shingles of n that reach the threshold; a hair below the product, so that 0.8 x 5 asks for 4."""
    return F.ceil((F.col(n) if isinstance(n, str) else n) * F.lit(threshold) - F.lit(1e-9)).cast("int")


def marked(hashes: DataFrame, bits: int) -> Callable[[Column], Column]:
    """Whether a hash may be among those in the column `hash`: the bit of its low bits, of so many, a power of two, is set."""
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    one = hashes.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(hash & 63 AS int))").alias("bit"))
    found = {r.at: r.bit for r in one.groupBy("at").agg(F.bit_or("bit").alias("bit")).collect()}
    table = F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")
    return lambda h: F.getbit(F.get(table, F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """item_id, size class, hash: the k smallest hashes of each item, k by size class."""
    sized = items.withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
    most = sized.groupBy("size_class").agg(F.max("n_item").alias("class_max"), F.min("n_item").alias("class_min"))
    k = F.col("class_max") - needed("class_max", threshold) + 1
    low = F.slice(F.array_sort(F.array_distinct("item_hashes")), F.lit(1), k)
    return sized.join(F.broadcast(most), "size_class").select("item_id", "size_class", needed("class_min", threshold).alias("class_need"), F.explode(low).alias("hash"))


def _verified(docs: DataFrame, benchmark: DataFrame, threshold: float, n: int) -> DataFrame:
    """doc_id, text_key, item_id, n_item, n_common of every pair at or above the threshold; text_key tells rows of one id apart."""
    worded_items = benchmark.select("item_id", once(words_of(F.col("text")), "words"))
    items = worded_items.select("item_id", hashes_of(F.col("words"), n).alias("item_hashes"), once(F.array_distinct(shingles_of(F.col("words"), n)), "item_shingles"))
    items = durable(items.withColumn("n_item", F.size("item_shingles")).where("n_item > 0").distinct())
    item_bytes = F.octet_length(F.concat_ws("", "item_shingles")) + ENTRY_BYTES * F.col("n_item")
    held = items.agg(F.sum(item_bytes).alias("bytes"), F.sum("n_item").alias("n")).first()
    small = (held.bytes or 0) <= BROADCAST_BYTES  # a sketch is no larger than its item
    bits = min(MOST_BITS, max(64, 1 << (BITS_EACH * (held.n or 1) - 1).bit_length()))
    near = F.broadcast if small else (lambda df: df)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    worded = keyed.select("doc_id", "text_key", once(words_of(F.col("text")), "words"))
    low = sketches(items, threshold)
    hits = F.filter(hashes_of(F.col("words"), n), marked(low, bits))
    hashed = worded.select("doc_id", "text_key", F.size("words").alias("n_words"), F.explode(hits).alias("hash"))
    enough = F.greatest(F.col("n_words") - (n - 1), F.lit(1)) >= F.col("class_need")
    found = hashed.join(near(low), "hash").where(enough).select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct()
    found = broadcastable(durable(found), ENTRY_BYTES)
    texts = keyed.join(found, keyed["doc_id"].eqNullSafe(found["found_id"]) & (keyed["text_key"] == found["found_key"]), "left_semi")
    # a candidate's shingles meet the items' one by one: counts of equal ones, of each row of one id and text once
    texts = texts.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", once(words_of(F.col("text")), "words"))
    texts = texts.select("doc_id", "text_key", "words", once(hashes_of(F.col("words"), n), "hashes"))
    known = marked(items.select(F.explode("item_hashes").alias("hash")), bits)
    at = F.filter(F.sequence(F.lit(1), F.size("hashes")), lambda i: known(F.get("hashes", i - 1)))
    runs = F.when(F.size("hashes") > 0, F.transform(at, lambda i: F.concat_ws(" ", F.slice("words", i, n))))
    shingles = texts.select("doc_id", "text_key", F.explode(F.array_distinct(runs)).alias("shingle"))
    own = items.dropDuplicates(["item_id", "item_shingles"]).select("item_id", "n_item", F.xxhash64("item_shingles").alias("item_key"), F.explode("item_shingles").alias("shingle"))
    pairs = shingles.join(near(own), "shingle").groupBy("doc_id", "text_key", "item_id", "item_key", "n_item").agg(F.count(F.lit(1)).cast("int").alias("n_common"))
    return pairs.where(F.col("n_common") >= needed("n_item", threshold)).select("doc_id", "text_key", "item_id", "n_item", "n_common")


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment of every pair at or above the threshold."""
    best = _verified(docs, benchmark, threshold, n).groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_common").alias("n_common"))
    return best.withColumn("containment", F.col("n_common") / F.col("n_item"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """docs without the rows whose own text contains a test item."""
    hit = broadcastable(durable(_verified(docs, benchmark, threshold, n).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct()), ENTRY_BYTES)
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(docs["text"]) == hit["hit_key"]), "left_anti")
