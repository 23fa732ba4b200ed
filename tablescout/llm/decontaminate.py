"""Benchmark items inside documents, by size-partitioned MinHash search and exact verification.

Items are partitioned by the size of their shingle set.  In a partition of sizes up to u, a document that holds
at least ``percent`` of an item misses at most ``u - ceil(percent * u)`` of its shingles, so it holds one of any
``missed + 1`` of them.  The sketch of an item is therefore its bottom-k MinHash signature, the k smallest
hashes under one hash function, with k = missed + 1 of its partition: a document that meets none of the sketch
hashes cannot contain the item, however long it is, and no similarity to the whole document is needed.  The
documents' shingle hashes are looked up in the sketches; documents with fewer shingles than the partition's
smallest items need are left out of the search.  Candidates are verified by the exact share of the item's shingles, as text.

Everything is expressions of the JVM.  Documents are not shuffled by the search; Spark broadcasts the sketches
while they are below its own size limit and joins by a shuffle of hashes beyond it.

An item with fewer words than a shingle is one shingle of all its words.  Documents are searched for it by their runs of
as many words, in a pass per such length that occurs among the items.

Edge cases: texts are lower-cased (A-Z) and cut into words at white space; null and empty documents contain nothing and
null or empty items are in nothing; rows without an id are left out.  Rows that repeat an id are searched, or searched
for, each with its own text; of several finds for a pair of ids the highest containment is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.llm.words import only
from tablescout.session import durable

#: Upper ends of the size partitions grow by this factor.
GROWTH = 1.5


def _words(text: str) -> Column:
    """Words of a text; the empty strings at the ends of ``split`` fall away with the trimmed white space."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.regexp_replace(lower, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")


def _worded(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and the words ``w`` of every row whose text has some."""
    return df.where(F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(key, _words(text).alias("w"))


def with_shingles(df: DataFrame, key: str, text: str, n: int, hashed: bool) -> DataFrame:
    """``key`` and the array ``shingles`` (hashes, or strings) of every row whose text has words."""
    one = (lambda parts: F.xxhash64(*parts)) if hashed else (lambda parts: F.concat_ws(" ", *parts))
    words = _worded(df, key, text)
    # Words beyond the end are null, which both functions pass over; slice() would copy the whole array each time.
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: one([F.get("w", i + j) for j in range(n)]))
    return words.select(key, runs.alias("shingles"))


def needed(size: Column, percent: int) -> Column:
    """Shared shingles that make a containment of ``percent``: the ceiling of the share."""
    return F.floor((size * percent + 99) / 100).cast("long")


def sketches(items: DataFrame, n: int, percent: int) -> DataFrame:
    """``item, least, h``: the bottom-k hashes of every item with k and the least shingle count of its partition."""
    sets = with_shingles(items, "item", "text", n, True).select("item", F.sort_array(F.array_distinct("shingles")).alias("s"))
    size = F.size("s")
    part = F.floor(F.log(size.cast("double")) / F.log(F.lit(GROWTH)))
    parted = sets.select("item", "s", part.alias("part"), size.cast("long").alias("m"))
    bounds = parted.groupBy("part").agg(F.max("m").alias("u"), F.min("m").alias("l"))
    # Within a partition size - needed(size) does not fall with size, so the largest size decides k.
    k = F.col("u") - needed(F.col("u"), percent) + 1
    return (parted.join(bounds, "part")
            .select("item", needed(F.col("l"), percent).alias("least"), F.explode_outer(F.slice("s", F.lit(1), k.cast("int"))).alias("h")))


def short_finds(docs: DataFrame, items: DataFrame) -> list[DataFrame]:
    """``doc, item`` of documents that hold all words of an item in a row, per length of items; ``items`` has the words ``w``."""
    # At most as many lengths as a shingle has words.
    lengths = sorted(r.m for r in items.select(F.size("w").alias("m")).distinct().collect())
    found = []
    for m in lengths:
        wanted = items.where(F.size("w") == m).select("item", F.xxhash64(*[F.get("w", F.lit(j)) for j in range(m)]).alias("h"), F.concat_ws(" ", "w").alias("phrase"))
        runs = F.transform(F.sequence(F.lit(0), F.size("w") - m), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(m)]))
        probes = _worded(docs, "doc").where(F.size("w") >= m).select("doc", F.explode_outer(F.array_distinct(runs)).alias("h"))
        pairs = probes.join(wanted, "h").select("doc", "item", "phrase").distinct()
        held = _worded(docs, "doc").select("doc", F.concat(F.lit(" "), F.concat_ws(" ", "w"), F.lit(" ")).alias("line"))
        found.append(held.join(pairs, "doc").where(F.contains("line", F.concat(F.lit(" "), "phrase", F.lit(" ")))).select("doc", "item"))
    return found


def contained(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, shared, item_shingles, containment`` of every document that holds an item."""
    row = lambda key: F.struct(key, F.xxhash64("text").alias("row"))
    docs = only(docs, "doc_id", "text").select(row("doc_id").alias("doc"), "text")
    items = only(items, "item_id", "text").select(row("item_id").alias("item"), "text").dropDuplicates(["item"])
    short = durable(_worded(items, "item").where(F.size("w") < n))
    items = items.join(short.select("item"), "item", "left_anti")
    index = durable(sketches(items, n, percent))
    found = with_shingles(docs, "doc", "text", n, True)
    # The arrays are never empty.  explode() would add a filter on them that is pushed below and computes them once more.
    probes = found.select("doc", F.size("shingles").alias("many"), F.explode_outer("shingles").alias("h"))
    candidates = durable(probes.join(index, "h").where("many >= least").select("doc", "item").distinct())
    whole = with_shingles(items, "item", "text", n, False).select("item", F.array_distinct("shingles").alias("wanted"))
    # Each candidate document comes once, with all its candidate items.
    wanted = candidates.join(whole, "item").groupBy("doc").agg(F.collect_list(F.struct("item", "wanted")).alias("items"))
    held = docs.join(wanted, "doc")
    texts = held.select(F.struct("doc", "items").alias("of"), "text")
    pairs = with_shingles(texts, "of", "text", n, False).select("of.doc", F.explode_outer("of.items").alias("i"), "shingles")
    shared = F.size(F.array_intersect("i.wanted", "shingles"))
    size = F.size("i.wanted")
    hits = pairs.select("doc", F.col("i.item").alias("item"), shared.cast("long").alias("shared"), size.cast("long").alias("item_shingles"))
    one = F.lit(1).cast("long")
    for frame in short_finds(docs, short):
        hits = hits.unionByName(frame.select("doc", "item", one.alias("shared"), one.alias("item_shingles")))
    best = F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("containment"), "shared", "item_shingles")).alias("best")
    return (hits.where(F.col("shared") * 100 >= F.col("item_shingles") * percent).groupBy("doc.doc_id", "item.item_id").agg(best)
            .select("doc_id", "item_id", "best.shared", "best.item_shingles", "best.containment"))
