"""Benchmark decontamination (operator 1): size-partitioned MinHash containment search, in DataFrame functions only.

A test item that shares a part ``t`` of its n shingles with a document misses at most n - ceil(t n) of them there. So of its
n - ceil(t n) + 1 smallest shingle hashes, its bottom-k MinHash signature, at least one is in the document: the search misses no pair.
Items are partitioned by size, and each partition has the signature length that its largest size needs.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.llm.shared import stored

SHINGLE, THRESHOLD = 5, 0.8
#: Item shingles of a block. Signatures and shingles of one block are broadcast (below 100 MB); more items are searched block after block.
BLOCK_SHINGLES = 1_000_000


def words(text: str | Column) -> Column:
    """Lower-case runs of letters and digits; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def starts(w: str, size: int) -> Column:
    """First places (from 0) of the shingles of a non-empty word array; fewer words than ``size`` make one shingle."""
    return F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))


def shingles(w: str, size: int) -> Column:
    return F.transform(starts(w, size), lambda i: F.array_join(F.slice(F.col(w), i + 1, size), " "))


def shingle_hashes(w: str, size: int) -> Column:
    """Hashes of the shingles without building their texts; words beyond the end hash as nulls."""
    return F.transform(starts(w, size), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(size)]))


def signature_length(n: Column, threshold: float) -> Column:
    """Hashes that the size partition of ``n`` shingles keeps. A partition spans sizes from 2^p to 2^(p+1) - 1."""
    largest = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1
    return (largest - F.ceil(largest * threshold - 1e-9) + 1).cast("int")


def prepared_items(items: DataFrame, item_id: str, text: str, size: int, threshold: float) -> DataFrame:
    """``item, grams, n, size, signature`` of every item with a word; items of the same text and id once. An item of fewer than ``size`` words is one
    shingle of its own size."""
    w = items.select(F.col(item_id).alias("item"), words(text).alias("w")).where(F.size("w") > 0).distinct()
    own = w.select("item", F.size("w").alias("n_words"), F.array_distinct(shingles("w", size)).alias("grams"), F.array_sort(F.array_distinct(shingle_hashes("w", size))).alias("h"))
    n = F.size("grams")
    return own.select("item", "grams", n.alias("n"), F.least("n_words", F.lit(size)).alias("size"), F.slice("h", F.lit(1), signature_length(n, threshold)).alias("signature"))


def text_pairs(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               size: int = SHINGLE, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc, digest, item, shared, n`` of all pairs where a text of the document, told by its hash, holds at least ``threshold`` of the
    item's different shingles."""
    spark = docs.sparkSession
    ready = stored(prepared_items(items, item_id, item_text, size, threshold), "benchmark-items")
    kind = ready.schema["item"].dataType.simpleString()
    total = ready.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number
    blocks = max(1, -(-total // block_shingles))
    w = (docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).where(F.length("t") > 0)
         .select("doc", F.xxhash64("t").alias("digest"), words("t").alias("w")).where(F.size("w") > 0))
    # the sizes of short items, at most size - 1 numbers: their shingles are looked for inside longer texts too
    short = [r["size"] for r in ready.where(F.col("size") < size).select("size").distinct().collect()]
    every = w.select("doc", "digest", "w", F.explode(F.concat(shingle_hashes("w", size), *[shingle_hashes("w", k) for k in short])).alias("h"))
    found = []
    for b in range(blocks):
        block = ready.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        keys = block.select(F.explode("signature").alias("h"), "item").groupBy("h").agg(F.collect_set("item").alias("own"), F.count(F.when(F.col("item").isNull(), 1)).alias("blank"))
        hits = every.join(F.broadcast(keys), "h")
        per_doc = hits.groupBy("doc", "digest").agg(F.first("w").alias("w"), F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"), F.sum("blank").alias("blank"))
        grams = per_doc.select("doc", "digest", F.array_distinct(F.concat(shingles("w", size), *[shingles("w", k) for k in short])).alias("here"),
                               F.explode(F.concat("own", F.when(F.col("blank") > 0, F.array(F.lit(None).cast(kind))).otherwise(F.array().cast(f"array<{kind}>")))).alias("i"))
        pairs = grams.join(F.broadcast(block.select("item", "grams", "n")), F.col("i").eqNullSafe(F.col("item")))
        found.append(pairs.select("doc", "digest", "item", F.size(F.array_intersect("grams", "here")).alias("shared"), "n").where(F.col("shared") >= F.col("n") * threshold - 1e-9))
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  size: int = SHINGLE, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of all pairs where the document holds at least ``threshold`` of the
    item's different shingles of ``size`` words, whole texts, exact.

    Signatures find candidates in the pass over the documents, without a shuffle of theirs; only candidates' words are moved, once
    per document, to count shared shingles. Null and empty texts match nothing. Texts of fewer than ``size`` words are one shingle of
    them all. Rows of the same id and different texts are searched each and the larger share counts; repeated rows count
    once; null ids are ids like others. An empty table on either side gives no pair; further columns are left out."""
    found = text_pairs(docs, items, doc_id, text, item_id, item_text, size, threshold, block_shingles)
    share = F.struct((F.col("shared") / F.col("n")).alias("containment"), F.col("shared"), F.col("n"))
    best = found.groupBy("doc", "item").agg(F.max(share).alias("best"))
    return best.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("best.shared").cast("long").alias("n_shared"),
                       F.col("best.n").cast("long").alias("n_item"), F.col("best.containment").alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; all columns whatever their names, repeated rows and null texts stay, as do other texts of the
    same id, be it null or not."""
    dirty = text_pairs(docs, items, doc_id, text, **options).select("doc", "digest").distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("own"), F.xxhash64(text).alias("text_hash"))
    return row.join(dirty, row["own"].eqNullSafe(dirty["doc"]) & (row["text_hash"] == dirty["digest"]), "left_anti").select("row.*")
