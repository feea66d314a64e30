"""Token counts of whole texts (operator 3): two tiers on the map side, no shuffle of pieces."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm import tokens
from dossierflow.llm.shared import filled

#: Rows of the broadcast table, and pieces that a task reports for it. A piece there has at most ``tokens.LONG`` characters, so the
#: table stays below 16 MB whatever the corpus.
FREQUENT, PER_TASK = 65_536, 4_096


def frequent_pieces(docs: DataFrame, text: str = "text", rows: int = FREQUENT, per_task: int = PER_TASK) -> DataFrame:
    """The most frequent blank-led words of all texts: ``piece, n``.

    Each task counts with a bounded counter that drops its rarest entries when it is full, and reports at most ``per_task``
    rows; only those meet in the shuffle. ``n`` is therefore a lower bound, good for a choice of table rows and nothing else."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(value.replace("\n", " \n").split(" "))
                if len(seen) > 64 * per_task:
                    seen = Counter(dict(seen.most_common(16 * per_task)))
        top = [(p, n) for p, n in seen.most_common(per_task) if n > 1 and 0 < len(p) < tokens.LONG]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    found = docs.select(filled(text).alias("t")).mapInArrow(count, "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(rows)


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library, which every machine holds. Counts are those of
    the library without added tokens, truncation or padding; strings of special tokens inside a text count as the library's
    default has it. The lengths of the frequent pieces are worked out once and broadcast; a piece that is not among them is
    encoded and kept in the worker. Neither tier changes a count.

    A null text counts as an empty one (0 bytes, 0 tokens), a null id stays null, repeated rows give repeated results, an empty table
    gives none, and further columns are left out."""
    spark = docs.sparkSession
    words = [r["piece"] for r in frequent_pieces(docs, text).collect()]  # at most FREQUENT short rows
    known = [w if w[0] == "\n" else " " + w for w in words]
    lengths = bytes(min(255, len(e.ids)) for e in tokens.load(tokenizer).encode_batch_fast(known, add_special_tokens=False))
    compact = spark.sparkContext.broadcast((" ".join(words), lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, sizes = compact.value
        start = {w: n for w, n in zip(joined.split(" "), sizes) if w and n < 255}
        table = tokens.PieceTable(tokenizer, lambda ids: len(ids) // 4, start)
        for batch in batches:
            n = [sum(v) for v in table.of(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(filled(text)).cast("long").alias("n_bytes"), filled(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
