"""Token counts with the whole-token shortcut.

Before any text is read, the driver proves which vocabulary strings come out as one token when encoded alone
(`tokens.whole_words`). Pre-tokens of texts that are among them count one each; the rest are merged by the library.
Words with unusual characters or special strings are counted by the library as they are, so every count is its own.

Null is the empty text with no bytes and no tokens. Rows are counted one by one: ids may be null or repeated, and extra
columns are ignored. What is broadcast is the tokenizer and its proved strings, of the size of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm import tokens


def token_counts(documents: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row."""
    spec = tokens.read(path)
    shared = documents.sparkSession.sparkContext.broadcast((spec, tokens.whole_words(spec)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, whole = shared.value
        counter = tokens.held(tokens.WordCounter, spec, whole)
        for batch in batches:
            counts = pa.array([counter.count(t.as_py() or "") for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["doc_id", "n_bytes", "n_tokens"])

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kind = documents.schema[doc_id].dataType.simpleString()
    out = documents.select(F.col(doc_id).alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), t.alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
