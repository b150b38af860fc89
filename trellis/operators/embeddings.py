"""Embeddings by a function of the user's: batches of texts in, arrays of floats out. Also the queue of what is pending."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list[list[float]]]


def hashed(dim: int = 64) -> Encoder:
    """An encoder that needs no model: signed hashes of lower-cased words, of length one."""
    import hashlib
    import math

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return encode


def embed(rows: DataFrame, encode: Encoder, key: str = "id", text: str = "text", batch: int = 256) -> DataFrame:
    """key, embedding; a null text counts as empty. Runs on executors, batch by batch."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                yield pd.DataFrame({key: part[key], "embedding": encode([x or "" for x in part["text"]])})

    return rows.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


@dataclass(frozen=True)
class Selector:
    """Which nodes(node_id, labels, props) to embed."""

    labels: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()  # patterns with * and ? over ids
    missing_only: bool = True

    def of(self, nodes: DataFrame, have: DataFrame | None = None) -> DataFrame:
        if self.labels:
            nodes = nodes.where(F.arrays_overlap("labels", F.array(*map(F.lit, self.labels))))
        if self.ids:
            nodes = nodes.where(F.col("node_id").isin(*self.ids))
        for pattern in self.exclude:
            nodes = nodes.where(~F.col("node_id").rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")))
        if self.missing_only and have is not None:
            nodes = nodes.join(have.select(F.col("id").alias("node_id")), "node_id", "left_anti")
        return nodes


def embed_nodes(nodes: DataFrame, encode: Encoder, selector: Selector = Selector(), have: DataFrame | None = None, fields: tuple[str, ...] = ("name", "title", "description")) -> DataFrame:
    """id, embedding of the selected nodes' labels and texts."""
    said = F.concat_ws(" ", F.array_join("labels", " "), *(F.col("props")[f] for f in fields))
    return embed(selector.of(nodes, have).select(F.col("node_id").alias("id"), said.alias("text")), encode)


def embed_edges(edges: DataFrame, encode: Encoder, predicates: tuple[str, ...] = ()) -> DataFrame:
    """s, p, o_id, embedding of edges, whose text is the three of them."""
    e = edges.where(F.col("p").isin(*predicates)) if predicates else edges
    e = e.select("s", "p", "o_id").distinct().withColumn("text", F.concat_ws(" ", "s", "p", "o_id"))
    made = embed(e.select(F.to_json(F.struct("s", "p", "o_id")).alias("id"), "text"), encode)
    return made.select(F.from_json("id", "s string, p string, o_id string").alias("k"), "embedding").select("k.*", "embedding")


def store(have: DataFrame, new: DataFrame) -> DataFrame:
    """Embeddings(id, embedding) with those of new ids replaced or added."""
    return have.join(new.select("id"), "id", "left_anti").unionByName(new)


def attach(table: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    return table.join(embeddings.withColumnRenamed("id", key), key, "left")


@dataclass(frozen=True)
class Queue:
    """rows(kind, id, text, status, vector): entries of nodes overwrite each other, entries of texts are always new."""

    rows: DataFrame

    @staticmethod
    def empty(spark) -> Queue:
        return Queue(spark.createDataFrame([], "kind string, id string, text string, status string, embedding array<float>"))

    def enqueue(self, kind: str, items: DataFrame) -> Queue:
        new = items.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "text", F.lit("PENDING").alias("status"), F.lit(None).cast("array<float>").alias("embedding"))
        old = self.rows if kind == "text" else self.rows.join(new.select("kind", "id"), ["kind", "id"], "left_anti")
        return Queue(old.unionByName(new if kind == "text" else new.dropDuplicates(["kind", "id"])))

    def process(self, encode: Encoder) -> Queue:
        """All that is pending becomes DONE, or ERROR where the encoder raises for an entry by itself."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                made, status = [], []
                for t in f["text"]:
                    try:
                        made.append(encode([t or ""])[0])
                        status.append("DONE")
                    except Exception:  # noqa: BLE001  what the user's function raises is an entry's state
                        made.append(None)
                        status.append("ERROR")
                yield f.assign(status=status, embedding=made)

        todo = self.rows.where("status = 'PENDING'")
        return replace(self, rows=self.rows.where("status <> 'PENDING'").unionByName(todo.mapInPandas(run, todo.schema)))

    def pending(self) -> DataFrame:
        return self.rows.where("status = 'PENDING'")

    def clear_done(self) -> Queue:
        return replace(self, rows=self.rows.where("status <> 'DONE'"))
