"""Streams of questions and of new notes against a saved index (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.config import RetrievalConfig
from quillmesh.operators.chunking import chunk_notes
from quillmesh.plans.hybrid import IndexTables, retrieve
from quillmesh.sources.store import append_chunks, load_index, save_index


def answer_stream(questions: DataFrame, index: IndexTables, out: str, checkpoint: str, cfg: RetrievalConfig = RetrievalConfig()) -> StreamingQuery:
    """questions: a stream (qid, text); hits go to ``out`` as Parquet, one folder a batch, so a batch that is run again replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            retrieve(index, batch.dropDuplicates(["qid"]), cfg).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    return questions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(notes: DataFrame, path: str, checkpoint: str, cfg: RetrievalConfig = RetrievalConfig()) -> StreamingQuery:
    """notes: a stream of notes, each chunked and appended to the index saved at ``path``; notes already in it are skipped."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = load_index(spark, path)
        new = batch.join(index.chunks.select(F.col("note_id").alias("id")).distinct(), "id", "left_anti").persist()
        if not new.isEmpty():
            save_index(append_chunks(index, chunk_notes(new), cfg), path)
        new.unpersist()

    return notes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def question_rates(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts by window and type of an event stream (ts, event_type, value), late rows up to ``late`` included."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
