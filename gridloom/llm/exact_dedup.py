"""Exact deduplication by a stateful stream.

Keys (digest of the normalised text, identifier, content locator) flow through Structured Streaming. The state is
a keyed aggregation without watermark, so it never expires, held on disk by RocksDB and checkpointed in the shared
folder: for each digest the smallest identifier with its locator (file and row of the text), and the number of rows.
Each micro-batch combines its rows before the shuffle, so a digest that a third of all rows share costs each task one
row. Full bytes are checked on hits: the texts of every row whose digest another row has, and of the row that the state
keeps, are fetched by their locators and compared; rows that differ are grouped by their bytes. Where rows meet the
state's row of a hot digest, that row is repeated and they are dealt out.

With a ``state`` folder the state outlives the run: later documents meet what earlier runs kept, whose texts are read
from the files that the locators name. Each call adds its rows to the state once.

Defined results: null text is empty text; null identifiers sort last; a repeated identifier counts as another row;
of rows with one identifier and text, the first by place stays; an empty table gives an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE, Workspace, hot_keys, located, spread_join, text_or_empty, unpacked

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # Stores close after each batch; else those of ended queries stay open in the executors.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    # Else each store reserves megabytes of disk for its log ahead of use.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: str = "text") -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def sha256_digest(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def _rank() -> Column:
    """The order in which rows of one text are kept."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")


def stream_state(keys: DataFrame, work: Workspace, folder: str) -> DataFrame:
    """Drain the streaming frame ``keys`` through the keyed state below ``folder``; return the state at its end:
    digest, keep_id, keep_at, group_size."""
    spark = work.spark
    sink = f"{folder}/updates"
    state = keys.groupBy("digest").agg(F.min(_rank()).alias("first"), F.count(F.lit(1)).alias("n"))

    def save(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again after a failure overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        query = (
            state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    updates = spark.read.schema(f"{_ddl(state)}, batch int").parquet(sink)
    last = F.max_by(F.struct("first", "n"), "batch")
    return updates.groupBy("digest").agg(last.alias("s")).select("digest", F.col("s.first.doc_id").alias("keep_id"), F.col("s.first.at").alias("keep_at"), F.col("s.n").alias("group_size"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def decide(rows: DataFrame, work: Workspace, digest: Callable[[Column], Column], batches: int, state: str | None) -> DataFrame:
    """rows of ``located`` to a written table: digest, doc_id, at, keep_id, keep_at, group_size."""
    spark = work.spark
    folder = state or work.sub("state")
    body = normalised("row.text")
    # Keys only: texts stay where they are and are found again by their locators.
    run = f"{folder}/keys/run={uuid.uuid4().hex}"
    own = rows.select(digest(body).alias("digest"), F.col("row.doc_id").cast("long").alias("doc_id"), "at")
    own.write.parquet(run)
    keys = spark.read.schema(own.schema).parquet(run)
    files = max(1, -(-len(keys.inputFiles()) // batches))
    stream = spark.readStream.schema(f"{_ddl(own)}, run string").option("maxFilesPerTrigger", files).parquet(f"{folder}/keys").drop("run")
    groups = work.keep(stream_state(stream, work, folder), "groups")
    total = keys.count()

    # A row's group: hot digests are dealt out by place.
    by_digest = hot_keys(groups, "digest", "group_size", total)
    matched = work.keep(spread_join(keys, groups, "digest", by_digest, F.col("at")), "matched")

    # Full bytes on hits. A row alone in its group is no hit, nor is one that the state keeps.
    hits = matched.where("group_size > 1").select("at", "digest", "keep_at")
    wanted = hits.select("at", "digest").unionByName(hits.select(F.col("keep_at").alias("at"), "digest")).distinct()
    texts = rows.select("at", body.alias("body"))
    if state:
        # Files of earlier runs: as many names as files.
        old = wanted.select("at.file").distinct().join(keys.select("at.file").distinct(), "file", "left_anti").collect()
        if old:
            texts = texts.unionByName(_read_places(spark, [r.file for r in old]))
    fetched = work.keep(wanted.join(texts, "at"), "content")
    kept = groups.where("group_size > 1").select("digest", F.col("keep_at").alias("at")).join(fetched, ["digest", "at"]).select("digest", F.col("body").alias("keep_body"), F.col("at").alias("first_at"))
    compared = spread_join(fetched, kept, "digest", by_digest, F.col("at")).where("at <> first_at AND body <> keep_body")
    others = work.keep(compared.select("at", "digest", "body"), "others")
    work.forget(fetched)
    if others.isEmpty():
        return matched
    # Different texts under one digest: rows that equal the kept row stay with it, the rest group by their bytes.
    others = others.join(matched.select("at", "doc_id"), "at")
    first = others.groupBy("digest", "body").agg(F.min(_rank()).alias("first"), F.count(F.lit(1)).alias("own_n"))
    moved = others.select("at", "digest", "body").join(first, ["digest", "body"]).select("at", F.col("first.doc_id").alias("own_id"), F.col("first.at").alias("own_at"), "own_n")
    fewer = others.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    alone = F.col("own_n").isNull()
    settled = matched.join(moved, "at", "left").join(fewer, "digest", "left").withColumns({
        "keep_id": F.when(alone, F.col("keep_id")).otherwise(F.col("own_id")),
        "keep_at": F.when(alone, F.col("keep_at")).otherwise(F.col("own_at")),
        "group_size": F.when(alone, F.col("group_size") - F.coalesce("gone", F.lit(0))).otherwise(F.col("own_n")),
    })
    return work.keep(settled.drop("own_id", "own_at", "own_n", "gone"), "settled")


def _read_places(spark, files: list[str]) -> DataFrame:
    """Texts of earlier documents by place; a table of packed rows keeps them below ``row``."""
    old = spark.read.parquet(*files)
    text = "row.text" if old.columns == ["row"] else "text"
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("n")).alias("at")
    return old.select(place, normalised(text).alias("body"))


def exact_dedup(docs: DataFrame, work: Workspace, digest: Callable[[Column], Column] = sha256_digest, batches: int = 2, state: str | None = None) -> DataFrame:
    """Decision on each row of ``docs`` (doc_id, text): doc_id, digest, keep_id, group_size, kept.

    ``digest`` may be weak: equality is settled on bytes. ``state`` is a folder that outlives the run.
    """
    decided = decide(located(docs, work), work, digest, batches, state)
    return decided.select("doc_id", "digest", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"))


def drop_copies(docs: DataFrame, work: Workspace, state: str | None = None) -> DataFrame:
    """``docs`` without the rows that repeat an earlier text; all columns stay as they are."""
    rows = located(docs, work)
    stay = decide(rows, work, sha256_digest, 2, state).where("at = keep_at").select("at")
    return unpacked(rows.join(stay, "at", "left_semi"))
