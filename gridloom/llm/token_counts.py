"""Token counts by a digest cache.

Counts are stored by (digest of the content, digest of the tokenizer file and the way it is called). A run joins the
digests of its texts to the stored counts, encodes one text for each digest that has none, and appends those counts.

Content is normalised without changing what the tokenizer sees: null becomes the empty text, nothing else, since any
other change could change the count. Encoding has no special tokens added, truncation or padding; special strings
inside a text are handled as the library does by default. Texts are found again by their place (file and row), so
null and repeated identifiers cost no more than others; rows of a digest that many rows share are dealt out.

Defined results: repeated texts and rows are encoded once; rows that repeat an identifier stay rows; an empty table
gives no rows and leaves the cache as it is; other columns are not read; a cache with repeated keys (two runs at the
same time) counts each key once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, hot_keys, located, spread_join, text_or_empty, tokenizer_file

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: Bytes of text that the tokenizer gets at once, and so bounds what its encodings hold.
BATCH_BYTES = 1 << 20

_loaded: dict[str, object] = {}


def version_of(file: str) -> str:
    """Digest of the tokenizer file and of the call."""
    return hashlib.sha256(Path(file).read_bytes() + b"\0no special tokens, no truncation, no padding").hexdigest()


def counter(name: str, folder: str | None = None):
    """A function from texts to token counts, loaded once in each process."""
    key = f"{folder}/{name}"
    if key not in _loaded:
        file = tokenizer_file(name, folder)
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=file)
            _loaded[key] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(file)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[key] = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[key]


def batches(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``most`` characters; a longer text is alone."""
    group: list[str] = []
    held = 0
    for text in texts:
        if group and held + len(text) > most:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def encode_misses(rows: DataFrame, name: str, version: str, folder: str | None = None) -> DataFrame:
    """rows (digest, content) to cache rows."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(name, folder)
        for frame in frames:
            counts = [n for group in batches(frame["content"].tolist()) for n in count(group)]
            yield pd.DataFrame({"digest": frame["digest"], "version": version, "n_tokens": pd.Series(counts, dtype="int64")})

    return rows.mapInPandas(each, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, work: Workspace, name: str = "byte_bpe_50k.json", folder: str | None = None, cache: str | None = None) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_bytes, n_tokens. ``cache`` is a folder of Parquet files that outlives the run."""
    spark = work.spark
    version = version_of(tokenizer_file(name, folder))
    cache = cache or work.sub("cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    content = text_or_empty("row.text")
    digest = F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest")
    rows = located(docs, work)
    sized = work.keep(rows.select(F.col("row.doc_id").alias("doc_id"), digest, F.octet_length(content).cast("long").alias("n_bytes"), "at"), "digests")
    # One place for each digest that has no count; its text is then fetched from there.
    groups = work.keep(sized.groupBy("digest").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")), "groups")
    fresh = groups.select("digest", "at").join(stored(), "digest", "left_anti")
    texts = rows.select("at", content.alias("content")).join(fresh, "at").select("digest", "content")
    encode_misses(texts, name, version, folder).write.mode("append").parquet(cache)
    hot = hot_keys(groups, "digest", "n", sized.count())
    return spread_join(sized, stored(), "digest", hot, F.col("at")).select("doc_id", "n_bytes", "n_tokens")
