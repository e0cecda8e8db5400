"""Problem 8: mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import TOKENIZER_FILE, encoder
from tessera.session import settle


def token_counts(df: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of each row, sizes in tokens of ``tokenizer``; texts go no further."""
    source = df.select(df[id_col].cast("bigint").alias("doc_id"), df[source_col].alias("source"), df[text_col].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            sizes = pa.array([words.count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], names=["doc_id", "source", "n_tokens"])

    return source.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, exact: bool = False) -> DataFrame:
    """Each source's budget: ``(source, target_share, share, max_repeats, pool_tokens, budget)``.

    ``share`` is the target share among the sources that can give anything at all (a target source without
    tokens, with a null or non-positive share, or no allowed repeat, cannot be met and has budget 0). The total is
    ``total_tokens``, or as many tokens as all of ``sizes`` have; a source that cannot fill its share of it gives
    ``max_repeats`` times its size and stays below its target. With ``exact`` the total is instead the largest at
    which every such source still reaches its share within its repeats, so the poorest source decides.
    """
    if total_tokens is None and not exact:
        total_tokens = sizes.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    pools = sizes.groupBy("source").agg(F.sum("n_tokens").alias("pool_tokens"))
    wanted = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
    wanted = wanted.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = wanted.join(pools, "source", "left").withColumn("pool_tokens", F.coalesce("pool_tokens", F.lit(0)).cast("bigint"))
    usable = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("pool_tokens") > 0)
    every = Window.partitionBy(F.lit(1))  # one row per target source: a table that does not grow
    joined = joined.withColumn("share", F.when(usable, F.col("target_share"))).withColumn("share", F.coalesce(F.col("share") / F.sum("share").over(every), F.lit(0.0)))
    reach = F.min(F.when(F.col("share") > 0, F.col("max_repeats") * F.col("pool_tokens") / F.col("share"))).over(every)
    total = F.coalesce(reach, F.lit(0.0)) if exact else F.lit(float(total_tokens))
    budget = F.least(F.floor(total * F.col("share") + 1e-6), F.col("max_repeats") * F.col("pool_tokens"))
    return joined.withColumn("budget", F.coalesce(budget, F.lit(0)).cast("bigint"))


def _running(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the running sum of tokens per source within one sorted partition; state: one number per source."""
    seen: dict[str, int] = {}
    for part in parts:
        part["local_end"] = part.groupby("source")["n_tokens"].cumsum() + part["source"].map(lambda s: seen.get(s, 0))
        seen.update(part.groupby("source")["local_end"].last().to_dict())
        yield part


def mix(documents: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        total_tokens: int | None = None, exact: bool = False, seed: int = 0, tokenizer: str = TOKENIZER_FILE) -> DataFrame:
    """The chosen records ``(source, epoch, doc_id, n_tokens, used_tokens, start_token)``.

    Each document has a hash-random key; documents are range-sorted by (source, key), so a source that holds a
    third of all rows is spread over many partitions. Distributed prefix sums place every document on its
    source's line of tokens; a source is cut exactly at its budget. A document that crosses the cut is used up
    to it (``used_tokens`` < ``n_tokens``); budgets beyond one pass repeat the line (``epoch`` 1, 2, …). The total is
    that of the documents unless ``total_tokens`` or ``exact`` says otherwise, see :func:`budgets`.
    Rows with null source, sources that are no target and texts without tokens give nothing; documents delivered
    twice (equal id) count once; an empty table on either side gives an empty result.
    """
    sizes = token_counts(documents, id_col, text_col, source_col, tokenizer).where("n_tokens > 0 and source is not null").dropDuplicates(["doc_id"])
    sizes = settle(sizes)
    plan = budgets(sizes, targets, total_tokens, exact).where("budget > 0").select("source", "budget", "pool_tokens")
    keyed = sizes.join(plan.select("source"), "source", "left_semi").withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    ranged = keyed.repartitionByRange("source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id")
    lines = ranged.select("doc_id", "source", "n_tokens").mapInPandas(_running, "doc_id bigint, source string, n_tokens bigint, local_end bigint")
    lines = settle(lines.withColumn("part", F.spark_partition_id()))
    per_part = lines.groupBy("source", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    so_far = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = per_part.select("source", "part", F.coalesce(F.sum("part_tokens").over(so_far), F.lit(0)).alias("part_start"))
    placed = lines.join(starts, ["source", "part"]).join(plan, "source").withColumn("end_token", F.col("part_start") + F.col("local_end"))
    placed = placed.withColumn("start", F.col("end_token") - F.col("n_tokens"))
    epochs = F.ceil((F.col("budget") - F.col("start")) / F.col("pool_tokens")).cast("int")
    placed = placed.where(F.col("start") < F.col("budget")).withColumn("epoch", F.explode(F.sequence(F.lit(1), epochs)))
    start = F.col("start") + (F.col("epoch") - 1) * F.col("pool_tokens")
    return placed.select("source", "epoch", "doc_id", "n_tokens", F.least("n_tokens", F.col("budget") - start).alias("used_tokens"), start.alias("start_token"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source really got: ``(source, target_share, actual_share, used_tokens, n_documents, most_repeats)``.

    A target source that gave nothing is listed with zeros.
    """
    got = mixed.groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"), F.countDistinct("doc_id").alias("n_documents"), F.max("epoch").alias("most_repeats"))
    whole = Window.partitionBy(F.lit(1))  # one row per target source
    out = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share")).join(got, "source", "left")
    out = out.withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)).cast("bigint"))
    total = F.sum("used_tokens").over(whole)
    share = F.when(total > 0, F.col("used_tokens") / total).otherwise(F.lit(0.0))
    return out.select("source", "target_share", share.alias("actual_share"), "used_tokens",
                      F.coalesce("n_documents", F.lit(0)).cast("bigint").alias("n_documents"), F.coalesce("most_repeats", F.lit(0)).cast("int").alias("most_repeats"))
