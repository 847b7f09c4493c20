"""Keyed state: documents, conversations and their memory as latest-wins tables over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..sources.scratch import saved
from .search import small


def ingest_new(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming documents (doc_id, file_hash, ...) whose content isn't known yet; of equal ones the smallest id."""
    fresh = incoming.join(known.select("file_hash").distinct(), "file_hash", "left_anti")
    first = fresh.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
    return fresh.join(first, ["file_hash", "doc_id"], "left_semi").dropDuplicates(["file_hash"])


def replace_documents(stored: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored rows, with all rows of an incoming document in place of its old ones."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the keys that go."""
    return {name: table.join(gone.select(key).distinct(), key, "left_anti") for name, table in tables.items()}


def upsert_memory(log: DataFrame) -> DataFrame:
    """Memory items from a log (conv_id, memory_type, key, value, confidence, source_message_id, seq): the last value, the
    highest confidence (0 to 1), the last message named, and when the item was first and last written."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    named = F.when(F.col("source_message_id").isNotNull(), F.col("seq"))
    return log.groupBy("conv_id", "memory_type", "key").agg(F.max_by("value", "seq").alias("value"), F.max(sure).alias("confidence"), F.max_by("source_message_id", named).alias("source_message_id"), F.min("seq").alias("created_seq"), F.max("seq").alias("updated_seq"))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows with `total`, how many share their `by`, and `chunk_no`, their place among these from 0, by `order` (distinct within
    a `by`). Ranges of (by, order) are numbered each by itself and shifted by what precedes them, so a hot `by` isn't one task."""
    held = saved(rows.repartitionByRange(F.col(by), F.col(order)).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = held.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy("_by")
    sizes = sizes.withColumn("total", F.sum("_n").over(group)).withColumn("_before", F.sum("_n").over(group.orderBy("_p")) - F.col("_n"))
    placed = held.join(small(sizes), (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_by")))
    own = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order))
    return placed.withColumn("chunk_no", own + F.col("_before") - 1).drop("_part", "_p", "_by", "_n", "_before")


def upsert_documents(log: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Each document's last values, when it was first written (created) and last (updated). Of rows of one key and order the
    largest values count."""
    last = F.max(F.struct(order, *values)).alias("last")
    rows = log.groupBy(key).agg(F.min(order).alias("created"), last)
    return rows.select(key, *[F.col(f"last.`{v}`").alias(v) for v in values], "created", F.col(f"last.`{order}`").alias("updated"))


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, title, n_messages): a conversation opened by its first user message (conv_id, turn, role, text), whose first 40
    characters are its title; conversations without such a message, or with an empty one, have the fixed title."""
    asked = F.col("role") == "user"
    first = F.min_by("text", F.when(asked, F.col("turn")))
    title = F.substring(T.strip(T.whole(F.col("first"))), 1, fixed.TITLE_LENGTH)
    rows = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.when(F.bool_or(asked), first).alias("first"))
    return rows.select("conv_id", F.when(F.length(title) > 0, title).otherwise(F.lit(fixed.UNTITLED)).alias("title"), "n_messages")


def touch(items: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """Items with access_count raised by how often they were used."""
    n = uses.groupBy(key).agg(F.count("*").alias("_uses"))
    return items.join(n, key, "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_uses", F.lit(0))).drop("_uses")


def latest(messages: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key; callers order them upwards again."""
    return messages.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def memory_order(memory_type: Column) -> Column:
    """Profile, preference, goal and task state come before others."""
    return F.when(memory_type == "profile", 0).when(memory_type == "preference", 1).when(memory_type == "goal", 2).when(memory_type == "task_state", 3).otherwise(4)


def memory_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(T.whole(text)), F.lit(f"[a-z0-9]{{2,}}|[{T.CJK}]"), 0)
    cjk = F.filter(found, lambda t: t.rlike(f"^[{T.CJK}]"))
    pairs = F.when(F.size(cjk) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.size(cjk) - 1, F.lit(1))), lambda i: F.concat(F.get(cjk, i - 1), F.get(cjk, i)))).otherwise(T.empty())
    return F.slice(F.concat(found, pairs), 1, 400)


def relevant_memory(items: DataFrame, questions: DataFrame, most: int = 4) -> DataFrame:
    """(qid, conv_id, key, overlap): a question's items of its conversation that share most tokens; profile, preference and
    goal items go into every context and aren't searched."""
    rows = items.where(~F.col("memory_type").isin("profile", "preference", "goal")).join(questions, "conv_id")
    shared = F.size(F.array_intersect(F.array_distinct(memory_tokens(F.col("question"))), F.array_distinct(memory_tokens(F.concat_ws(" ", "key", "value")))))
    rows = rows.withColumn("overlap", shared).where("overlap > 0")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("overlap"), "created_seq"))).where(F.col("n") <= most).drop("n")


def summary_points(messages: DataFrame, least: int = 40, every: int = 30) -> DataFrame:
    """(conv_id, at): the message counts at which a conversation's summary is refreshed: at `least` messages, then every `every`."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.select("conv_id", F.explode(F.expr(f"sequence({least}, CAST(n AS INT), {every})")).alias("at"))


def summaries(messages: DataFrame, window: int = 80, topics: int = 8, shown: int = 5) -> DataFrame:
    """(conv_id, summary): of each conversation's last 80 messages, the first five of its last eight user turns, shortened."""
    recent = latest(messages, "conv_id", "turn", window).where("role = 'user'")
    turns = F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("turn", "text")))), 1, topics), lambda s: s["text"])
    lists = recent.groupBy("conv_id").agg(F.reverse(turns).alias("turns"))
    short = lambda s, n: F.when(F.length(T.squeeze(s)) <= n, T.squeeze(s)).otherwise(F.concat(F.rtrim(F.substring(T.squeeze(s), 1, n - 3)), F.lit("...")))
    clean = F.slice(F.filter(F.transform("turns", lambda t: short(F.regexp_replace(F.btrim(T.squeeze(t), F.lit(" \t\r\n，。；;,.")), r"\[[Ee]\d+\]", ""), 120)), lambda t: F.length(t) > 0), 1, shown)
    return lists.select("conv_id", short(F.concat(F.lit("Recent focus: "), F.array_join(clean, " | "), F.lit(".")), 1200).alias("summary"))
