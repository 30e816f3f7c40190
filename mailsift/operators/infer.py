"""Interfaces for models: prompt tables, pluggable scorers, parsing of their output.

A scorer is a plain Python function on pandas batches. Spark partitions the work; how many
calls run at once is how many tasks run at once, times the calls that a task may make.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.functions.address import domain, sender_key
from mailsift.functions.measure import two_decimals
from mailsift.ranking import chunk, first_wins
from mailsift.schema import SENDER_TYPES
from mailsift.session import durable

PROMPT_SENDERS = 50
ATTEMPTS = 2
THREAD_RESULT = (
    "thread_id string, category string, confidence double, actionable boolean, summary string, error string"
)
RESULT_COLUMNS = ["thread_id", "category", "confidence", "actionable", "summary", "error"]
# Answers as they are kept: of which content, and in which run they were given.
KEPT_COLUMNS = [*RESULT_COLUMNS, "content_key", "run"]
KEPT_ANSWER = f"{THREAD_RESULT}, content_key string, run string"
KEPT_TABLE = pa.schema(
    [(c, {"confidence": pa.float64(), "actionable": pa.bool_()}.get(c, pa.string())) for c in KEPT_COLUMNS]
)
SENDER_RESULT = "array<struct<email:string,senderType:string,confidence:double>>"
ARRAY_TEXT = r"(?s)(\[.*?\])"


def score_threads(
    entries: DataFrame,
    fn: Callable[[pd.DataFrame, list[str]], pd.DataFrame],
    categories: Sequence[str] = (),
    calls: int = 1,
    max_chars: int | None = None,
) -> DataFrame:
    """Ask ``fn(thread, categories)`` about every thread: its result rows and ``error``.

    ``entries`` are the ordered pieces of threads (thread_id, position, content). ``thread``
    is one row of thread_id and content, the pieces in order; ``categories`` are the names in
    use, so that names do not drift. A call that fails, or returns nothing for its thread,
    gives a row with an error and no category, and concerns that thread alone.

    A task makes up to ``calls`` calls at the same time, so ``fn`` must stand being called from
    several threads if that is more than one. A thread of more than ``max_chars`` characters is
    not asked about and gets an error; no more than that of it is held.
    """
    answers = _asking(fn, list(categories), calls, max_chars)

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        yield from answers(_threads(batches, max_chars))

    placed = entries.repartition("thread_id").sortWithinPartitions("thread_id", "position")
    return placed.select("thread_id", "content").mapInPandas(run, THREAD_RESULT)


def score_threads_once(
    entries: DataFrame,
    fn: Callable[[pd.DataFrame, list[str]], pd.DataFrame],
    kept: str,
    categories: Sequence[str] = (),
    calls: int = 1,
    max_chars: int | None = None,
    keep_every: int = 100,
) -> DataFrame:
    """``score_threads`` with answers kept in the shared folder ``kept``, so none is asked for twice.

    A task adds its answers there ``keep_every`` at a time while it runs, under a hash of what
    was asked about. Threads with a kept answer to the same content are not asked about again,
    whether a task is tried again, the job failed, or a later run repeats the thread. What may be
    asked for twice are the answers since the last addition, if an executor dies just then. Errors
    are kept for the tries of one run, and asked about again by the next; so are threads without an id.
    The asking happens at once, not when the result is read.
    """
    if keep_every < 1:
        raise ValueError("keep_every must be positive")
    spark = entries.sparkSession
    # An addition of no rows: from here on the folder exists and has the columns.
    spark.createDataFrame([], KEPT_ANSWER).write.mode("append").parquet(kept)
    known = spark.read.schema(KEPT_ANSWER).parquet(kept).filter(F.col("error").isNull())
    answer = F.min(F.struct(*RESULT_COLUMNS[1:])).alias("a")
    known = known.groupBy("thread_id", "content_key").agg(answer)
    keyed = durable(entries.groupBy("thread_id").agg(_content_key()), "threads")
    asked_before = keyed.join(known, ["thread_id", "content_key"]).select("thread_id", "a.*")
    pending = keyed.join(known, ["thread_id", "content_key"], "left_anti")
    pending = pending.select(F.col("thread_id").alias("_id"), "content_key")
    todo = entries.join(pending, F.col("thread_id").eqNullSafe(F.col("_id")))
    answers, run_name = _asking(fn, list(categories), calls, max_chars), uuid.uuid4().hex

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        task = TaskContext.get()
        place = f"{run_name}-{task.partitionId():06d}"
        given = _kept_by(kept, place) if task.attemptNumber() else {}
        keys: dict[str | None, str] = {}
        repeated: list[pd.DataFrame] = []

        def open_threads() -> Iterable[tuple[str, list[str] | None]]:
            for thread_id, pieces in _threads(batches, max_chars, keys):
                if (thread_id, keys[thread_id]) in given:
                    repeated.append(given[thread_id, keys.pop(thread_id)])
                else:
                    yield thread_id, pieces

        held: list[pd.DataFrame] = []
        try:
            for row in answers(open_threads()):
                held.append(row.assign(content_key=keys.pop(row["thread_id"].iloc[0]), run=run_name))
                if len(held) == keep_every:
                    _keep(kept, place, held)
                    rows, held = held, []
                    yield from (r[RESULT_COLUMNS] for r in rows)
        finally:
            # Also where the task ends by an error: what was answered stays answered.
            if held:
                _keep(kept, place, held)
        yield from (r[RESULT_COLUMNS] for r in [*held, *repeated])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = todo.repartition(tasks, "thread_id").sortWithinPartitions("thread_id", "position")
    fresh = placed.select("thread_id", "content", "content_key").mapInPandas(run, THREAD_RESULT)
    return asked_before.unionByName(durable(fresh, "answers"))


def _content_key():
    """A hash of the pieces of a thread and their positions, in a buffer of fixed size."""
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "position", "content")).cast("string") for seed in (1, 2)]
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), *hashes).alias("content_key")


def _shared(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path of the session's, from a task."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
    return fs.LocalFileSystem(), path


def _keep(kept: str, place: str, rows: list[pd.DataFrame]) -> None:
    """Add answers as one file, which is there as a whole or not at all."""
    system, folder = _shared(kept)
    table = pd.concat([r[KEPT_COLUMNS].astype(object) for r in rows], ignore_index=True)
    name = f"{place}-{uuid.uuid4().hex}.parquet"
    with system.open_output_stream(f"{folder}/_{name}") as out:
        pq.write_table(pa.Table.from_pandas(table, KEPT_TABLE, preserve_index=False), out)
    system.move(f"{folder}/_{name}", f"{folder}/{name}")


def _kept_by(kept: str, place: str) -> dict[tuple[str | None, str], pd.DataFrame]:
    """What earlier tries of a task have kept in this run, by thread and content."""
    system, folder = _shared(kept)
    found = {}
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.base_name.startswith(place):
            with system.open_input_file(info.path) as file:
                for row in pq.read_table(file).to_pylist():
                    one = pd.DataFrame([[row[c] for c in RESULT_COLUMNS]], columns=RESULT_COLUMNS)
                    found[row["thread_id"], row["content_key"]] = one
    return found


def _threads(
    batches: Iterable[pd.DataFrame], max_chars: int | None, keys: dict[str | None, str] | None = None
) -> Iterable[tuple[str, list[str] | None]]:
    """The pieces of each thread, or None where they are too long; ``keys`` gets the key of its content."""
    current, pieces, held = None, None, -1
    for batch in batches:
        content_keys = batch["content_key"] if keys is not None else batch["thread_id"]
        for thread_id, content, key in zip(batch["thread_id"], batch["content"], content_keys):
            if held >= 0 and thread_id != current:
                yield current, pieces
                held = -1
            if held < 0:
                current, pieces, held = thread_id, [], 0
                if keys is not None:
                    keys[thread_id] = key
            held += len(content or "")
            if max_chars is not None and held > max_chars:
                pieces = None
            elif pieces is not None:
                pieces.append(content or "")
    if held >= 0:
        yield current, pieces


def _asking(fn: Callable, known: list[str], calls: int, max_chars: int | None) -> Callable:
    """A function from (thread_id, pieces) to result rows, in order, with ``calls`` calls at the same time."""
    if calls < 1:
        raise ValueError("calls must be positive")

    def ask(thread_id: str, pieces: list[str]) -> pd.DataFrame:
        thread = pd.DataFrame({"thread_id": [thread_id], "content": ["\n\n".join(p for p in pieces if p)]})
        try:
            result = fn(thread, known)
            result = result[result["thread_id"] == thread_id].head(1)
            if len(result):
                return result.assign(error=None)[RESULT_COLUMNS]
            error = "no result"
        except Exception as failure:  # the model is code of the caller; what went wrong is part of the result
            error = f"{type(failure).__name__}: {failure}"
        return pd.DataFrame([[thread_id, None, None, None, None, error]], columns=RESULT_COLUMNS)

    def answer(thread_id: str, pieces: list[str] | None) -> pd.DataFrame:
        if pieces is None:
            error = f"thread of more than {max_chars} characters"
            return pd.DataFrame([[thread_id, None, None, None, None, error]], columns=RESULT_COLUMNS)
        return ask(thread_id, pieces)

    def answers(threads: Iterable[tuple[str, list[str] | None]]) -> Iterable[pd.DataFrame]:
        if calls == 1:
            yield from (answer(*t) for t in threads)
            return
        with ThreadPoolExecutor(calls) as pool:
            waiting = deque()
            for thread in threads:
                waiting.append(pool.submit(answer, *thread))
                if len(waiting) == calls:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()

    return answers


def sender_prompts(senders: DataFrame, examples: DataFrame, size: int = PROMPT_SENDERS) -> DataFrame:
    """One prompt per ``size`` senders: (prompt_no, instructions, payload, emails).

    ``examples`` is the few-shot table, which is limited by its own definition.
    """
    item = F.struct(
        F.col("sender_email").alias("email"),
        F.col("sender_name").alias("name"),
        domain("sender_email").alias("domain"),
        F.slice("sample_subjects", 1, 5).alias("subjects"),
        F.col("email_count").alias("emailCount"),
        F.col("category").alias("gmailCategory"),
        two_decimals("unread_ratio").alias("unreadRatio"),
        F.col("thread_count").alias("threadCount"),
    )
    chunked = chunk(senders, [], "first_seq", size, "prompt_no")
    listed = F.array_sort(F.collect_list(F.struct("first_seq", item.alias("item"))))
    prompts = chunked.groupBy("prompt_no").agg(listed.alias("_s"))
    line = F.concat(F.lit("- "), "sender_email", F.lit(" → "), "sender_type", F.lit(" ("), "context", F.lit(")"))
    ordered = F.struct(F.when(F.col("context") == "corrected", 0).otherwise(1).alias("r"), "log_seq", line.alias("line"))
    lines = examples.agg(F.array_join(F.array_sort(F.collect_list(ordered))["line"], "\n")).scalar()
    return prompts.select(
        "prompt_no",
        F.concat(
            F.lit("Give each sender one type of " + ", ".join(SENDER_TYPES) + " as a JSON array.\n"),
            F.coalesce(lines, F.lit("")),
        ).alias("instructions"),
        F.to_json(F.col("_s.item")).alias("payload"),
        F.col("_s.item.email").alias("emails"),
    )


def score_senders(prompts: DataFrame, fn: Callable[[str, str], str]) -> DataFrame:
    """Ask ``fn(instructions, payload)`` per prompt, once more on failure: (prompt_no, response)."""

    def ask(instructions: str, payload: str) -> str:
        for _ in range(ATTEMPTS):
            try:
                answer = fn(instructions, payload)
            except Exception:
                continue
            if answer:
                return answer
        return ""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            answers = [ask(i, p) for i, p in zip(batch["instructions"], batch["payload"])]
            yield pd.DataFrame({"prompt_no": batch["prompt_no"], "response": answers})

    return prompts.select("prompt_no", "instructions", "payload").mapInPandas(run, "prompt_no long, response string")


def parse_sender_results(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    """Valid results per asked sender: (prompt_no, email, sender_type, confidence).

    Of each response, the first JSON array that holds a valid entry counts. Entries for
    senders that were not asked are dropped and the first of duplicates is kept; a sender
    without an entry is unknown with confidence 0.
    """
    entry_ok = lambda e: (
        e["email"].isNotNull()
        & F.coalesce(e["senderType"].isin(SENDER_TYPES), F.lit(False))
        & F.coalesce(e["confidence"].between(0.0, 1.0), F.lit(False))
    )
    arrays = F.transform(
        F.regexp_extract_all("response", F.lit(ARRAY_TEXT), 1),
        lambda text: F.filter(F.coalesce(F.from_json(text, SENDER_RESULT), F.array()), entry_ok),
    )
    usable = F.try_element_at(F.filter(arrays, lambda a: F.size(a) > 0), F.lit(1))
    entries = responses.select("prompt_no", F.posexplode(usable).alias("_pos", "_e")).select(
        "prompt_no",
        "_pos",
        F.lower("_e.email").alias("email"),
        F.col("_e.senderType").alias("sender_type"),
        F.col("_e.confidence").alias("confidence"),
    )
    first = first_wins(entries, ["prompt_no", "email"], "_pos").drop("_pos")
    asked = prompts.select("prompt_no", F.explode("emails").alias("email")).withColumn("email", sender_key("email"))
    return asked.join(first, ["prompt_no", "email"], "left").select(
        "prompt_no",
        "email",
        F.coalesce("sender_type", F.lit("unknown")).alias("sender_type"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def propose_taxonomy(sample: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """Category names proposed for the taxonomy sample; a failing call fails the job.

    One call sees the whole sample, so one task asks it; the sample's size is its caller's.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        texts: list[str] = []
        for batch in batches:
            texts.extend(batch["summary"])
        yield pd.DataFrame({"category": pd.Series(fn(texts), dtype="object")})

    return sample.orderBy("first_seq").coalesce(1).select("summary").mapInPandas(run, "category string")
