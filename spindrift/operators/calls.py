"""Model calls that are paid for once: answers are logged while the work goes on, and a rerun asks only what is not logged.

The log is a folder of small parquet files in a shared store. A task writes a file after every few answers, under a name
of its run, partition and attempt, so it is there when the task fails or its executor is lost: another attempt of the
task reads the files of its partition first, and a later run holds its inputs against the whole log. Results are read
from the log and not from the tasks, and of several answers to one input the first by name counts, so speculative tasks
and reruns give one result. Inputs that are equal are one call.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..session import ship
from ..verdicts import Refused

LOG = "key string, answer string, vector array<double>, error string, run string, place string"


def key_of(kind: str, model: str, settings: dict, payload: Column) -> Column:
    """What identifies a call: its kind, the model, what was set, and the input."""
    head = json.dumps([kind, model, settings], sort_keys=True, ensure_ascii=False)
    return F.sha2(F.concat(F.lit(head + "\0"), F.coalesce(payload, F.lit(""))).cast("binary"), 256)


def logged(spark: SparkSession, log: str) -> DataFrame:
    """All rows of a log; none where there is no log yet."""
    from ..sources.commit import files_of

    files, folder = files_of(spark, log)
    if not files.exists(folder):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(log)


def answers(spark: SparkSession, log: str) -> DataFrame:
    """key, answer, vector of the calls that were answered, one row a key."""
    good = logged(spark, log).where("error IS NULL")
    return good.groupBy("key").agg(F.min_by(F.struct("answer", "vector"), F.struct("run", "place")).alias("a")).select("key", "a.*")


class _Log:
    """A task's part of the log: what earlier attempts wrote, and files of so many answers."""

    def __init__(self, log: str, run: str, every: int):
        from pyarrow import fs
        from pyspark import TaskContext

        from ..sources.ordered import store_of

        context = TaskContext.get()
        store, root = store_of(log)
        self.store, self.folder = store, f"{root}/{run}/p{context.partitionId():06d}"
        self.run, self.attempt, self.every, self.rows, self.files = run, context.taskAttemptId(), every, [], 0
        self.held: dict[str, tuple] = {}
        for info in store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if info.base_name.endswith(".parquet"):
                from pyarrow import parquet

                for r in parquet.read_table(self.store.open_input_file(info.path)).to_pylist():
                    if r["error"] is None:
                        self.held.setdefault(r["key"], (r["answer"], r["vector"]))

    def add(self, key: str, answer: str | None, vector: list[float] | None, error: str | None) -> None:
        self.rows.append((key, answer, vector, error, self.run, f"{self.folder.rsplit('/', 1)[1]}/{self.attempt:012d}-{self.files:06d}-{len(self.rows):06d}"))
        if len(self.rows) >= self.every:
            self.write()

    def write(self) -> None:
        if not self.rows:
            return
        from pyarrow import parquet

        kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.string()]
        cols = [pa.array(list(c), k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)]
        name = f"{self.attempt:012d}-{self.files:06d}.parquet"
        self.store.create_dir(self.folder, recursive=True)
        parquet.write_table(pa.table(dict(zip([c.split()[0] for c in LOG.split(", ")], cols, strict=True))), f"{self.folder}/_{name}", filesystem=self.store)
        self.store.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")  # readers pass by names with an underscore
        self.rows, self.files = [], self.files + 1


def ask(todo: DataFrame, call: Callable[[list[str]], list], log: str, *, batch: int = 1, every: int = 16, vectors: bool = False) -> str:
    """Asks for all rows of todo(key, payload) and logs the answers; the result is the run's name.

    call: payloads -> as many answers, or Refused for the whole batch, which is logged as an error of each and does not
    end the work. Answers are texts or, with `vectors`, lists of numbers. `every` answers make a file: so many calls at
    most are lost with an executor, none with a task that raises.
    """
    ship(todo.sparkSession)
    run = uuid.uuid4().hex[:12]

    def work(batches):
        mine, asked = _Log(log, run, every), 0
        try:
            for rows in batches:
                pairs = [p for p in zip(rows.column("key").to_pylist(), rows.column("payload").to_pylist(), strict=True) if p[0] not in mine.held]
                for a in range(0, len(pairs), batch):
                    some = pairs[a : a + batch]
                    try:
                        got = call([p or "" for _, p in some])
                    except Refused as e:
                        for key, _ in some:
                            mine.add(key, None, None, f"{e.verdict}: {e.error}")
                        continue
                    if len(got) != len(some):
                        raise ValueError(f"{len(got)} answers for {len(some)} inputs")
                    asked += len(some)
                    for (key, _), answer in zip(some, got, strict=True):
                        mine.add(key, None if vectors else answer, list(map(float, answer)) if vectors else None, None)
        finally:
            mine.write()
        yield pa.RecordBatch.from_arrays([pa.array([asked], pa.int64())], ["asked"])

    number = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo.select("key", "payload").repartition(number, "key").mapInArrow(work, "asked long").write.format("noop").mode("overwrite").save()
    return run


def answered(inputs: DataFrame, payload: Column, call: Callable[[list[str]], list], log: str, *, kind: str, model: str, settings: dict | None = None, batch: int = 1, every: int = 16, vectors: bool = False) -> DataFrame:
    """Adds answer (or vector), error and reused to each row of inputs, asking only for payloads that the log has no answer to.

    reused: whether the log had the answer before. A null payload is asked as an empty one. Inputs that could not be
    answered in this run have an error, and are asked again by the next. Errors of earlier runs are not shown.
    """
    spark = inputs.sparkSession
    keyed = inputs.withColumn("_key", key_of(kind, model, settings or {}, payload))
    had = answers(spark, log).select("key").withColumn("_had", F.lit(True))
    todo = keyed.select(F.col("_key").alias("key"), payload.alias("payload")).groupBy("key").agg(F.first("payload").alias("payload"))
    run = ask(todo.join(had, "key", "left_anti"), call, log, batch=batch, every=every, vectors=vectors)
    mine = logged(spark, log).where(F.col("run") == run)
    before = logged(spark, log).where((F.col("run") != run) & F.col("error").isNull()).select("key").distinct().withColumn("_had", F.lit(True))
    failed = mine.where("error IS NOT NULL").groupBy(F.col("key").alias("_k")).agg(F.min_by("error", "place").alias("error"))
    found = answers(spark, log).join(before, "key", "left").select(F.col("key").alias("_k"), F.col("vector" if vectors else "answer"), F.coalesce("_had", F.lit(False)).alias("reused"))
    every_key = found.join(failed, "_k", "full")
    out = keyed.join(every_key, F.col("_key") == F.col("_k"), "left").withColumn("error", F.when(F.col("vector" if vectors else "answer").isNull(), F.col("error")))
    return out.select(*inputs.columns, "vector" if vectors else "answer", "error", F.coalesce("reused", F.lit(False)).alias("reused"))


def embedded(chunks: DataFrame, embed, log: str, *, model: str, prefix: str = "", batch: int = 16, text: str = "text", every: int = 256) -> DataFrame:
    """Adds vector and norm to chunks as `index.embedded` does, from the log where it has them."""
    got = answered(chunks, F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit(""))), embed, log, kind="embed", model=model, batch=batch, every=every, vectors=True)
    failed = got.where("error IS NOT NULL").select("error").first()
    if failed:
        verdict, _, error = failed[0].partition(": ")
        raise Refused(verdict, error, "run it again: what was answered is logged")
    return got.drop("error", "reused").withColumn("norm", norm(F.col("vector")))


COMPLETION = "struct<text:string,thinking:string,done_reason:string,eval_count:bigint,eval_duration:bigint,prompt_eval_count:bigint,load_duration:bigint>"


def completed(prompts: DataFrame, chat, log: str, *, model: str, prompt: str = "prompt", settings: dict | None = None, every: int = 1) -> DataFrame:
    """The completions of `models.completed`, each distinct prompt or history asked once over all runs."""
    history = dict(prompts.dtypes)[prompt] != "string"
    payload = F.to_json(prompt) if history else F.col(prompt)

    def call(payloads):
        return [json.dumps(chat([{"role": m["role"], "content": m["content"]} for m in json.loads(p)] if history else [{"role": "user", "content": p}]), ensure_ascii=False) for p in payloads]

    got = answered(prompts, payload, call, log, kind="chat", model=model, settings=(settings or {}) | {"history": history}, every=every)
    return got.withColumn("_a", F.from_json("answer", COMPLETION)).select(*prompts.columns, "_a.*", "error", "reused")


def decided(states: DataFrame, decider, questions: dict, log: str, *, model: str, item: str = "item", state: str = "state", every: int = 1) -> DataFrame:
    """item, qid, type, choice, noul, score, probabilities, confidence, error, reused as of `models.decided`, each distinct state asked once."""
    one = "struct<type:string,choice:string,noul:double,score:double,probabilities:map<string,double>,confidence:double>"
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None

    def plain(a):
        a = a if isinstance(a, dict) else {}
        odds = a.get("probabilities")
        return {k: a.get(k) for k in ("type", "choice")} | {k: number(a.get(k)) for k in ("noul", "score", "confidence")} | {"probabilities": {str(k): number(v) for k, v in odds.items()} if isinstance(odds, dict) else None}

    def call(payloads):
        return [json.dumps({qid: plain(found.get(qid)) for qid in questions}, ensure_ascii=False) for found in (decider(p, questions) for p in payloads)]

    rows = states.select(F.col(item).cast("string").alias("item"), F.col(state).cast("string").alias("state"))
    got = answered(rows, F.col("state"), call, log, kind="decide", model=model, settings={"questions": questions}, every=every)
    asked = F.array(*(F.lit(q) for q in questions))
    parsed = got.withColumn("_a", F.from_json("answer", f"map<string,{one}>")).select("item", F.explode(asked).alias("qid"), "_a", "error", "reused")
    return parsed.select("item", "qid", *(F.col("_a")[F.col("qid")][c].alias(c) for c in ("type", "choice", "noul", "score", "probabilities", "confidence")), "error", "reused")
