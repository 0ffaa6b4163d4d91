"""Handing prompts to a model function in batches, to a remote client with retries, or premise by premise."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type

from formulary.functions.text import PHI
from formulary.operators.prompts import ChatTemplate
from formulary.operators.results import ERROR
from formulary.plans import fixed_texts as t

Model = Callable[[list[str]], list[str]]
PER_THREAD = 4  # requests per thread whose answers are held back until all of them are there


def _with(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(n, kind) for n, kind in fields])


def _call(model: Model, prompts: list[str]) -> list[str]:
    answers = list(model(prompts)) if prompts else []
    if len(answers) != len(prompts):
        raise ValueError(f"model returned {len(answers)} answers for {len(prompts)} prompts")
    return answers


def _portions(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def _extended(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with its own columns untouched and some more behind them."""
    return pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])


def generate(
    df: DataFrame,
    load: Callable[[], Model],
    batch_size: int = 32,
    prompt: str = "prompt",
    out: str = "fol_pred",
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Adds the model's answer to every row; `load` runs once per task.

    Arrow batches are re-cut to `batch_size`; only the last batch of a task may be shorter. `profile` names
    what the tasks of this stage need, such as one accelerator each, and so bounds how many models run at a
    time; other stages keep theirs. Clusters honour it (standalone, YARN, Kubernetes), local masters refuse it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()

        def answered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for batch in rows.combine_chunks().to_batches():
                answers = _call(model, batch.column(prompt).to_pylist())
                yield _extended(batch, {out: pa.array(answers, pa.string())})

        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held < batch_size:
                continue
            rows = pa.Table.from_batches(waiting)
            whole = held - held % batch_size
            for start in range(0, whole, batch_size):
                yield from answered(rows.slice(start, batch_size))
            waiting, held = rows.slice(whole).to_batches(), held - whole
        if held:
            yield from answered(pa.Table.from_batches(waiting))

    return df.mapInArrow(run, _with(df.schema, (out, T.StringType())), profile=profile)


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = 5
    base_wait: float = 4.0
    factor: float = 2.0
    threads: int = 20
    sleep: Callable[[float], None] = time.sleep

    def wait(self, attempt: int) -> float:
        return self.base_wait * self.factor**attempt


@dataclass(frozen=True)
class Reply:
    content: str
    reasoning: str = ""


Client = Callable[[str, str], Reply]


def _try(client: Client, system: str, user: str, policy: RetryPolicy) -> tuple[Reply | None, int, str | None]:
    """(reply or None, attempts used, last error)."""
    error = None
    for attempt in range(policy.attempts):
        try:
            return client(system, user), attempt + 1, error
        except Exception as e:  # noqa: BLE001 - any failure of a remote call is retried
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < policy.attempts:
                policy.sleep(policy.wait(attempt))
    return None, policy.attempts, error


def fallback_system(head: str, tail: str, thoughts: str) -> str:
    return head + (t.EARLIER_THOUGHTS + thoughts if thoughts else "") + tail


def call_with_retry(
    df: DataFrame,
    make_client: Callable[[], Client],
    policy: RetryPolicy = RetryPolicy(),
    make_fallback: Callable[[], Client] | None = None,
    fallback_text: tuple[str, str] = (t.FEW_SHOT_REASONING_HEAD, t.ANSWER),
) -> DataFrame:
    """One remote request per row (`system`, `nl`); no row is ever lost.

    Failures are retried with growing waits. An empty answer is a failure that goes straight to the
    fallback client, whose system text quotes the thoughts received so far. Adds fol_pred,
    fol_pred_reasoning, status (ok, fallback, failed), attempts, fallback_used, error. Requests in
    flight: running tasks x threads (flows.predict_remote bounds them over the cluster); answers leave in portions of PER_THREAD times that, so a slow request
    holds back few others. To keep paid answers when a task is lost, run portions of rows one after the
    other (flows.predict_remote).
    """
    added = [
        ("fol_pred", T.StringType()),
        ("fol_pred_reasoning", T.StringType()),
        ("status", T.StringType()),
        ("attempts", T.IntegerType()),
        ("fallback_used", T.BooleanType()),
        ("error", T.StringType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        fallback = make_fallback() if make_fallback else None

        def one(row: tuple[str, str]) -> tuple:
            system, user = row
            reply, used, error = _try(client, system, user, policy)
            if reply is not None and reply.content:
                return reply.content, reply.reasoning, "ok", used, False, error
            thoughts = reply.reasoning if reply is not None else ""
            error = "empty answer" if reply is not None else error
            if fallback is not None:
                second, more, late_error = _try(fallback, fallback_system(*fallback_text, thoughts), user, policy)
                used += more
                if second is not None and second.content:
                    return second.content, thoughts, "fallback", used, True, error
                error = late_error or error
            return ERROR, thoughts, "failed", used, fallback is not None, error

        with ThreadPoolExecutor(policy.threads) as pool:
            for batch in (part for whole in batches for part in _portions(whole, policy.threads * PER_THREAD)):
                asked = zip(batch.column("system").to_pylist(), batch.column("nl").to_pylist())
                done = list(pool.map(one, asked))
                outcome = {
                    name: pa.array([d[i] for d in done], to_arrow_type(kind)) for i, (name, kind) in enumerate(added)
                }
                yield _extended(batch, outcome)

    return df.mapInArrow(run, _with(df.schema, *added))


def _chain_prompt(template: ChatTemplate, text: str, formulas: list[str], always_header: bool) -> str:
    lines = "\n".join(f"{PHI}{i} = {f}" for i, f in enumerate(formulas, 1))
    context = t.CHAIN_HEADER + lines if formulas or always_header else ""
    turns = [("system", t.CHAIN_SYSTEM), ("assistant", context), ("user", text)]
    return "".join(
        template.before_role + role + template.after_role + content + template.close for role, content in turns
    )


def _formula(answer: str) -> str:
    return answer[answer.rfind("=") + 1 :].strip()


def generate_sequential(
    examples: DataFrame, load: Callable[[], Model], template: ChatTemplate = ChatTemplate(), batch_size: int = 32
) -> DataFrame:
    """Adds `premises_fol` and `conclusion_fol`: premises strictly in order, each prompt showing the
    formulas so far, then the conclusion; an empty conclusion is not sent.

    An example is one row, so examples spread over tasks without a shuffle. The model sees the same step
    of up to `batch_size` examples at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in (part for whole in batches for part in _portions(whole, batch_size)):
            premises = [p or [] for p in batch.column("premises").to_pylist()]
            formulas: list[list[str]] = [[] for _ in premises]
            for step in range(max(map(len, premises), default=0)):
                live = [i for i, p in enumerate(premises) if len(p) > step]
                asked = [_chain_prompt(template, premises[i][step], formulas[i], False) for i in live]
                for i, answer in zip(live, _call(model, asked)):
                    formulas[i].append(_formula(answer))
            ends = batch.column("conclusion").to_pylist()
            live = [i for i, c in enumerate(ends) if c]
            asked = [_chain_prompt(template, ends[i], formulas[i], True) for i in live]
            last = dict(zip(live, map(_formula, _call(model, asked))))
            yield _extended(
                batch,
                {
                    "premises_fol": pa.array(formulas, pa.list_(pa.string())),
                    "conclusion_fol": pa.array([last.get(i, "") for i in range(len(ends))], pa.string()),
                },
            )

    return examples.mapInArrow(
        run,
        _with(examples.schema, ("premises_fol", T.ArrayType(T.StringType())), ("conclusion_fol", T.StringType())),
    )
