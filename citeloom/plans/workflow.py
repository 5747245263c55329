"""UDF01, UDF02, UDF05, UDF06: steps as functions over tables, run in order.

Model calls are tables of responses: a step that needs one is given the rows it
would have got (``publication_id, step, response``), so every plan can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import responses

Step = Callable[[DataFrame], DataFrame]
# The steps in their order.
STEPS = ["triage", "validation", "discovery", "joins", "code", "repositories", "assembly"]


@dataclass
class Workflow:
    """Registered steps over one row per publication; a step's failure is kept in ``error`` and the next one goes on."""

    recover: bool = True
    steps: dict[str, Step] = field(default_factory=dict)

    def register(self, name: str, step: Step) -> None:
        if name not in STEPS:
            raise ValueError(f"no step {name}")
        self.steps[name] = step

    def run(self, publications: DataFrame) -> DataFrame:
        """The publications with every step's columns and ``progress``; steps that can't be planned are noted and left out."""
        df, done, errors = publications, 0, []
        for name in STEPS:
            if name not in self.steps:
                continue
            try:
                df = self.steps[name](df)
                done += 1
            except Exception as e:
                if not self.recover:
                    raise
                errors.append(f"{name}: {e}"[:200])
        note = F.lit("; ".join(errors)) if errors else F.lit(None).cast("string")
        return df.withColumn("error", note).withColumn("progress", F.lit(done * 100.0 / len(STEPS)))


def response_step(answers: DataFrame, step: str, parse: Callable = responses.triage, name: str | None = None, key: str = "publication_id") -> Step:
    """UDF03, UDF04, UDF07-10: a step that joins the responses of ``step`` and parses them into a column."""
    own = answers.where(F.col("step") == step).groupBy(key).agg(F.min("response").alias("_response"))

    def run(df: DataFrame) -> DataFrame:
        got = df.join(own, key, "left")
        return got.withColumn(name or step, parse(responses.envelope(F.col("_response")))).drop("_response")

    return run


def gated(step: Step, condition: str, column: str) -> Step:
    """FIL05, FIL06: a step whose column is null for rows that don't meet the condition."""

    def run(df: DataFrame) -> DataFrame:
        return step(df).withColumn(column, F.when(F.expr(condition), F.col(column)))

    return run
