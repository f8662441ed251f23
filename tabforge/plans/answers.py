"""One integer answer per problem text, from a user's own function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions.numeric import clamp_answer


def answer_problems(
    problems: DataFrame, solve: Callable[[str], object], id_col: str = "id", text: str = "problem"
) -> DataFrame:
    """(id, answer): ``solve`` runs on the executors; whatever fails or is no number is 0."""
    key_type = dict(problems.dtypes)[id_col]

    def attempt(problem: str):
        try:
            return str(int(solve(problem)))
        except Exception:  # a user's solver may fail in any way; the answer is then 0
            return None

    def run(batches):
        for batch in batches:
            batch["answer"] = [attempt(problem) for problem in batch.pop(text)]
            yield batch

    answered = problems.select(id_col, text).mapInPandas(run, f"`{id_col}` {key_type}, answer string")
    return answered.select(id_col, clamp_answer(F.col("answer")).alias("answer"))
