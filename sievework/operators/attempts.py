"""Retries: the ordered attempts of a task folded under the retry rules, and what becomes of the task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import error_policy, wait

#: Retries after which an overloaded provider, or a request that is too large, is given up.
MOST = 3


def folded(errors: Column) -> Column:
    """A task's state after its attempts, given in order as error texts, null for an answer.

    state: done, given up, failed, or open while every attempt so far asks for another one; attempts that were made,
    retries that were counted, seconds waited between them, and the error that ended it. What comes after the end doesn't count.
    """
    start = F.struct(F.lit("open").alias("state"), F.lit(0).alias("attempts"), F.lit(0).alias("retries"), F.lit(0).cast("long").alias("waited"), F.lit(None).cast("string").alias("error"))

    def step(s, text):
        policy = error_policy(text)
        again = policy != "other"
        retries = s.retries + again.cast("int")
        limited = (policy == "unavailable") | text.contains("413")
        given_up = limited & (retries > MOST)
        reason = F.when(policy == "unavailable", "503 after 3 retries: ").otherwise("413 too large after 3 retries: ")
        done = F.struct(F.lit("done").alias("state"), (s.attempts + 1).alias("attempts"), s.retries.alias("retries"), s.waited.alias("waited"), F.lit(None).cast("string").alias("error"))
        error = F.when(given_up, F.concat(reason, text)).when(~again, F.concat(F.lit("Non-retryable: "), text))
        other = F.struct(F.when(given_up, "given up").when(again, "open").otherwise("failed").alias("state"), (s.attempts + 1).alias("attempts"), retries.alias("retries"), (s.waited + F.when(again & ~given_up, wait(policy)).otherwise(0)).alias("waited"), error.alias("error"))
        return F.when(s.state != "open", s).when(text.isNull(), done).otherwise(other)

    return F.aggregate(errors, start, step)


def outcomes(attempts: DataFrame, key: str, order: str, error: str = "error") -> DataFrame:
    """key, state, attempts, retries, waited and error of each task, from its attempts (key, order, error) in any order.

    Attempts of one place are taken by their texts, an answer first. A task's attempts are few: a rule without a limit
    goes on until it is answered, but each waits 30 seconds or more.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(error, F.lit("")).alias("s"), F.col(error).alias("e")))), lambda x: x.e)
    found = attempts.groupBy(key).agg(folded(listed).alias("f"))
    return found.select(key, "f.*")
