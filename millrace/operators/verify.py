"""Golden-output comparison: modes per stream, masks, quarantine, and the roll-up."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def normalized(text: Column, masks: list[tuple[str, str]] | None = None, strip: bool = True) -> Column:
    """A text without trailing white space of lines and with masks applied in order; invalid patterns are ignored."""
    out = T.strip_line_ends(text) if strip else text
    for pattern, token in masks or []:
        try:
            re.compile(pattern)
        except re.error:
            continue
        out = F.regexp_replace(out, pattern, token.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def stream_differs(mode: Column, want: Column, got: Column, masks: list[tuple[str, str]] | None = None) -> Column:
    """Whether a stream differs under its mode: ignore, exact or normalized."""
    exact = ~want.eqNullSafe(got)
    return F.when(mode == "ignore", False).when(mode == "normalized", ~normalized(want, masks).eqNullSafe(normalized(got, masks))).otherwise(exact)


def differences(cases: DataFrame, masks: list[tuple[str, str]] | None = None) -> DataFrame:
    """Cases joined with golden and observed streams, with the names of those that differ.

    Columns: spec, name, nondeterministic, cmp_*, want_* and got_* for stdout, stderr and exit. A case
    without golden output differs in `golden`. Exit codes have no normal form: all but ignore is exact.
    """
    missing = F.col("want_exit").isNull() & F.col("want_stdout").isNull()
    streams = [F.when(stream_differs(F.col(f"cmp_{s}"), F.col(f"want_{s}"), F.col(f"got_{s}"), masks), s) for s in ("stdout", "stderr")]
    code = F.when((F.col("cmp_exit") != "ignore") & ~F.col("want_exit").eqNullSafe(F.col("got_exit")), "exit")
    return cases.withColumn("diffs", F.when(missing, F.array(F.lit("golden"))).otherwise(F.array_compact(F.array(*streams, code))))


def captured(observed: DataFrame) -> DataFrame:
    """Two observations of each case (run 1 and 2) as golden output, quarantined if they disagree."""
    one, two = observed.filter("run = 1"), observed.filter("run = 2").select("spec", "name", *[F.col(c).alias(f"_{c}") for c in ("stdout", "stderr", "exit_code")])
    same = F.lit(True)
    for c in ("stdout", "stderr", "exit_code"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return one.join(two, ["spec", "name"], "left").select("spec", "name", "stdout", "stderr", "exit_code", (~same).alias("nondeterministic"))


def report(compared: DataFrame) -> DataFrame:
    """Per specification: matched, total, quarantined, and a verdict.

    Quarantined cases do not count. A specification without any case that counts is `unverified`, not
    passed: nothing was shown.
    """
    quarantined = F.coalesce("nondeterministic", F.lit(False))
    rolled = compared.groupBy("spec").agg(F.count_if(~quarantined & (F.size("diffs") == 0)).alias("matched"), F.count_if(~quarantined).alias("total"), F.count_if(quarantined).alias("quarantined"))
    return rolled.withColumn("verdict", F.when(F.col("total") == 0, "unverified").when(F.col("matched") == F.col("total"), "passed").otherwise("failed"))


def repair_accepted(before: Column, after: Column) -> Column:
    """A repair is kept only if strictly fewer errors are left."""
    return after < before
