"""Detection of prompt injections and jailbreaks by ordered phrases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.operators.lastn import last_n

# The phrases of each kind of attack, in their order; the first in the list is reported.
INJECTION = ("ignore previous instructions", "disregard all", "new instructions:", "system:", "override")
JAILBREAK = ("pretend you are", "roleplay as", "act as if", "you are now")
CONTENT = 100


def first_indicator(text: Column, phrases: Sequence[str]) -> Column:
    """The first phrase of the list that the text contains in any case, else NULL."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases], F.lit(None).cast("string"))


def detect_injection(text: Column, extra: Sequence[str] = ()) -> Column:
    """Whether the text holds a prompt injection. ``extra`` phrases are an extension and none by default."""
    return first_indicator(text, (*INJECTION, *extra)).isNotNull()


def detect_jailbreak(text: Column, extra: Sequence[str] = ()) -> Column:
    return first_indicator(text, (*JAILBREAK, *extra)).isNotNull()


def analyze(df: DataFrame, text: str = "content") -> DataFrame:
    """``df`` with threats_detected (in fixed order), is_safe and the analysed snippet. NULL text is safe."""
    threats = F.array_compact(
        F.array(F.when(detect_injection(F.col(text)), F.lit("prompt_injection")), F.when(detect_jailbreak(F.col(text)), F.lit("jailbreak")))
    )
    return df.withColumns({"threats_detected": threats, "is_safe": F.size(threats) == 0, "snippet": F.substring(text, 1, CONTENT)})


def detected_attacks(df: DataFrame, text: str = "content", order: str = "seq", attack_type: str | None = None, limit: int | None = None) -> DataFrame:
    """(order, attack_type, content, indicator): one row for each attack, two where a text holds both kinds.

    With a limit the order is that of the texts; the injection of a text precedes its jailbreak.
    """
    kinds = (("prompt_injection", INJECTION), ("jailbreak", JAILBREAK))
    found = F.array(
        *[
            F.struct(F.lit(i).alias("_kind"), F.lit(name).alias("attack_type"), F.substring(text, 1, CONTENT).alias("content"), first_indicator(F.col(text), phrases).alias("indicator"))
            for i, (name, phrases) in enumerate(kinds)
        ]
    )
    rows = df.select(order, F.inline(F.filter(found, lambda a: a["indicator"].isNotNull())))
    if not limit:
        return last_n(rows, None, order, attack_type=attack_type).drop("_kind")
    both = rows.withColumn("_at", F.col(order) * 2 + F.col("_kind"))
    return last_n(both, limit, "_at", attack_type=attack_type).drop("_at", "_kind")
