"""Two levels of labels: policies that keep a fine answer or fall back to the coarse one, and the chain-rule projection."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import arrays as A

KINDS = ("confidence_threshold", "margin_threshold", "not_abstained", "always_accept", "all_of", "any_of")


@dataclass(frozen=True)
class Policy:
    """A predicate over a probability array, as a value: a kind, its number, and the policies it combines."""

    kind: str
    value: float | None = None
    children: tuple[Policy, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown policy {self.kind!r}; known: {', '.join(KINDS)}")
        if (self.value is None) == self.kind.endswith("_threshold"):
            raise ValueError(f"{self.kind} takes {'a' if self.value is None else 'no'} value")
        if self.children and self.kind not in ("all_of", "any_of"):
            raise ValueError(f"{self.kind} combines nothing")

    def accepts(self, p: Column, abstained: Column) -> Column:
        """Whether the answer stays. An empty all_of keeps everything, an empty any_of nothing; one class has an unbounded margin."""
        if self.kind == "confidence_threshold":
            return F.array_max(p) >= self.value
        if self.kind == "margin_threshold":
            return (F.size(p) < 2) | (A.margin(p) >= self.value)
        if self.kind == "not_abstained":
            return ~abstained
        out = F.lit(self.kind != "any_of")
        for child in self.children:
            each = child.accepts(p, abstained)
            out = (out | each) if self.kind == "any_of" else (out & each)
        return out

    def to_json(self) -> str:
        return json.dumps(self._plain(), sort_keys=True)

    def _plain(self) -> dict:
        return {"kind": self.kind} | ({"value": self.value} if self.value is not None else {}) | ({"children": [c._plain() for c in self.children]} if self.children else {})

    @classmethod
    def from_json(cls, text: str) -> Policy:
        return cls._made(json.loads(text))

    @classmethod
    def _made(cls, spec: dict) -> Policy:
        if unknown := set(spec) - {"kind", "value", "children"}:
            raise ValueError(f"unknown entries: {', '.join(sorted(unknown))}")
        return cls(spec["kind"], spec.get("value"), tuple(cls._made(c) for c in spec.get("children", ())))


def _families(fine: list[str], parent: dict[str, str]) -> Column:
    return F.array(*[F.lit(parent.get(x)) for x in fine])


def projected(p: Column, fine: list[str], coarse_label: Column, coarse_p: Column, parent: dict[str, str]) -> Column:
    """The fine probabilities inside the coarse label, scaled to its probability (they sum to that, not to 1); null if the label has no fine ones; unchanged if there is no coarse label."""
    inside = F.zip_with(p, _families(fine, parent), lambda x, f: F.when(f == coarse_label, x).otherwise(0.0))
    total = A.total(inside)
    return F.when(coarse_label.isNull(), p).when(total > 0, F.transform(inside, lambda x: coarse_p * x / total))


def decide(df: DataFrame, fine: list[str], coarse: list[str], parent: dict[str, str], policy: Policy, abstain_below: float | None = None, mask: bool = True) -> DataFrame:
    """df (fine_p, coarse_p) with label, level and p: the fine answer if the policy accepts it, otherwise the coarse one.

    abstain_below: an answer of lower confidence is an abstention (label null), as of a classifier that may abstain.
    """
    abstains = lambda p: F.array_max(p) < F.lit(abstain_below if abstain_below is not None else 0.0)
    top = A.argmax_label(F.col("coarse_p"), coarse)
    rows = df.withColumns({"_coarse": F.when(~abstains(F.col("coarse_p")), top), "_top": F.array_max("coarse_p"), "_abstained": abstains(F.col("fine_p"))})
    kept = projected(F.col("fine_p"), fine, F.col("_coarse"), F.col("_top"), parent) if mask else F.col("fine_p")
    rows = rows.withColumn("_fine", kept)
    stays = F.col("_fine").isNotNull() & policy.accepts(F.col("_fine"), F.col("_abstained"))
    label = A.argmax_label(F.col("_fine"), fine)
    fine_label = F.when(F.col("_coarse").isNotNull() & F.lit(mask), label).otherwise(F.when(~F.col("_abstained"), label))
    out = rows.withColumn("_stays", F.coalesce(stays, F.lit(False)))
    return out.select(*df.columns, F.when(F.col("_stays"), fine_label).otherwise(F.col("_coarse")).alias("label"), F.when(F.col("_stays"), "fine").otherwise("coarse").alias("level"), F.when(F.col("_stays"), F.col("_fine")).otherwise(F.col("coarse_p")).alias("p"))
