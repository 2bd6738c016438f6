"""The signals of a recall score, and how they combine.

base = similarity, decay and recency (and graph proximity) by weight; a gate that opens with the
similarity lets importance amplify the base; valence multiplies.  Fixed choices where nothing
prescribes one: the valence multiplier multiplies the score and is never below 1; graph proximity is
the edge's weight over one more than the hops; scores are never below 0.
"""

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

RECENCY_SECONDS = 7 * 86400.0

# Words that make a query sound positive or negative.
POSITIVE_WORDS = ("happy", "great", "good", "love", "excited", "proud", "wonderful", "success", "glad", "fun")
NEGATIVE_WORDS = ("sad", "wrong", "bad", "angry", "hate", "worried", "failed", "problem", "upset", "stress")


@dataclass(frozen=True)
class Weights:
    """Weights of the signals, and the shape of the gate."""

    sim: float = 0.50
    decay: float = 0.20
    recency: float = 0.30
    graph: float = 0.0
    gate_k: float = 12.0
    gate_tau: float = 0.25
    alpha_imp: float = 0.80
    valence: float = 0.30

    def expanded(self) -> "Weights":
        """The weights of graph-expanded recall."""
        return replace(self, sim=0.35, decay=0.15, recency=0.20, graph=0.30)


def decay(importance: Column, elapsed: Column, half_life: Column) -> Column:
    """Strength left of an importance after some seconds."""
    return importance * F.pow(F.lit(2.0), -elapsed / half_life)


def recency(age: Column) -> Column:
    return F.exp(-age / RECENCY_SECONDS)


def gate(similarity: Column, w: Weights = Weights()) -> Column:
    return 1.0 / (1.0 + F.exp(-w.gate_k * (similarity - w.gate_tau)))


def sentiment(query: str | None) -> int:
    """1, -1 or 0 for a query text, by counted words.

    >>> sentiment("I feel so sad"), sentiment("good news"), sentiment("the plan")
    (-1, 1, 0)
    """
    found = (query or "").lower().split()
    score = sum(w.strip(".,!?") in POSITIVE_WORDS for w in found) - sum(w.strip(".,!?") in NEGATIVE_WORDS for w in found)
    return (score > 0) - (score < 0)


def valence_multiplier(valence: Column, mood: int, w: Weights = Weights()) -> Column:
    """At least 1: more for memories of the query's mood, or of any mood if it has none."""
    aligned = F.abs(valence) if mood == 0 else F.greatest(valence * mood, F.lit(0.0))
    return 1.0 + w.valence * aligned


def signals(
    similarity: Column, importance: Column, valence: Column, half_life: Column, created_at: Column, now: float,
    mood: int = 0, proximity: Column | None = None, w: Weights = Weights(),
) -> dict[str, Column]:
    """All signals of a memory, by name, and their ``score``."""
    age = F.lit(now) - created_at
    out = {"similarity": similarity, "decay": decay(importance, age, half_life), "recency": recency(age)}
    out["graph_proximity"] = proximity if proximity is not None else F.lit(0.0)
    base = w.sim * out["similarity"] + w.decay * out["decay"] + w.recency * out["recency"] + w.graph * out["graph_proximity"]
    out["importance_gate"] = gate(similarity, w) * w.alpha_imp * importance
    out["valence_multiplier"] = valence_multiplier(valence, mood, w)
    out["score"] = F.greatest(base * (1.0 + out["importance_gate"]) * out["valence_multiplier"], F.lit(0.0))
    return out
