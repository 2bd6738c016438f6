"""Claims in plain sentences: patterns, negation and modality in the words before.

Sentences are split at ``;``, ``, then`` and ``, subsequently``.  A cue among the six words before a
relation makes it negative or sets its modality.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = "[A-Z][A-Za-z0-9&]*(?: [A-Z][A-Za-z0-9&]*)*"
_HEDGE = "(?:(?:not|never|allegedly|reportedly|may|might|also|now) )*"

# The relations, in the order of the list that fixes them: relation, verb phrase between the two names.
ROLES = (("ceo_of", "CEO"), ("cto_of", "CTO"), ("founder_of", "founder"))
PATTERNS = (
    *((relation, f"is the {role} of") for relation, role in ROLES),
    ("leads", "leads"),
    ("founded", "founded"),
    ("works_at", "works at"),
    ("born_in", "was born in"),
    ("headquartered_in", "is headquartered in"),
    ("married_to", "is married to"),
    ("acquired", "acquired"),
    ("subsidiary_of", "is a subsidiary of"),
    ("speaks", "speaks"),
)
PAST_ROLES = tuple((relation, f"was the {role} of") for relation, role in ROLES)
NEGATIONS = ("not", "no", "never", "denied", "refuted", "isn't", "wasn't", "disputes", "denies")
MODAL = {"may": "hypothetical", "might": "hypothetical", "allegedly": "reported", "reportedly": "reported", "rumor": "reported", "plans to": "hypothetical", "will be": "hypothetical", "according to": "reported"}
WINDOW = 6


def sentences(text: Column) -> Column:
    return F.split(text, "[;.]\\s*|, then |, subsequently ")


def extract(texts: DataFrame, id_col: str = "rid", text_col: str = "text") -> DataFrame:
    """(id, src, rel_type, dst, polarity, modality, past) of every claim that a sentence states."""
    s = texts.select(F.col(id_col).alias("id"), F.explode(sentences(F.col(text_col))).alias("s"))
    out = None
    for past, patterns in ((False, PATTERNS), (True, PAST_ROLES)):
        for relation, phrase in patterns:
            first, *rest = phrase.split(" ")
            verb = " ".join([first, *rest]) if not rest else f"{first} {_HEDGE}{' '.join(rest)}"
            pattern = f"({_NAME}) {_HEDGE}{verb} ({_NAME})"
            hit = s.where(F.col("s").rlike(pattern)).select(
                "id", F.regexp_extract("s", pattern, 1).alias("src"), F.lit(relation).alias("rel_type"),
                F.regexp_extract("s", pattern, 2).alias("dst"), F.lit(past).alias("past"),
                F.split(F.lower(F.regexp_extract("s", f"^(.*?){_NAME} {_HEDGE}{verb} {_NAME}", 0)), " ").alias("w"),
            )
            out = hit if out is None else out.unionByName(hit)
    # A role in apposition: the organization's, then the person.
    for relation, role in ROLES:
        pattern = f"({_NAME})['’]s {role}, ({_NAME})"
        out = out.unionByName(
            s.where(F.col("s").rlike(pattern)).select(
                "id", F.regexp_extract("s", pattern, 2).alias("src"), F.lit(relation).alias("rel_type"), F.regexp_extract("s", pattern, 1).alias("dst"),
                F.lit(False).alias("past"), F.split(F.lower(F.regexp_extract("s", f"^(.*?)({_NAME})['’]s {role}, {_NAME}", 0)), " ").alias("w"),
            )
        )
    # The window ends before the object's name.
    near = F.slice(F.col("w"), F.greatest(F.lit(1), F.size("w") - F.size(F.split("dst", " ")) - (WINDOW + 2)), WINDOW + 3)
    out = out.withColumn("near", near)
    modality = F.lit("asserted")
    for cue, value in MODAL.items():
        # A cue of several words is looked for among the window's words in sequence.
        said = F.concat(F.lit(" "), F.array_join("near", " "), F.lit(" "))
        modality = F.when(said.contains(f" {cue} "), value).otherwise(modality)
    negative = F.arrays_overlap("near", F.array(*map(F.lit, NEGATIONS)))
    return out.select("id", "src", "rel_type", "dst", F.when(negative, -1).otherwise(1).alias("polarity"), modality.alias("modality"), "past")
