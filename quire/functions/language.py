"""Language of a text by its function words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SAMPLE = 3000
LEAST = 80
# Frequent function words by language.
FUNCTION_WORDS = {
    "bg": "и на да се не от за по че това с си като ще",
    "ca": "de la el i que els les amb per una del però és",
    "da": "og i at det er en til af ikke der på med jeg var",
    "de": "der die das und ist nicht ein eine zu den mit sich auf von",
    "en": "the of and to in is that it was with for his he on",
    "es": "de la que el en y los se del las un por con una no",
    "fi": "ja on ei että se hän oli kun niin mutta ovat joka",
    "fr": "de la le et les des en un une du que est pas dans qui",
    "gr": "και το να του η της τα που με δεν στο είναι την",
    "hu": "a az és hogy nem is egy de volt ez meg csak már",
    "it": "di che e la il un a per in non una sono del con si",
    "la": "et in est non ad cum ut sed qui quod ex si per esse",
    "nl": "de het een en van ik te dat die in is niet zijn op",
    "pt": "de a o que e do da em um para não uma os com se",
    "ro": "de și în a la cu nu o pe că un să se din mai este",
    "ru": "и в не на что он с как это по но его к я все",
}
OWN = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}


def opening(body: str) -> str:
    """The first SAMPLE characters of a text, without tags and with its white space squeezed. Looks no further than it has to."""
    size = 16 * SAMPLE
    while True:
        part = body[:size]
        if size < len(body) and (tag := part.find("<", part.rfind(">") + 1)) >= 0:
            part = part[:tag]
        text = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", part)).strip()
        if len(text) > SAMPLE or size >= len(body):
            return text[:SAMPLE]
        size *= 2


def detect(raw: str) -> str | None:
    """The code of the language whose words occur most among the first SAMPLE characters of text, or None for less than LEAST."""
    body = raw.rpartition("</teiHeader>")[2]
    text = opening(body)
    if len(text) < LEAST:
        return None
    words = re.findall(r"[^\W\d_]+", text.lower())
    score = {k: sum(w in own for w in words) for k, own in OWN.items()}
    best = max(score, key=lambda k: (score[k], k == "en", k))
    return best if score[best] >= max(2, len(words) / 20) else None


def _detected(s: pd.Series) -> pd.Series:
    return s.fillna("").map(detect)


def detected(c: Column) -> Column:
    return F.pandas_udf(_detected, StringType())(c)
