"""Analyzers by language: folded words without function words, with common endings cut. Without a language: folded words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.language import FUNCTION_WORDS

# Endings that light stemming cuts, longest first, from words that keep at least four letters.
ENDINGS = {
    "ca": "aments|ament|acions|acio|ions|es|os|as|a|o|s",
    "da": "erne|ene|ede|er|en|et|e|s",
    "de": "ungen|keiten|heiten|ung|keit|heit|lich|isch|en|er|es|em|e|n|s",
    "en": "ations|ation|ingly|ments|ment|ness|ings|ing|edly|ies|ed|es|ly|s",
    "es": "aciones|amente|acion|mente|idades|idad|adas|ados|ada|ado|es|os|as|a|o|s",
    "fi": "ssa|sta|lla|lta|lle|ksi|nen|en|in|a|n",
    "fr": "issements|issement|ations|ation|ement|ments|ment|euses|euse|eux|ees|ee|es|er|e|s",
    "hu": "okat|eket|ban|ben|nak|nek|ok|ek|ak|at|et|t|k",
    "it": "azioni|azione|amente|mente|ita|are|ere|ire|e|i|a|o",
    "nl": "heden|heid|ingen|ing|en|er|e|s",
    "no": "ene|ane|ede|er|en|et|e|s",
    "pt": "acoes|amente|acao|mente|idade|adas|ados|ada|ado|es|os|as|a|o|s",
    "ro": "atiilor|atiile|urilor|urile|atie|ului|elor|ilor|ele|ile|ul|ei|le|e|a|i",
    "ru": "иями|ами|ями|ого|его|ому|ему|ыми|ими|ов|ев|ах|ях|ой|ый|ий|ая|яя|ое|ее|ые|ие|ам|ям|ом|ем|а|я|о|е|ы|и|у|ю|ь",
    "bg": "овете|ията|ове|ите|ата|ето|ът|ят|та|то|те|и|а|я|е|о",
}


def analyzed(c: Column, lang: str | None = None) -> Column:
    """The terms of a text, in order."""
    words = F.regexp_extract_all(T.fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    stop = FUNCTION_WORDS.get(lang or "")
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop.split()))
    if lang in ENDINGS:
        words = F.transform(words, lambda w: F.regexp_replace(w, rf"^(.{{4,}}?)(?:{ENDINGS[lang]})$", "$1"))
    return words
