"""Trigger spans: prioritised patterns over the accent-stripped text; an earlier pattern's span blocks later ones."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlens.functions.text import ACCENTED, PLAIN

# Trigger types and patterns in order of priority, matched without case.
PATTERNS = [
    ("percentage", r"\b\d+(?:[.,]\d+)?\s*(?:%|pour\s?cent|points?\s+de\s+pourcentage)"),
    ("amount", "\\b\\d+(?:[.,\\s ]\\d+)*\\s*(?:milliards?|millions?|milliers?|Md|M€|K€)?\\s*(?:d'euros|euros|€|dollars|\\$)\\b"),
    ("date_or_period", r"\b(?:depuis|en|des|avant|apres|entre)\s+(?:19|20)\d{2}\b|\b(?:19|20)\d{2}\b|\b(?:ces|les|en)\s+\w+\s+(?:dernieres?|derniers?)\s+(?:annees?|mois)\b|\bdepuis\s+\w+\s+(?:ans?|annees?|mois)\b"),
    ("superlative", r"\b(?:le|la|les)\s+(?:plus|moins)\s+\w+|\bjamais\s+(?:vu|atteint|connu)\b|\brecord\b|\bhistorique(?:ment)?\b|\bau\s+plus\s+(?:bas|haut)\b|\b(?:premier|premiere|dernier|derniere)\s+(?:pays|region|au\s+monde|d'Europe)\b"),
    ("comparative", r"\b(?:deux|trois|quatre|cinq|dix)\s+fois\s+(?:plus|moins)\b|\b(?:plus|moins)\s+(?:eleve|faible|important|nombreux)\w*\s+qu|\bpar\s+rapport\s+a\b|\bcontre\s+seulement\b|\ben\s+comparaison\b"),
    ("vague_quantifier", r"\b(?:la\s+(?:plupart|majorite)|une\s+minorite|des\s+milliers|des\s+millions|enormement|la\s+quasi-totalite|l'immense\s+majorite|beaucoup\s+(?:plus|moins)|explose|effondre|massivement)\b"),
    ("causality", r"\b(?:grace\s+a|a\s+cause\s+de|en\s+raison\s+de|c'est\s+pourquoi|cela\s+a\s+(?:permis|provoque|entraine)|responsable\s+de|a\s+conduit\s+a|du\s+fait\s+de)\b"),
    ("pledge", r"\b(?:je\s+(?:ferai|creerai|supprimerai|augmenterai|baisserai|mettrai|proposerai|vais)|nous\s+(?:allons|ferons|creerons)|mon\s+(?:projet|programme|objectif)|je\s+m'engage|des\s+(?:mon|le\s+premier)\s+\w+)\b"),
    ("attribution", r"\b(?:vous\s+avez\s+(?:dit|vote|promis|declare)|il\s+a\s+(?:dit|vote|promis)|selon\s+(?:vous|lui|elle)|votre\s+(?:bilan|gouvernement|majorite))\b"),
    ("number", "\\b\\d+(?:[.,\\s ]\\d+)*\\s*(?:milliards?|millions?|milliers?|places?|emplois?|logements?|postes?|lits?|classes?|policiers?|infirmiers?|personnes?|habitants?)\\b"),
]
#: Types that alone do not make a statement worth checking.
UNDECIDABLE = ("pledge", "vague_quantifier")
SPANS = "array<struct<type:string,text:string,start:int,end:int>>"
_TABLE = str.maketrans(ACCENTED, PLAIN)


@lru_cache(1)
def _compiled() -> list:
    return [(name, re.compile(p, re.I)) for name, p in PATTERNS]


def spans_of(text: str | None) -> list[dict]:
    text = text or ""
    flat, free, out = text.translate(_TABLE), bytearray(len(text) + 1), []
    for name, pattern in _compiled():
        for m in pattern.finditer(flat):
            if not any(free[m.start() : m.end()]):
                free[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                out.append({"type": name, "text": text[m.start() : m.end()], "start": m.start(), "end": m.end()})
    return sorted(out, key=lambda t: t["start"])


def _triggers(texts: pd.Series) -> pd.Series:
    return texts.map(spans_of)


def triggers(text: Column) -> Column:
    return F.pandas_udf(_triggers, SPANS)(text)


def deserves_verification(spans: Column) -> Column:
    return F.exists(spans, lambda t: ~t["type"].isin(*UNDECIDABLE))


def candidate(spans: Column, text: Column, degree: int) -> Column:
    return deserves_verification(spans) if degree == 1 else (F.size(spans) > 0) | (F.length(text) > 40)
