"""Emergencies that a text speaks of, by category.

All terms of all categories and both languages are one automaton: a walk over a text sets a bit for each group of terms that it
meets, and a category holds where one of its patterns has all its bits. Negation isn't read: a false alarm is borne, a missed
one isn't.

Defined results: null and empty texts have no category; categories come once, in the lexicon's order."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import plain

# Category, whether it keeps the model from answering, and patterns by language: bars part terms, plus signs groups
# of which all must be met, semicolons patterns.
CATEGORIES = [
    ("cardiac", False, "胸痛|胸口痛|心绞痛;胸闷+出汗|放射", "chest pain|crushing chest|pain radiating to arm|pain radiating to jaw;chest tightness+sweat|sweating|radiating|radiation"),
    ("breathing", False, "呼吸困难|喘不上气|窒息", "can't breathe|difficulty breathing|gasping"),
    ("stroke", False, "中风|口眼歪斜|嘴歪|说话不清|半边麻木|突然看不见", "stroke|face drooping|slurred speech|one-sided weakness|one-sided numbness"),
    ("bleeding", False, "大出血|血流不止|呕血|便血不止", "severe bleeding|won't stop bleeding|vomiting blood"),
    ("anaphylaxis", False, "过敏+喉咙肿|呼吸", "throat swelling|throat closing;allergic+breathing|breathe"),
    ("self-harm", True, "自杀|想死|不想活了|轻生|自残", "kill myself|end my life|suicide|want to die|hurt myself"),
    ("overdose-poisoning", True, "服毒|吞了药|误服|过量服用", "overdose|took too many pills|swallowed poison"),
    ("unconscious", False, "昏迷|失去意识|叫不醒", "unconscious|unresponsive|won't wake up"),
    ("seizure", False, "抽搐|惊厥|抽风", "seizure|convulsing|fitting"),
    ("pregnancy-emergency", False, "孕+出血|剧痛", "pregnant|pregnancy+bleeding|severe pain"),
    ("infant-emergency", False, "婴儿+高烧|抽搐", "infant|baby+high fever|seizure"),
]
MARKS = re.compile("[’‘]")


class Groups:
    """Bits of groups of terms, and the masks of each category's patterns."""

    def __init__(self, categories: Iterable[tuple[str, bool, str, str]]) -> None:
        self.terms: dict[str, int] = {}
        self.masks: list[tuple[str, bool, list[int]]] = []
        bit = 0
        for name, suppresses, *languages in categories:
            masks = []
            for pattern in (p for told in languages for p in told.split(";") if p):
                mask = 0
                for group in pattern.split("+"):
                    mask |= 1 << bit
                    for term in group.split("|"):
                        self.terms[term.lower()] = self.terms.get(term.lower(), 0) | 1 << bit
                    bit += 1
                masks.append(mask)
            self.masks.append((name, suppresses, masks))
        if bit > 62:
            raise ValueError("more groups of terms than a number has bits")

    @property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term, bits in self.terms.items():
            out.add_word(term, (len(term), term.isascii(), bits))
        out.make_automaton()
        return out


@lru_cache(4)
def known(categories: tuple) -> tuple[Groups, ahocorasick.Automaton]:
    groups = Groups(categories)
    return groups, groups.automaton


def bits_in(text: str, automaton: ahocorasick.Automaton) -> int:
    """The bits of all terms in the text. English terms have no letter or digit beside them, others stand anywhere."""
    low, bits = MARKS.sub("'", text.lower()), 0
    near = lambda i: 0 <= i < len(low) and low[i].isascii() and low[i].isalnum()
    for last, (size, english, own) in automaton.iter(low):
        if not (english and (near(last - size) or near(last + 1))):
            bits |= own
    return bits


def groups_met(text: Column, categories: Iterable[tuple] = CATEGORIES) -> Column:
    """A bitmap of the groups of terms that a plain text (functions.text.plain) holds."""
    key = tuple(categories)

    # One text of a batch at a time becomes a Python string.
    @F.arrow_udf("long")
    def find(texts: pa.Array) -> pa.Array:
        automaton = known(key)[1]
        return pa.array((bits_in(t, automaton) if t else 0 for t in (x.as_py() for x in texts)), pa.int64())

    return find(text)


def categories_of(met: Column, categories: Iterable[tuple] = CATEGORIES) -> Column:
    """Names of the categories of groups_met, in order."""
    holds = [(name, [F.bit_count(met.bitwiseAND(F.lit(m))) == m.bit_count() for m in masks]) for name, _, masks in Groups(categories).masks]
    return F.array_compact(F.array(*(F.when(F.greatest(*hit, F.lit(False)), F.lit(name)) for name, hit in holds)))


def matched(text: Column, categories: Iterable[tuple] = CATEGORIES) -> Column:
    """Names of the categories that any text speaks of."""
    return categories_of(groups_met(plain(text), categories), categories)


def suppressing(categories: Iterable[tuple] = CATEGORIES) -> list[str]:
    """Names of the categories that keep the model from answering."""
    return [name for name, suppresses, *_ in categories if suppresses]
