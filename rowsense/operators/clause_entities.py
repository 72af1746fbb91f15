"""All that the clauses of notes state, in one pass: negations and hedges, doses, drugs (known ones, and unknown ones by their
endings), directives, other numbers.

Spark cuts texts into clauses; in Arrow batches each clause's entries of the lexicon are found in one walk of an Aho-Corasick
automaton, and only entities become rows. Places are then taken longest entry first over the clause, not leftmost first: an entry that lies
in a place already taken is lost. Doses and numbers are patterns; numbers within doses don't count.

Defined results: null, empty and blank texts state nothing; equal rows give equal rows; further columns stay as they are."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lexicon import MEDICAL, SUFFIXES, VERBS, Lexicon
from . import entities, notes

ENTITY = "place int, type string, raw string, start int, end int, finding string, polarity string, strength double, amount string, upper string, dimension string, frequency string, drug string, kind string, direction string, unit string"
FIELDS = tuple(f.split()[0] for f in ENTITY.split(", "))
ARROW = [pa.field(f.split()[0], {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[f.split()[1]]) for f in ENTITY.split(", ")]
#: Entities of a batch that goes back to Spark.
ROWS = 8192
#: Blanks and joints around a finding; English words that may be drugs; stretches of Chinese; numbers and their units.
STRIP = " \t\n\r\f\v　 ,，、的"
EN_WORD, ZH_RUN = re.compile(r"[A-Za-z][A-Za-z-]*[A-Za-z]"), re.compile(r"[一-鿿]{3,}")
NUMBER, UNIT = re.compile(r"[0-9]+(?:[.,][0-9]+)?"), re.compile(r"\s*([%a-zA-Z一-鿿]+)")


class Reader:
    """A lexicon's automata and patterns, for clauses of both languages."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.dose = notes.dose_pattern(lexicon.units)
        self.automata = {lang: self.automaton(lang) for lang in ("en", "zh")}

    def automaton(self, lang: str) -> ahocorasick.Automaton:
        """Each needle with all that it stands for: what, its place in its list, and the entry."""
        held: dict[str, list] = {}
        lex, low = self.lexicon, (str.lower if lang == "en" else str)
        for order, m in enumerate(lex.markers):
            if m[1] == lang:
                held.setdefault(low(m[0]), []).append(("negation", order, m))
        for order, (form, drug) in enumerate(lex.drugs):
            held.setdefault(low(form), []).append(("drug", order, drug))
        for order, f in enumerate(lex.frequencies):
            held.setdefault(low(f), []).append(("frequency", order, f))
        for order, m in enumerate(lex.directives):
            if m[1] == lang:
                held.setdefault(low(m[0]), []).append(("directive", order, m))
        out = ahocorasick.Automaton()
        for needle, entries in held.items():
            out.add_word(needle, (needle, entries))
        out.make_automaton()
        return out

    def places(self, low: str, lang: str) -> dict[str, list]:
        """By what is found: (-length, order in the list, start, end, entry), longest first."""
        out: dict[str, list] = {"negation": [], "drug": [], "frequency": [], "directive": []}
        for last, (needle, entries) in self.automata[lang].iter(low):
            for what, order, entry in entries:
                out[what].append((-len(needle), order, last + 1 - len(needle), last + 1, entry))
        for found in out.values():
            found.sort(key=lambda x: x[:3])
        return out

    def frequency(self, clause: str, low: str, lang: str, places: list) -> str | None:
        """The longest token: as it is written, or in any case between word edges where it is ASCII and the clause English."""
        for _, _, a, b, token in places:
            if lang == "en" and re.fullmatch(r"[a-zA-Z0-9/]+", token):
                if not (touches(low, a - 1, "_") or touches(low, b, "_")):
                    return token
            elif clause[a:b] == token:
                return token
        return None

    def read(self, clause: str, lang: str) -> Iterator[dict]:
        lex, low = self.lexicon, clause.lower() if lang == "en" else clause
        places = self.places(low, lang)
        for a, b, (_, _, polarity, strength, before) in free(low, lang, places["negation"], whole_edges=True):
            yield {"type": "negation", "raw": clause[a:b], "start": a, "end": b, "finding": (clause[:a] if before else clause[b:]).strip(STRIP), "polarity": polarity, "strength": float(strength)}
        often = self.frequency(clause, low, lang, places["frequency"])
        doses = notes.doses_in(clause, self.dose, lex.units)
        for d in doses:
            yield {"type": "dosage", **d, "frequency": often}
        drugs: dict[str, dict] = {}
        used = []
        for a, b, drug in free(low, lang, places["drug"], whole_edges=False):
            used.append((a, b))
            drugs.setdefault(drug, {"type": "drug", "raw": clause[a:b], "start": a, "end": b, "drug": drug})
        named = [*drugs.values(), *self.unknown(clause, lang, used, bool(doses or often))]
        yield from named
        # Most clauses have none of what a directive begins with.
        if places["directive"] or (notes.STOP_MEDICINE if lang == "zh" else notes.HALVE).search(low):
            for d in notes.directives_in(clause, lang, [{"raw": d["raw"], "id": d["drug"]} for d in named], lex.directives, lex.inversions, lex.monitored, lex.referents):
                yield {"type": "imperative", **d}
        for m in NUMBER.finditer(clause):
            if all(m.end() <= d["start"] or m.start() >= d["end"] for d in doses):
                unit = UNIT.match(clause, m.end())
                yield {"type": "number", "raw": m[0], "start": m.start(), "end": m.end(), "amount": m[0].replace(",", ""), "unit": unit[1] if unit else None}

    def unknown(self, clause: str, lang: str, used: list[tuple[int, int]], told: bool) -> Iterator[dict]:
        """Words that end as drugs do, in a clause of medicines, away from known ones."""
        if not (told or re.search(MEDICAL[lang], clause, re.I)):
            return
        for m in (EN_WORD if lang == "en" else ZH_RUN).finditer(clause):
            a, b = m.span()
            verb = re.match(VERBS, m[0]) if lang == "zh" else None
            start = a + (verb.end() if verb else 0)
            if all(b <= s or a >= e for s, e in used) and b - start > 2 and re.search(SUFFIXES[lang], clause[start:b], re.I):
                used.append((start, b))
                yield {"type": "drug", "raw": clause[start:b], "start": start, "end": b, "drug": None}


def touches(low: str, i: int, more: str = "") -> bool:
    return 0 <= i < len(low) and (low[i].isascii() and low[i].isalnum() or low[i] in more)


def free(low: str, lang: str, places: list, whole_edges: bool) -> Iterator[tuple]:
    """Places that no longer entry has taken. In English no letter or digit may touch an entry, with whole_edges its own outer
    letters and digits. The search for an entry goes on behind each of its places."""
    used: list[tuple[int, int]] = []
    behind: dict[int, int] = {}
    for _, order, a, b, entry in places:
        if a < behind.get(order, 0):
            continue
        behind[order] = b
        if any(a < e and b > s for s, e in used):
            continue
        if lang == "en":
            edges = [i for i in range(a, b) if touches(low, i)] if whole_edges else [a, b - 1]
            if edges and (touches(low, edges[0] - 1) or touches(low, edges[-1] + 1)):
                continue
        used.append((a, b))
        yield a, b, entry


def of_clauses(texts: DataFrame, text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """texts, clause (its number from 0), lang, and ENTITY of each entity. A text without entities has no row."""

    body = F.coalesce(F.col(text), F.lit(""))
    cut = texts.select("*", entities.language(body).alias("lang"), entities.clauses(body).alias("_clauses"))
    kept = [c for c in cut.columns if c != "_clauses"]
    schema = StructType([*(cut.schema[c] for c in kept), *StructType.fromDDL(f"clause int, {ENTITY}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon) if lexicon else standard()
        for batch in batches:
            at: list[int] = []
            found: list[tuple] = []

            def rows(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                whose = pa.array(at, pa.int64())
                new = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int32(), *(f.type for f in ARROW)], strict=True)]
                return pa.RecordBatch.from_arrays([*(batch.column(c).take(whose) for c in kept), *new], names=[*kept, "clause", *FIELDS])

            lists = batch.column("_clauses")
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                for n, clause in enumerate(lists[i].as_py()):
                    for place, e in enumerate(reader.read(clause, lang)):
                        e["place"] = place
                        at.append(i)
                        found.append((n, *map(e.get, FIELDS)))
                if len(at) >= ROWS:
                    yield rows()
                    at, found = [], []
            if at:
                yield rows()

    return cut.mapInArrow(run, schema)


@lru_cache(1)
def standard() -> Reader:
    """One for each worker process, which Spark uses again."""
    return Reader(Lexicon())


def immutable_key(type_: Column, finding: Column, drug: Column, raw: Column, amount: Column, dimension: Column) -> Column:
    """What a translation must keep: a negation by its finding, a drug by its id or else its name, a dose by amount and dimension;
    null for directives and numbers."""
    whole = lambda c: F.coalesce(c, F.lit(""))
    negation, dose = F.concat(F.lit("neg:"), whole(finding)), F.concat(F.lit("dose:"), whole(amount), F.lit(":"), whole(dimension))
    return F.when(type_ == "negation", negation).when(type_ == "drug", F.coalesce(F.concat(F.lit("drug:"), drug), F.concat(F.lit("drug:?:"), raw))).when(type_ == "dosage", dose)


def clause_entities(texts: DataFrame, text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """of_clauses with immutable_key and whether losing it is of high risk (negations and drugs)."""
    found = of_clauses(texts, text, lexicon)
    key = immutable_key(*(F.col(c) for c in ("type", "finding", "drug", "raw", "amount", "dimension")))
    return found.withColumn("immutable_key", key).withColumn("high_risk", F.col("type").isin("negation", "drug"))


def contained(text: Column, lang: Column, terms: Iterable[tuple[str, Iterable[str], Iterable[str]]]) -> list[Column]:
    """Per name (with Chinese and English terms): whether the text holds one, English in any case."""
    low = F.lower(text)
    holds = lambda c, words: F.coalesce(c.rlike("|".join(rf"\Q{w}\E" for w in words)), F.lit(False))
    return [F.when(lang == "zh", holds(text, zh)).otherwise(holds(low, en)) for _, zh, en in terms]


def supplemental(text: Column, lang: Column, drugs: Iterable[tuple[str, Iterable[str], Iterable[str]]]) -> Column:
    """Ids of further drugs that the text holds as substrings."""
    drugs = list(drugs)
    held = contained(text, lang, drugs)
    return F.array_compact(F.array(*(F.when(h, F.lit(name)) for h, (name, _, _) in zip(held, drugs, strict=True))))
