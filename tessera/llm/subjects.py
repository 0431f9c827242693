"""Subject areas of documents by weighted terms and a multi-pattern automaton.

The lexicon is curated by rule, not typed in.  Seeds are the terms of the scope notes.  In a bounded
sample of hand-labelled documents every sentence or list item that holds seeds of exactly one area
belongs to that area; phrases that occur (almost) only in units of one area become its terms, and a
second round starts from those terms.  Occurrences are counted as the automaton will find them, so a
fragment that also lives inside other areas' words is refused.

Scoring: every unit (sentence or list item) of every document is matched once by one Aho-Corasick
automaton; a term weighs its rarity, ln(units / units with the term) over all documents; an area's score is the sum of
its terms' weights divided by 1 + ln(1 + unit length in words).  A unit is about an area whose score
reaches the threshold and holds the required share of all areas' weights.  A document deals with
every area that at least ``min_units`` of its units are about.  The threshold is calibrated on the
labelled sample.

Defined results for odd input: null and empty texts deal with nothing; texts are scanned whole;
labels with unknown areas or null ids are ignored; repeated documents give repeated results once per
row id; without labels the seeds alone are the lexicon; empty tables give an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Bound of the labelled sample the lexicon and the threshold are fitted on (documents).
MAX_SAMPLE = 3000

# Words that neither begin nor end a term.
STOP = frozenset(
    "a an the of for to in on at by and or with shall may must is are be been has have had not can cannot need where when if"
    " unless any every all its this that these those as from before after within per cent up under into no such which who whose"
    " it each other than between without against during except also only so more most out over".split()
)

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
UNIT = re.compile(
    r"[\r\n\t\v\f\u2028\u2029]+|(?<=[.!?])\s+(?=[\"'“‘(\[]?[^\W\d_a-z])|(?<=[。！？])|\s*[;；|｜•・◦‣]\s+|[;；]|\s[|｜/／]\s"
)
_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_CJK = re.compile(r"[㐀-鿿々ァ-ヿ゠ー・]+")
_SEGMENT = re.compile(r"[^\s、。・「」（）()|,.:：;!?！？のにをはがともへやで]+")
_SCRIPT = re.compile(r"[㐀-鿿ぁ-ヿ]")


def units_of(text: str) -> list[str]:
    """Sentences and list items of a text, markup taken as a break between them.

    A line without sentence punctuation whose parts are separated by commas is a keyword list."""
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    out = []
    for unit in UNIT.split(text):
        unit = " ".join(unit.split()) if unit else ""
        if not unit:
            continue
        if "、" in unit and "。" not in unit and not _CLAUSE_MARK.search(unit):
            out.extend(x for x in unit.split("、") if x.strip())
        elif ", " in unit and not _CLAUSE_WORD.search(unit) and not unit.rstrip().endswith("."):
            out.extend(x for x in unit.split(", ") if x.strip())
        else:
            out.append(unit)
    return out


#: What a clause has and an enumeration of terms lacks.
_CLAUSE_MARK = re.compile(r"[をがは]")
_CLAUSE_WORD = re.compile(r"\b(?:shall|may|must|is|are|has|have|need|can|cannot|applies|counts)\b", re.I)


def _phrases(unit: str) -> set[str]:
    """Candidate terms of a lower-cased unit: word sequences of up to four, or script runs."""
    out: set[str] = set()
    if _SCRIPT.search(unit):
        out.update(x for x in _CJK.findall(unit) if len(x) > 1)
        out.update(x for x in _SEGMENT.findall(unit) if 1 < len(x) <= 16 and _SCRIPT.search(x))
        return out
    # only words with nothing but one blank between them form a phrase: it must be found literally
    for run in re.split(r"[^\w\s'’-]|\d+|\s{2,}", unit):
        words = _WORD.findall(run)
        for n in range(1, 5):
            for i in range(len(words) - n + 1):
                if words[i] not in STOP and words[i + n - 1] not in STOP:
                    out.add(" ".join(words[i : i + n]))
    return {x for x in out if len(x) > 2}


def seeds_of(areas: list[dict]) -> dict[str, str]:
    """term -> area from the scope notes (both languages)."""
    out = {}
    for a in areas:
        for note, sep in (("scope_note_en", ","), ("scope_note_ja", "、")):
            for term in (a.get(note) or "").split(sep):
                if term.strip():
                    out[term.strip().lower()] = a["subject_area"]
    return out


def _boundaries_hold(text: str, start: int, end: int, term: str) -> bool:
    """Words must be whole; terms of scripts without blanks may stand anywhere."""
    if not term[0].isascii():
        return True
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


class Matcher:
    """One automaton over all terms; the longest term wins where terms overlap."""

    def __init__(self, terms: dict[str, tuple[str, float]]):
        import ahocorasick

        self.terms = terms
        self._automaton = ahocorasick.Automaton()
        for t in terms:
            self._automaton.add_word(t, t)
        self._ready = bool(terms)
        if self._ready:
            self._automaton.make_automaton()

    def _spans(self, lowered: str) -> list[tuple[int, int, str]]:
        if not self._ready:
            return []
        spans = []
        for last, term in self._automaton.iter(lowered):
            start = last + 1 - len(term)
            if _boundaries_hold(lowered, start, last + 1, term):
                spans.append((start, last + 1, term))
        return spans

    def both(self, lowered: str) -> tuple[set[str], set[str]]:
        """``find`` and ``every`` of a lower-cased unit in one scan."""
        spans = self._spans(lowered)
        every = {s[2] for s in spans}
        if len(spans) < 2:
            return every, every
        spans.sort(key=lambda s: (s[0], -s[1]))
        out, reach = set(), -1
        for start, end, term in spans:
            if end > reach:
                out.add(term)
                reach = end
        return out, every

    def find(self, lowered: str) -> set[str]:
        """The terms of a lower-cased unit that are not part of a longer matched term."""
        return self.both(lowered)[0]

    def every(self, lowered: str) -> set[str]:
        """All terms of a lower-cased unit, overlapping ones included."""
        return {s[2] for s in self._spans(lowered)}


@dataclass(frozen=True)
class SubjectModel:
    terms: dict[str, tuple[str, float]]
    threshold: float = 0.0
    share: float = 0.5
    min_units: int = 2


def _single(scores: dict[str, float]) -> str | None:
    """The area that holds at least nine tenths of the weight, if there is one."""
    total = sum(scores.values())
    if not total:
        return None
    area, best = max(scores.items(), key=lambda x: (x[1], x[0]))
    return area if best >= 0.9 * total else None


def learn_terms(
    units: list[str], seeds: dict[str, str], rounds: int = 2, least: int = 3, purity: float = 0.92
) -> dict[str, tuple[str, float]]:
    """term -> (area, rarity) from lower-cased units; seeds are always kept."""
    known: dict[str, tuple[str, float]] = {t: (a, 1.0) for t, a in seeds.items()}
    phrases = [_phrases(u) for u in units]
    held = Counter(p for ps in phrases for p in ps)
    candidates = {p for p, n in held.items() if n >= least}
    everything = Matcher({p: ("", 1.0) for p in candidates | set(seeds)})
    found = [everything.every(u) for u in units]
    total = Counter(t for ts in found for t in ts)
    n_units = max(2, len(units))
    for r in range(rounds):
        by_area: dict[str, Counter] = defaultdict(Counter)
        for ts in found:
            scores: dict[str, float] = {}
            for t in ts:
                if t in known:
                    area, w = known[t]
                    scores[area] = scores.get(area, 0.0) + w
            area = _single(scores)
            if area:
                for t in ts:
                    by_area[t][area] += 1
        fresh = {}
        for t, counts in by_area.items():
            inside = sum(counts.values())
            area, most = counts.most_common(1)[0]
            # a subject word stands mostly in units of its area; a general word mostly elsewhere
            enough = inside >= (0.08 if r == 0 else 0.5) * total[t]
            if inside >= least and most >= purity * inside and enough:
                fresh[t] = (area, math.log(n_units / total[t]) if total[t] < n_units else 0.01)
        known = _without_fragments(fresh, total)
        for t, a in seeds.items():
            known.setdefault(t, (a, math.log(n_units / max(1, total[t]))))
    return known


def _without_fragments(terms: dict[str, tuple[str, float]], total: Counter) -> dict[str, tuple[str, float]]:
    """Drops word fragments that (almost) only occur inside one longer term, and rare extensions of terms."""
    longer: dict[str, int] = defaultdict(int)
    extends: set[str] = set()
    for t in terms:
        words = t.split(" ")
        parts = (
            {" ".join(words[i : i + n]) for n in range(1, len(words)) for i in range(len(words) - n + 1)}
            if t[0].isascii()
            else {t[i:j] for i in range(len(t)) for j in range(i + 2, len(t) + 1) if j - i < len(t)}
        )
        for p in parts:
            if p in terms:
                longer[p] = max(longer[p], total[t])
                if total[t] < 0.3 * total[p]:
                    extends.add(t)
    return {t: v for t, v in terms.items() if longer[t] < 0.9 * total[t] and t not in extends}


def _norm(lowered: str) -> float:
    length = len(lowered) / 2 if _SCRIPT.search(lowered) else lowered.count(" ") + 1
    return 1.0 + math.log1p(length)


def _strong_areas(found: Iterable[tuple[str, float]], norm: float, share: float) -> list[tuple[str, float]]:
    """(area, score) of the areas that hold the share of a unit's weight; ``found``: (area, weight) of its terms."""
    scores: dict[str, float] = {}
    for area, weight in found:
        scores[area] = scores.get(area, 0.0) + weight
    total = sum(scores.values())
    return [(a, s / norm) for a, s in scores.items() if s >= share * total]


def calibrate(texts: list[str], labels: list[set[str]], terms: dict[str, tuple[str, float]], share: float, min_units: int) -> float:
    """The smallest threshold whose F1 against the hand labels is within 0.002 of the best."""
    matcher = Matcher(terms)
    scored = []
    for t in texts:
        rows = []
        for u in units_of(t):
            lowered = u.lower()
            found = sorted(matcher.find(lowered))
            rows.extend(_strong_areas([terms[x] for x in found], _norm(lowered), share))
        scored.append(rows)
    grid = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.25, 1.5, 2.0]
    result = []
    for threshold in grid:
        tp = fp = fn = 0
        for rows, truth in zip(scored, labels):
            counts = Counter(a for a, x in rows if x >= threshold)
            got = {a for a, n in counts.items() if n >= min_units}
            tp, fp, fn = tp + len(got & truth), fp + len(got - truth), fn + len(truth - got)
        result.append(2 * tp / max(1, 2 * tp + fp + fn))
    best = max(result)
    return next(t for t, f in zip(grid, result) if f >= best - 0.002)


def _rates(counts: dict[str, int], most: int) -> dict[str, float]:
    """area -> share of its documents to draw: equal numbers of each, what small areas leave goes to the larger."""
    left, quota = float(most), 0.0
    for i, n in enumerate(sorted(counts.values())):
        quota = left / (len(counts) - i)
        left -= min(n, quota)
    return {a: min(1.0, quota / n) for a, n in counts.items()}


def _sampled(labelled: DataFrame, max_sample: int) -> DataFrame:
    """At most about ``max_sample`` rows of (doc_id, areas), drawn per area by a hash of the id."""
    if labelled.count() <= max_sample:
        return labelled
    counts = {r["area"]: r["count"] for r in labelled.select(F.explode("areas").alias("area")).groupBy("area").count().collect()}
    rate = F.greatest(F.lit(0.0), *[F.when(F.array_contains("areas", a), F.lit(x)).otherwise(F.lit(0.0)) for a, x in sorted(_rates(counts, max_sample).items())])
    return labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_003)) < rate * 1_000_003)


def _fit(documents: DataFrame, labels: DataFrame, areas: DataFrame, max_sample: int, share: float, min_units: int) -> tuple[SubjectModel, DataFrame]:
    """The model and the matched units of all documents, which it takes its weights from."""
    area_rows = [r.asDict() for r in areas.where("subject_area is not null").collect()]
    names = sorted({r["subject_area"] for r in area_rows})
    clean = (
        labels.select("doc_id", F.lower(F.trim("subject_area")).alias("area"))
        .where(F.col("doc_id").isNotNull() & F.col("area").isin(names))
        .groupBy("doc_id")
        .agg(F.collect_set("area").alias("areas"))  # at most one entry per area
    )
    rows = (
        documents.select("doc_id", "text")
        .where("text is not null")
        .join(_sampled(clean, max_sample), "doc_id")
        .select("doc_id", "text", "areas")
        .orderBy("doc_id")
        .collect()
    )
    texts, truth = [r["text"] for r in rows], [set(r["areas"]) for r in rows]
    units = [u.lower() for t in texts for u in units_of(t)]
    terms = learn_terms(units, seeds_of(area_rows))
    matched = materialize(matched_units(documents, list(terms)))
    terms = _with_rarity(terms, matched)
    return SubjectModel(terms, calibrate(texts, truth, terms, share, min_units) if texts else 0.0, share, min_units), matched


def fit_subjects(
    documents: DataFrame,
    labels: DataFrame,
    areas: DataFrame,
    max_sample: int = MAX_SAMPLE,
    share: float = 0.5,
    min_units: int = 2,
) -> SubjectModel:
    """Fits lexicon and threshold on at most about ``max_sample`` labelled documents, drawn per area by a hash
    of their id, and takes the weights from all documents.  The areas and the sample are small by construction
    and are collected."""
    return _fit(documents, labels, areas, max_sample, share, min_units)[0]


def matched_units(documents: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n_units, held, norms, found) of every text, terms as places in ``terms``: ``held`` has a term once
    for each unit with it, ``norms`` and ``found`` have the units with terms."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)  # bounded: learned from a bounded sample
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("held", ints), ("norms", pa.list_(pa.float64())), ("found", pa.list_(ints))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher({t: ("", 1.0) for t in shared.value})
        place = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units, held, norms, found = units_of(text), [], [], []
                for unit in units:
                    lowered = unit.lower()
                    longest, every = matcher.both(lowered)
                    if every:
                        held.extend(place[t] for t in every)
                        norms.append(_norm(lowered))
                        found.append([place[t] for t in sorted(longest)])
                rows.append((key, len(units), held, norms, found))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    narrow = documents.select(F.col("doc_id").cast("long"), "text").where("text is not null and text <> ''")
    return narrow.mapInArrow(run, "doc_id bigint, n_units bigint, held array<int>, norms array<double>, found array<array<int>>")


def _with_rarity(terms: dict[str, tuple[str, float]], matched: DataFrame) -> dict[str, tuple[str, float]]:
    """``terms`` weighed by their rarity among the units of all documents; one number per term is collected."""
    n_units = max(2, matched.agg(F.coalesce(F.sum("n_units"), F.lit(0))).first()[0])
    total = dict(matched.select(F.explode("held").alias("term")).groupBy("term").count().collect())
    return {t: (area, max(0.01, math.log(n_units / max(1, total.get(i, 0))))) for i, (t, (area, _)) in enumerate(terms.items())}


def _assign(matched: DataFrame, model: SubjectModel) -> DataFrame:
    shared = matched.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("subject_area", pa.string()), ("n_units", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = list(m.terms.values())
        for batch in batches:
            ids, areas, counts = [], [], []
            for key, norms, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                units: Counter = Counter()
                for norm, places in zip(norms, found):
                    units.update(a for a, x in _strong_areas([weights[p] for p in places], norm, m.share) if x >= m.threshold)
                for area, n in units.items():
                    if n >= m.min_units:
                        ids.append(key)
                        areas.append(area)
                        counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(areas, pa.string()), pa.array(counts, pa.int32())], schema=schema
            )

    return matched.select("doc_id", "norms", "found").mapInArrow(run, "doc_id bigint, subject_area string, n_units int")


def assign_subjects(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """(doc_id, subject_area, n_units) for every area a document deals with."""
    return _assign(matched_units(documents, list(model.terms)), model)


def fit_and_assign(documents: DataFrame, labels: DataFrame, areas: DataFrame, max_sample: int = MAX_SAMPLE, share: float = 0.5, min_units: int = 2) -> DataFrame:
    """``assign_subjects`` of the documents the model is fitted on; every text is matched once."""
    model, matched = _fit(documents, labels, areas, max_sample, share, min_units)
    return _assign(matched, model)


def composition(assigned: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject_area, n_documents, n_units, share_of_documents): the corpus by area, 'none' included."""
    total = documents.agg(F.count(F.lit(1)).alias("n_total"))
    by_area = assigned.groupBy("subject_area").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_units").alias("n_units")
    )
    some = assigned.agg(F.countDistinct("doc_id").alias("n_some"))
    none = total.join(F.broadcast(some)).select(  # one row beside one row
        F.lit("none").alias("subject_area"),
        (F.col("n_total") - F.col("n_some")).alias("n_documents"),
        F.lit(0).cast("long").alias("n_units"),
    )
    return (
        by_area.unionByName(none)
        .join(F.broadcast(total))
        .select("subject_area", "n_documents", "n_units", (F.col("n_documents") / F.col("n_total")).alias("share_of_documents"))
    )
