"""Plug-in points for models, with deterministic stand-ins that need no weights.

* encoder      (texts, is_query) -> float32 matrix                (``Encoder``)
* pair scorer  (query, document) pairs -> scores                  (``PairScorer``)
* list ranker  (query, documents) -> reply "[2] > [1] > ..."      (``ListRanker``)
* generator    prompt -> (text, error tag)                        (``Generator``)
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[Sequence[str], bool], np.ndarray]
PairScorer = Callable[[Sequence[tuple[str, str]]], Sequence[float]]
ListRanker = Callable[[str, Sequence[str]], str]
Generator = Callable[[str], str]

_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class ModelSpec:
    """How texts reach an encoder: what stands before a text by its role (``query`` or ``passage``), how many of
    its tokens are read (None for all), and whether vectors have unit length."""

    name: str
    dimension: int = 64
    token_limit: int | None = 512
    before: Mapping[str, str] = field(default_factory=dict)
    unit_length: bool = True


@dataclass(frozen=True)
class HashingEncoder:
    """Signed feature hashing of tokens; equal texts get equal vectors on every machine."""

    spec: ModelSpec

    def __call__(self, texts: Sequence[str], is_query: bool) -> np.ndarray:
        lead = self.spec.before.get("query" if is_query else "passage", "")
        out = np.zeros((len(texts), self.spec.dimension), dtype=np.float32)
        for row, t in zip(out, texts):
            for tok in _TOKEN.findall((lead + t).lower())[: self.spec.token_limit]:
                h = int.from_bytes(hashlib.md5(tok.encode()).digest()[:8], "little")
                row[h % self.spec.dimension] += 1.0 if h >> 63 else -1.0
        if self.spec.unit_length:
            length = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
        return out


def resolve_spec(base: ModelSpec, checkpoint: Mapping[str, object] | None = None, training: Mapping[str, object] | None = None) -> ModelSpec:
    """The spec of a tuned encoder: what its checkpoint says goes before what its training says, both before the base."""
    said = {**(training or {}), **(checkpoint or {})}
    limit = said.get("max_length", base.token_limit)
    return replace(base, name=str(said.get("output_alias") or base.name), token_limit=None if limit is None else int(limit))


def yes_no_scorer(logits: Callable[[Sequence[str]], Sequence[tuple[float, float]]], instruction: str) -> PairScorer:
    """A pair scorer from a language model that answers yes or no: ``logits`` gives for every chat text the logits of
    both words at the answer's place, the score is their difference."""

    def score(pairs: Sequence[tuple[str, str]]) -> list[float]:
        chats = [f"<Instruct>: {instruction}\n<Query>: {q}\n<Document>: {d}" for q, d in pairs]
        return [float(yes) - float(no) for yes, no in logits(chats)] if chats else []

    return score


def overlap_scorer(pairs: Sequence[tuple[str, str]]) -> list[float]:
    """Share of the query's distinct tokens that the document holds."""
    out = []
    for q, d in pairs:
        a, b = set(_TOKEN.findall(q.lower())), set(_TOKEN.findall(d.lower()))
        out.append(len(a & b) / len(a) if a else 0.0)
    return out


def overlap_ranker(query: str, documents: Sequence[str]) -> str:
    scores = overlap_scorer([(query, d) for d in documents])
    order = sorted(range(len(documents)), key=lambda i: (-scores[i], i))
    return " > ".join(f"[{i + 1}]" for i in order)


def encode(texts: DataFrame, encoder: Encoder, is_query: bool, id_col: str = "doc_id") -> DataFrame:
    """(id, embedding); the encoder is loaded once per task and sees whole Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = encoder([t or "" for t in pdf["text"]], is_query)
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": list(vectors)})

    return texts.select(F.col(id_col).cast("string"), "text").mapInPandas(run, f"{id_col} string, embedding array<float>")


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of unmasked token states; an empty mask divides by one."""
    m = mask.astype(states.dtype)[..., None]
    return (states * m).sum(axis=-2) / np.maximum(m.sum(axis=-2), 1)


def first_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return states[..., 0, :]


class Refused(Exception):
    """Raised by a generator whose content filter stopped the answer."""


def generate(
    prompts: DataFrame, generator: Generator, attempts: int = 5, wait: Callable[[float], None] = time.sleep, at_once: int = 8
) -> DataFrame:
    """(qid, expansion, error) for ``prompts`` (qid, prompt): at most ``at_once`` calls of a task run side by
    side; retries with growing pauses, at most a minute; a filtered prompt gives an empty answer and a
    tag, the last failure gives its name."""

    def ask(prompt: str) -> tuple[str, str | None]:
        error = None
        for n in range(attempts):
            try:
                return generator(prompt) or "", None
            except Refused:
                return "", "content_filter"
            except (TimeoutError, ConnectionError) as e:
                error = type(e).__name__
                if n + 1 < attempts:
                    wait(min(60.0, 2.0**n))
        return "", error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            for pdf in batches:
                answers = list(pool.map(ask, pdf["prompt"]))
                yield pd.DataFrame({"qid": pdf["qid"], "expansion": [a[0] for a in answers], "error": [a[1] for a in answers]})

    return prompts.select("qid", "prompt").mapInPandas(run, "qid string, expansion string, error string")
