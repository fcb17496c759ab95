"""Interfaces to embedding, translation and generation models, with fallbacks and offline defaults. There are no models
here: a caller brings them, one object a worker, and Spark calls them by batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from marketlens.operators import retrieval

PASSAGE, QUERY = "passage: ", "query: "


class Embedder(Protocol):
    """Vectors of texts in order. ``version`` tells stored vectors of different models apart."""

    version: str

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class Translator(Protocol):
    provider: str

    def translate(self, text: str) -> str: ...


class Generator(Protocol):
    provider: str

    def generate(self, messages: list[dict[str, str]]) -> str: ...


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 as 32-bit floats; zero rows stay."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norms > 0, norms, 1.0)).astype(np.float32)


def embed_documents(docs: DataFrame, load: Callable[[], Embedder], text: str = "document_text", out: str = "embedding", prefix: str = PASSAGE, batch: int = 32) -> DataFrame:
    """``docs`` with the unit vector of each text behind its prefix; null texts have none. ``load`` is called once a task,
    on the worker, so a model never travels."""
    schema = StructType([*docs.schema.fields, StructField(out, ArrayType(FloatType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = load()
        for rows in batches:
            texts = rows.column(text).to_pylist()
            there = [k for k, t in enumerate(texts) if t is not None]
            made: list[list[float] | None] = [None] * len(texts)
            for a in range(0, len(there), batch):
                some = there[a : a + batch]
                for k, v in zip(some, normalised(np.asarray(model.embed([prefix + texts[k] for k in some]), float)), strict=True):
                    made[k] = v.tolist()
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(made, pa.list_(pa.float32()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def embed_offline(text: Column, prefix: str = PASSAGE, dims: int = 128) -> Column:
    """The default where no model is given: hashed words, by built-in functions only."""
    return retrieval.embed_hashed(F.concat(F.lit(prefix), text), dims)


@dataclass
class Fallback:
    """Calls the first backend and, where it fails, the next; keeps which one answered and the first error."""

    backends: Sequence[Callable[[object], str]]
    names: Sequence[str]
    last: str | None = None
    error: str | None = None

    def __call__(self, asked: object) -> str:
        self.error = None
        for name, call in zip(self.names, self.backends, strict=True):
            try:
                made = call(asked)
            except Exception as e:  # noqa: BLE001  any backend failure asks the next
                self.error = self.error or f"{name}: {e}"
                continue
            self.last = name
            return made
        raise RuntimeError(self.error or "no backend")


@dataclass
class Measured:
    """A generator whose calls are timed, with the tokens that it says it used."""

    call: Callable[[list[dict[str, str]]], str]
    usage: Callable[[], dict[str, int]] = dict
    seconds: list[float] = field(default_factory=list)
    tokens: list[dict[str, int]] = field(default_factory=list)

    def __call__(self, messages: list[dict[str, str]]) -> str:
        began = time.perf_counter()
        try:
            return self.call(messages)
        finally:
            self.seconds.append(time.perf_counter() - began)
            self.tokens.append(dict(self.usage()))


class Lifecycle:
    """Models by name, loaded when first asked for; ``release`` drops all but those to keep, so that a large one fits."""

    def __init__(self, **loaders: Callable[[], object]):
        self.loaders, self.loaded = loaders, {}

    def get(self, name: str) -> object:
        if name not in self.loaded:
            self.loaded[name] = self.loaders[name]()
        return self.loaded[name]

    def release(self, *keep: str) -> None:
        for name in set(self.loaded) - set(keep):
            close = getattr(self.loaded.pop(name), "close", None)
            if close:
                close()


def generator_of(kind: str, factories: dict[str, Callable[[], Generator]], second: str | None = None) -> Callable[[list[dict[str, str]]], str]:
    """The configured generator, with another as fallback; ValueError for an unknown name."""
    for name in (kind, second):
        if name is not None and name not in factories:
            raise ValueError(f"unknown generator {name}")
    chosen = [kind, *([second] if second else [])]
    return Fallback([factories[n]().generate for n in chosen], chosen)


def offline_generator(messages: list[dict[str, str]]) -> str:
    """Answers nothing that can be checked, so that the deterministic fallback is used."""
    raise RuntimeError("no generation model is configured")
