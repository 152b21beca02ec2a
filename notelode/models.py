"""Model clients and the columns that call them.

A client is any picklable object with ``embed(texts, model)`` and ``generate(prompt, model,
options)``. ``HttpClient`` talks to a model server named by the caller; ``StandIn`` is a
deterministic replacement without a model, so that every plan can be run and checked offline.

The columns are marked nondeterministic, so Spark does not copy a call into a pushed-down filter.
They hold a value and an error: a call that fails never ends the job of the other rows. Give a call
a column of its own (``ask`` does) and settle it before anything is measured or read twice.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.lineage import cut

ATTEMPTS = 3


class ModelClient(Protocol):
    def embed(self, texts: list[str], model: str) -> list[list[float]]: ...

    def generate(self, prompt: str, model: str, options: Mapping[str, Any]) -> str: ...


@dataclass(frozen=True)
class HttpClient:
    """JSON over HTTP: ``/api/embed`` and ``/api/generate`` below ``url``."""

    url: str
    timeout: float = 600.0

    def _post(self, path: str, payload: dict) -> dict:
        request = urllib.request.Request(
            self.url.rstrip("/") + path,
            data=json.dumps(payload).encode("utf-8"),
            headers={"Content-Type": "application/json"},
        )
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                return json.loads(response.read())
        except urllib.error.HTTPError as error:
            detail = error.read().decode("utf-8", "replace")
            raise RuntimeError(f"{path} failed: {error.code} {detail}") from error

    def embed(self, texts: list[str], model: str) -> list[list[float]]:
        return self._post("/api/embed", {"model": model, "input": texts})["embeddings"]

    def generate(self, prompt: str, model: str, options: Mapping[str, Any]) -> str:
        payload = {"model": model, "prompt": prompt, "stream": False, "options": dict(options)}
        return self._post("/api/generate", payload)["response"]


@dataclass(frozen=True)
class StandIn:
    """Hashed bag of words as embedding, the prompt's hash as response."""

    dimension: int = 64

    def embed(self, texts: list[str], model: str) -> list[list[float]]:
        vectors = []
        for text in texts:
            vector = [0.0] * self.dimension
            for word in text.lower().split():
                digest = hashlib.sha1(word.encode("utf-8")).digest()
                slot = int.from_bytes(digest[:4], "big") % self.dimension
                vector[slot] += 1.0 if digest[4] % 2 else -1.0
            vectors.append(vector)
        return vectors

    def generate(self, prompt: str, model: str, options: Mapping[str, Any]) -> str:
        return "response " + hashlib.sha1(prompt.encode("utf-8")).hexdigest()


def describe(error: Exception) -> str:
    return str(error).split("\n", 1)[0] or type(error).__name__


def unit_vector(vector: list[float]) -> list[float]:
    values = np.asarray(vector, dtype=float)
    length = float(np.sqrt((values * values).sum()))
    return values.tolist() if not length or not np.isfinite(length) else (values / length).tolist()


def _with_retries(client: ModelClient, texts: list[str], model: str, pause: float) -> list:
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return client.embed(texts, model)
        except Exception:
            if attempt == ATTEMPTS:
                raise
            time.sleep(pause * 2**attempt)
    return []


def embedding(
    text: Column, client: ModelClient, model: str = "", batch_size: int = 8, pause: float = 0.1
) -> Column:
    """``value``, the unit-length embedding of a text column, and ``error``.

    ``batch_size`` texts go with a call, which is tried three times. Null texts are not sent; a
    text for which the client returns nothing has neither value nor error. Texts of a call that
    fails have its error, and the others go on.
    """

    @F.pandas_udf("value array<double>, error string")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            wanted = [at for at, text_ in enumerate(texts) if text_ is not None]
            for start in range(0, len(wanted), batch_size):
                slots = wanted[start : start + batch_size]
                try:
                    found = _with_retries(client, [texts.iloc[at] for at in slots], model, pause)
                    units = [None if vector is None else unit_vector(vector) for vector in found]
                except Exception as error:  # noqa: BLE001 - whatever the client raises
                    for at in slots:
                        errors[at] = describe(error)
                    continue
                for at, unit in zip(slots, units):
                    vectors[at] = unit
            yield pd.DataFrame({"value": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    return embed.asNondeterministic()(text)


def response(
    prompt: Column, client: ModelClient, model: str = "", options: Mapping[str, Any] | None = None
) -> Column:
    """``value``, the generated text for a prompt column, and ``error`` where the call failed.

    Null prompts are not sent. Use ``ask``, which keeps Spark from repeating the call.
    """
    settings = dict(options or {})

    def one(prompt_: str | None) -> tuple[str | None, str | None]:
        if prompt_ is None:
            return None, None
        try:
            return client.generate(prompt_, model, settings), None
        except Exception as error:  # noqa: BLE001 - whatever the client raises
            return None, describe(error)

    @F.pandas_udf("value string, error string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            yield pd.DataFrame([one(p) for p in prompts], columns=["value", "error"], dtype=object)

    return generate.asNondeterministic()(prompt)


def ask(
    df: DataFrame, prompt: Column, client: ModelClient, model: str = "", options: Mapping[str, Any] | None = None
) -> DataFrame:
    """``df`` with ``reply`` and ``reply_error``, one call for each row whose prompt is not null.

    The call has a column of its own, so that whatever reads the reply does not repeat it, and a
    call that fails leaves an error in its own row alone.
    """
    settled = df.withColumn("_prompt", prompt).withColumn("_reply", response(F.col("_prompt"), client, model, options))
    return settled.select(
        *df.columns, F.col("_reply.value").alias("reply"), F.col("_reply.error").alias("reply_error")
    )


def embed_questions(
    questions: DataFrame, client: ModelClient, model: str = "", batch_size: int = 8
) -> DataFrame:
    """``query_id, question, vector``, settled; questions without an embedding are dropped."""
    found = questions.withColumn("_embedded", embedding(F.col("question"), client, model, batch_size))
    vector = found.select(*questions.columns, F.col("_embedded.value").alias("vector"))
    return cut(vector).where(F.col("vector").isNotNull())
