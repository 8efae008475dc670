"""Models behind protocols: embedding, reranking and generation run inside Arrow stages, one client per task; what fails becomes a row's error."""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources.ledger import Log
from .tables import written


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> tuple[str, int, int]:
        """Text, prompt tokens and completion tokens."""


#: Words whose hashes an embedder keeps.
KEPT_WORDS = 200_000


class HashEmbedder:
    """A deterministic stand-in: signed hashes of words, normalised."""

    def __init__(self, size: int = 64):
        self.size = size
        #: Words met before: their place, and behind the places those of a negative sign.
        self.known: dict[str, int] = {}

    def _place(self, word: str) -> int:
        h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
        self.known[word] = place = h % self.size + (0 if h >> 63 else self.size)
        return place

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        for row, text in zip(out, texts, strict=True):
            words = (text or "").lower().split()
            if words:
                places = [self._place(w) if p is None else p for w, p in zip(words, map(self.known.get, words), strict=True)]
                n = np.bincount(places, minlength=2 * self.size)
                row += n[: self.size] - n[self.size :]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class EchoGenerator:
    """A deterministic stand-in: the prompt's last line."""

    def generate(self, prompt: str) -> tuple[str, int, int]:
        text = prompt.strip().splitlines()[-1] if prompt.strip() else ""
        return text, max(1, len(prompt) // 4), max(1, len(text) // 4)


def embed(rows: DataFrame, make: Callable[[], Embedder], text: str = "text", into: str = "embedding", batch: int = 64) -> DataFrame:
    """Adds array<float>; null texts as empty ones."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in parts:
            texts = texts.fillna("").tolist()
            yield pd.Series([v.astype("float32") for k in range(0, len(texts), batch) for v in model.encode(texts[k : k + batch])], dtype=object)

    return rows.withColumn(into, F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER)(text))


def rerank_scores(rows: DataFrame, make: Callable[[], Reranker], question: str = "question", text: str = "text", into: str = "model_score", error: str = "model_error") -> DataFrame:
    """Adds the model's score of (question, text) and its error. Where a batch fails its pairs are tried one by one; a pair that fails has a null score, which adds nothing to a rank, and its error."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = broken = None
        try:
            model = make()
        except Exception as e:
            broken = f"{type(e).__name__}: {e}"
        for q, t in parts:
            pairs = list(zip(q, t, strict=True))
            try:
                told = [(None, broken)] * len(pairs) if broken else [(float(x), None) for x in model.predict(pairs)]
            except Exception:
                told = []
                for pair in pairs:
                    try:
                        told.append((float(model.predict([pair])[0]), None))
                    except Exception as e:
                        told.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(told, columns=["score", "error"]).astype({"score": float})

    scored = F.pandas_udf(run, "score double, error string", F.PandasUDFType.SCALAR_ITER)(question, text)
    return rows.withColumn("_scored", scored).withColumn(into, F.nanvl("_scored.score", F.lit(None).cast("double"))).withColumn(error, F.col("_scored.error")).drop("_scored")


#: Calls that a task makes at once.
PARALLEL = 8


def generate(rows: DataFrame, make: Callable[[], Generator], prompt: str = "prompt", into: str = "response", tries: int = 1, *, parallel: int = PARALLEL, pause: float = 0.0) -> DataFrame:
    """Adds a struct: answer, success, error_message, latency_seconds, prompt_tokens, completion_tokens, attempts; rows stay as they are, in their order.

    A task makes up to parallel calls at once, each thread with a client of its own. An exception puts a prompt back into the queue, to be asked again after a
    pause that doubles, tries times in all; the last exception is told in the row. latency_seconds is that of the last call.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = threading.local()

        def ask(p: str, attempt: int) -> tuple:
            if attempt and pause:
                time.sleep(pause * 2 ** (attempt - 1))
            began = time.monotonic()
            try:
                if not hasattr(own, "client"):
                    own.client = make()
                text, a, b = own.client.generate(p)
                return text, True, None, time.monotonic() - began, a, b, attempt + 1
            except Exception as e:
                return "", False, f"{type(e).__name__}: {e}", time.monotonic() - began, None, None, attempt + 1

        with ThreadPoolExecutor(max(1, parallel)) as pool:
            for prompts in parts:
                asked = prompts.fillna("").tolist()
                out: list = [None] * len(asked)
                queue = {pool.submit(ask, p, 0): k for k, p in enumerate(asked)}
                while queue:
                    done, _ = wait(queue, return_when=FIRST_COMPLETED)
                    for call in done:
                        k = queue.pop(call)
                        out[k] = call.result()
                        if not out[k][1] and out[k][-1] < tries:
                            queue[pool.submit(ask, asked[k], out[k][-1])] = k
                yield pd.DataFrame(out, columns=["answer", "success", "error_message", "latency_seconds", "prompt_tokens", "completion_tokens", "attempts"]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    kind = "answer string, success boolean, error_message string, latency_seconds double, prompt_tokens long, completion_tokens long, attempts int"
    return rows.withColumn(into, F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)(prompt))


def resumed(rows: DataFrame, make: Callable[[], Generator], log: Log, run: str, *, batches: int = 16, prompt: str = "prompt", tries: int = 1, parallel: int = PARALLEL) -> DataFrame:
    """Answers of rows (log's keys and prompt) by key, from a log: only keys that it doesn't hold are asked, in batches that are committed one by one.

    A lost driver repeats the batch it was in, a repeated run asks nothing that was answered. Failures are not logged, so the next run asks them again; they are in the result. Batches are dealt by a hash of the keys.
    """
    number = F.pmod(F.xxhash64(*log.keys), F.lit(batches))
    failed = []
    for k in range(batches):
        todo = log.missing(rows.where(number == k))
        got = written(generate(todo, make, prompt, tries=tries, parallel=parallel), "answers")
        log.append(got.where("response.success").select(*log.keys, "response"), f"{run}-{k:04d}-{uuid.uuid4().hex}")
        failed.append(got.where("not response.success").select(*log.keys, "response"))
    done = log.rows()
    out = reduce(DataFrame.unionByName, failed)
    if done is None:
        return out
    return done.select(*log.keys, "response").join(rows.select(*log.keys).distinct(), log.keys, "left_semi").unionByName(out)


def registry(spark, models: dict[str, str]) -> DataFrame:
    """run_name, model, mode, rag_enabled: every model with and without retrieval."""
    return spark.createDataFrame([(f"{name}_{mode}", model, mode, mode == "rag") for name, model in models.items() for mode in ("rag", "no_rag")], "run_name string, model string, mode string, rag_enabled boolean")


def unknown_runs(wanted: list[str], known: DataFrame) -> list[str]:
    have = {r[0] for r in known.select("run_name").where(F.col("run_name").isin(*wanted)).collect()}
    return [w for w in wanted if w not in have]
