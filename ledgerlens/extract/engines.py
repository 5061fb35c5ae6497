"""Engines that a tier may use: recognition of pictures and language models, run over Arrow batches.

An engine is an object made once per Python worker from a factory that is shipped with the plan; no
engine is built in, and none is called unless handed in. Answers carry their key, so that an item
that fails is a row with an error and never shifts the others.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Recognizer(Protocol):
    def read(self, picture: bytes) -> list[tuple[str, float, tuple[float, float, float, float]]]:
        """(text, confidence, box) of the lines of a picture."""


class Model(Protocol):
    def ask(self, system: str, user: str) -> str:
        """Answer of a language model."""


OCR_LINES = "key string, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double, error string"


def recognize(pictures: DataFrame, make: Callable[[], Recognizer]) -> DataFrame:
    """Lines of (key, picture) in reading order: by rows of eight points, then from the left.

    A picture that cannot be read, or is null, gives one row with an error; one without lines gives none.
    """

    def run(batches):
        engine = make()
        for pdf in batches:
            rows = []
            for key, picture in zip(pdf["key"], pdf["picture"]):
                try:
                    lines = engine.read(bytes(picture))
                except Exception as e:  # an engine's own failures are its answer
                    rows.append((key, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
                    continue
                lines = sorted(lines, key=lambda x: (round(x[2][1] / 8) * 8, x[2][0]))
                rows += [(key, i, t, c, *map(float, box), None) for i, (t, c, box) in enumerate(lines, 1)]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in OCR_LINES.split(", ")])

    return pictures.select("key", "picture").mapInPandas(run, OCR_LINES)


def page_texts(lines: DataFrame) -> DataFrame:
    """key, ocr_text, ocr_confidence (mean) of recognised lines."""
    one = F.struct("line_no", "text")
    return lines.where(F.col("error").isNull()).groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["text"]), "\n").alias("ocr_text"), F.avg("confidence").alias("ocr_confidence")
    )


def ask(prompts: DataFrame, make: Callable[[], Model], system: str, most_at_once: int = 8, longest: int = 20_000) -> DataFrame:
    """Answers to (key, prompt): key, answer, error, n_unsent. At most ``most_at_once`` tasks call the model.

    Prompts are cut at ``longest`` characters, as the model's input is bounded; ``n_unsent`` says how
    many characters the model did not see. Null prompts get null answers.
    """

    def run(batches):
        model = make()
        for pdf in batches:
            answers, errors = [], []
            for p in pdf["prompt"]:
                try:
                    answers.append(None if p is None else model.ask(system, p))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield pd.DataFrame({"key": pdf["key"], "answer": pd.Series(answers, dtype=object), "error": pd.Series(errors, dtype=object), "n_unsent": pdf["n_unsent"]})

    cut_off = prompts.select("key", F.substring("prompt", 1, longest).alias("prompt"), F.greatest(F.lit(0), F.coalesce(F.length("prompt"), F.lit(0)) - longest).alias("n_unsent")).repartition(most_at_once)
    return cut_off.mapInPandas(run, "key string, answer string, error string, n_unsent int")


class Retry(Exception):
    """An answer that another attempt may better."""


@dataclass(frozen=True)
class HttpModel:
    """A chat endpoint of the common kind. The key is read from the worker's environment, never from a frame."""

    url: str
    model: str
    key_variable: str = "LLM_API_KEY"
    timeout: float = 120.0
    max_tokens: int = 4096
    attempts: int = 3
    first_wait: float = 1.0
    longest_wait: float = 8.0

    @classmethod
    def from_environment(cls) -> HttpModel:
        return cls(os.environ["LLM_BASE_URL"].rstrip("/") + "/chat/completions", os.environ["LLM_TEXT_MODEL"])

    def ask(self, system: str, user: str) -> str:
        wait = self.first_wait
        for k in range(self.attempts):
            try:
                return self._once(system, user)
            except Retry:
                if k + 1 == self.attempts:
                    raise
                time.sleep(wait)
                wait = min(2 * wait, self.longest_wait)
        raise AssertionError

    def _once(self, system: str, user: str) -> str:
        body = {"model": self.model, "temperature": 0, "max_tokens": self.max_tokens, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {k}"} if (k := os.environ.get(self.key_variable)) else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as r:
                return json.loads(r.read())["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise Retry(f"status {e.code}") from e
            raise
        except (urllib.error.URLError, TimeoutError, ValueError, KeyError, IndexError) as e:
            raise Retry(str(e)) from e
