"""Labelling by a remote model: a keyed cache, retries, and a client given by the caller.

No network code is shipped: `client` is any callable from a request to a
response, made anew in each task by `factory`.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRYABLE = (408, 409, 429)
EFFORTS = ("low", "medium", "high")
RESULT = "id string, label int, confidence string, reason string, model string, attempts int, prompt_tokens long, completion_tokens long, error string"


@dataclass
class Response:
    """What a client returns: HTTP status, the text, the model that answered, tokens used."""

    status: int
    content: str = ""
    model: str = ""
    prompt_tokens: int = 0
    completion_tokens: int = 0
    error: str | None = None


class AuthError(RuntimeError):
    """Credentials were refused: the run stops."""


class RequestError(RuntimeError):
    """A request failed for good: the item is recorded as failed."""


@dataclass
class Request:
    prompt: str
    seed: int
    options: dict = field(default_factory=dict)


def check_effort(effort: str) -> str:
    if effort not in EFFORTS:
        raise ValueError(f"{effort} is none of {', '.join(EFFORTS)}")
    return effort


def retrying(client: Callable[[Request], Response], tries: int = 5, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[Request], Response]:
    """The client with exponential, jittered waits on retryable failures and empty answers; a refused `temperature` is left out once."""

    def send(request: Request) -> Response:
        said = "no answer"
        for attempt in range(tries):
            r = client(request)
            if r.status in (401, 403):
                raise AuthError(r.error or "refused")
            if r.status == 400 and "temperature" in (r.error or "") and "temperature" in request.options:
                request.options.pop("temperature")
                continue
            if r.status == 200 and not r.error and r.content:
                return r
            said = r.error or f"status {r.status}"
            if r.status not in RETRYABLE and r.status < 500 and r.status != 200:
                break
            sleep(min(longest, 2.0**attempt) * (0.5 + random.random() / 2))
        raise RequestError(said)

    return send


def parse_label(text: str) -> dict | None:
    """The JSON object in an answer, fenced or within prose, if it has a 0/1 label."""
    m = re.search(r"\{.*\}", text, re.S)
    try:
        got = json.loads(m[0]) if m else None
    except ValueError:
        return None
    return got if isinstance(got, dict) and got.get("label") in (0, 1) else None


def prompt_of(template: str, *values: Column) -> Column:
    """The template with values; blank ones read (unknown)."""
    return F.format_string(template, *[F.coalesce(F.nullif(F.trim(v), F.lit("")), F.lit("(unknown)")) for v in values])


def annotate(items: DataFrame, cache: DataFrame | None, factory: Callable[[], Callable[[Request], Response]], seed: int = 0, parse_tries: int = 3, parallel: int = 8, dry_run: bool = False) -> DataFrame:
    """Labels for items (id, prompt) that the cache has no record of; append the result to the cache.

    An answer that does not parse is asked again with the seed moved by 1000 an
    attempt. Failures become rows with an error; refused credentials stop the
    job. dry_run returns what would be asked.
    """
    todo = items if cache is None else items.join(cache.where("label is not null").select("id"), "id", "left_anti")
    if dry_run:
        return todo

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = retrying(factory())
        for pdf in batches:
            out = []
            for i, prompt in zip(pdf["id"], pdf["prompt"], strict=True):
                row = {"id": i, "attempts": 0, "prompt_tokens": 0, "completion_tokens": 0, "error": "no label in the answers"}
                for k in range(parse_tries):
                    row["attempts"] = k + 1
                    try:
                        r = send(Request(prompt, seed + 1000 * k))
                    except RequestError as e:
                        row["error"] = str(e)[:500]
                        break
                    row["prompt_tokens"] += r.prompt_tokens
                    row["completion_tokens"] += r.completion_tokens
                    if got := parse_label(r.content):
                        row |= {"label": got["label"], "confidence": got.get("confidence"), "reason": str(got.get("reason", ""))[:500], "model": r.model, "error": None}
                        break
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")], dtype=object)

    return todo.select("id", "prompt").repartition(parallel).mapInPandas(run, RESULT)


def usage(results: DataFrame, prompt_price: float = 0.0, completion_price: float = 0.0) -> DataFrame:
    """Requests, tokens and cost by model; prices are for a million tokens."""
    p, c = F.sum("prompt_tokens"), F.sum("completion_tokens")
    return results.groupBy("model").agg(F.count("*").alias("requests"), p.alias("prompt_tokens"), c.alias("completion_tokens"), ((p * prompt_price + c * completion_price) / 1e6).alias("cost"))
