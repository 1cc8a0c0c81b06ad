"""Calls of services outside: search, pages, geocoding, image catalogues, language models.

A service is an object with one method, call(key: str) -> str | None. It is made on the executors by a factory, once per task, is asked once
per distinct key of a batch, spaced out and tried again as told; a call that fails gives null and never fails the job. Offline, a
table stands in for a service.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Service(Protocol):
    def call(self, key: str) -> str | None: ...


def _ask(service: Service, key: str, tries: int, wait: float) -> str | None:
    for k in range(tries):
        try:
            return service.call(key)
        except Exception:  # noqa: BLE001
            if k + 1 < tries:
                time.sleep(wait)
    return None


def ask(rows: DataFrame, key: str, factory: Callable[[], Service], name: str = "response", tries: int = 2, wait: float = 10.0, spacing: float = 0.0, nothing: str | None = "no") -> DataFrame:
    """``rows`` with the service's response to the column ``key``. A null key is not asked; the answer ``nothing`` becomes empty.

    Each distinct key is asked once: distinct keys are asked and joined back, so a hot key costs one call.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = factory()
        for batch in batches:
            answers = []
            for k in batch["key"]:
                answer = _ask(service, k, tries, wait)
                answers.append("" if answer is not None and answer == nothing else answer)
                if spacing:
                    time.sleep(spacing)
            yield pd.DataFrame({"key": batch["key"], "response": answers})

    keys = rows.select(F.col(key).cast("string").alias("key")).filter("key is not null").distinct()
    asked = keys.mapInPandas(run, "key string, response string").withColumnRenamed("response", name).withColumnRenamed("key", "_key")
    return rows.join(asked, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")


def _get(url: str, timeout: float, data: bytes | None = None, headers: dict[str, str] | None = None) -> tuple[int, str]:
    request = urllib.request.Request(url, data=data, headers={"User-Agent": "tidegauge", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as got:  # noqa: S310 addresses come from the caller
        return got.status, got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")


class Pages:
    """Pages by address: the body of a page with status 200, nothing otherwise; ``parsing.html_parts`` reads it."""

    def __init__(self, timeout: float = 30.0) -> None:
        self.timeout = timeout

    def call(self, key: str) -> str | None:
        try:
            status, body = _get(key, self.timeout)
        except urllib.error.HTTPError:
            return None  # an answer, so it isn't asked again
        return body if status == 200 else None


class Search:
    """The first ``most`` addresses of a search service that gives a JSON array of addresses, or of objects with ``field``; the answer is a JSON array."""

    def __init__(self, address: str, most: int = 5, field: str = "url", timeout: float = 30.0) -> None:
        self.address, self.most, self.field, self.timeout = address, most, field, timeout

    def call(self, key: str) -> str | None:
        found = json.loads(_get(self.address.replace("{query}", urllib.parse.quote(key)), self.timeout)[1])
        return json.dumps([r if isinstance(r, str) else r[self.field] for r in found][: self.most])


class Geocoder:
    """The JSON array of hits that a geocoder gives for a name; ``geocoded`` takes the first."""

    def __init__(self, address: str, timeout: float = 30.0) -> None:
        self.address, self.timeout = address, timeout

    def call(self, key: str) -> str | None:
        return _get(self.address.replace("{query}", urllib.parse.quote(key)), self.timeout)[1]


class Model:
    """A language model behind an address that takes a JSON object with the prompt and gives one with the text at ``path``."""

    def __init__(self, address: str, fields: dict | None = None, path: tuple = ("text",), headers: dict[str, str] | None = None, timeout: float = 120.0) -> None:
        self.address, self.fields, self.path, self.headers, self.timeout = address, fields or {}, path, headers or {}, timeout

    def call(self, key: str) -> str | None:
        body = json.dumps({**self.fields, "prompt": key}).encode()
        found = json.loads(_get(self.address, self.timeout, body, {"Content-Type": "application/json", **self.headers})[1])
        for step in self.path:
            found = found[step]
        return found


class Lookup:
    """A service that answers from a dictionary; for tests and small tables."""

    def __init__(self, answers: dict[str, str]) -> None:
        self.answers = answers

    def call(self, key: str) -> str | None:
        return self.answers.get(key)


def look_up(rows: DataFrame, key: str, answers: DataFrame, name: str = "response") -> DataFrame:
    """The offline stand-in at any size: ``answers`` (key, response; keys unique) joined to the rows."""
    a = answers.select(F.col("key").alias("_key"), F.col("response").alias(name))
    return rows.join(a, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")


def geocoded(responses: DataFrame, response: str = "response") -> DataFrame:
    """Adds lat, lon of the first hit of a geocoder's JSON array; rows without one are dropped."""
    at = lambda c: F.get_json_object(response, f"$[0].{c}").try_cast("double")
    return responses.withColumn("lat", at("lat")).withColumn("lon", at("lon")).filter("lat is not null and lon is not null")


# Prompts are the callers' own: they are templates with fields in braces, filled per row.
PLACES_PROMPT = "Name the places that the disaster in these articles struck, separated by commas; answer no if there is none.\n{text}"
STATEMENTS_PROMPT = "For each of these dates say in a sentence or two what the disaster in the articles changed that can be seen from above, as date: text.\nDates: {dates}\n{text}"
CHOICES_PROMPT = (
    "Write three questions with four options each on these statements, as **Question i:** text, lines A) to D), **Correct Answer i:** letter.\n{events}"
)
ANSWERS_PROMPT = "Write three questions with answers in whole sentences on these statements, as **Question i:** text **Answer i:** text.\n{events}"
JUDGE_PROMPT = "Rate the answer by six criteria, as NAME: n/5.\nQuestion: {question}\nReference: {reference}\nAnswer: {predicted}"


def prompted(template: str, **fields) -> F.Column:
    """A prompt per row: the template with its fields replaced by columns; null fields are empty."""
    out = F.lit(template)
    for name, column in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column, F.lit("")))
    return out
