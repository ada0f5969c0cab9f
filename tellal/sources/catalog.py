"""The catalog of event types: loaded from YAML, checked as a whole, and as a DataFrame."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession

from .reference_data import CATALOG_YAML

OTHER = "OTHER"
KEY = re.compile(r"[A-Z][A-Z0-9_]*\Z")
LONGEST_KEY = 48


class InvalidCatalog(ValueError):
    """A catalog with problems; all of them are listed."""

    code = "catalog.invalid"

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Metric:
    key: str
    label: str
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class EventType:
    key: str
    label: str
    keywords: tuple[str, ...]
    metrics: tuple[Metric, ...]


@dataclass(frozen=True)
class Catalog:
    event_types: tuple[EventType, ...]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per keyword: event_type, its ordinal, metric_key (null for triggers), keyword, role."""
        rows = []
        for ord_, e in enumerate(self.event_types):
            rows += [(e.key, ord_, None, k, "EVENT_TYPE") for k in e.keywords]
            rows += [(e.key, ord_, m.key, k, "METRIC") for m in e.metrics for k in m.keywords]
        return spark.createDataFrame(rows, "event_type string, ord int, metric_key string, keyword string, role string")

    def metadata(self, spark: SparkSession) -> DataFrame:
        """One row per metric with the labels, in catalog order; trigger words are not published."""
        rows = [(k, e.key, e.label, n, m.key, m.label) for k, e in enumerate(self.event_types) for n, m in enumerate(e.metrics)]
        return spark.createDataFrame(rows, "event_ord int, event_type string, event_label string, metric_ord int, metric_type string, metric_label string")


def _strip(x: object) -> str:
    return str(x).strip() if x is not None else ""


def _key_problems(what: str, key: str) -> list[str]:
    if not key:
        return [f"{what}: key is blank"]
    out = [] if KEY.match(key) else [f"{what} {key}: key is not of the form [A-Z][A-Z0-9_]*"]
    return out + ([f"{what} {key}: key is longer than {LONGEST_KEY}"] if len(key) > LONGEST_KEY else [])


def _keyword_problems(what: str, words: list[str]) -> list[str]:
    if not words:
        return [f"{what}: no keywords"]
    out = [f"{what}: a keyword is blank"] if "" in words else []
    return out + [f"{what}: keyword {w} is repeated" for w, n in Counter(words).items() if n > 1 and w]


def parse_catalog(source: str) -> Catalog:
    """The catalog in a YAML text, or InvalidCatalog with every problem."""
    try:
        data = yaml.safe_load(source) or {}
    except yaml.YAMLError as e:
        raise InvalidCatalog([f"unreadable: {e}"]) from e
    entries = data.get("event-types") if isinstance(data, dict) else None
    if not entries:
        raise InvalidCatalog(["no event types"])
    problems, types, labels = [], [], {}
    for entry in entries:
        key, words = _strip(entry.get("key")), [_strip(w) for w in entry.get("keywords") or []]
        name = f"event type {key}"
        problems += _key_problems("event type", key) + _keyword_problems(name, words)
        problems += [f"{name}: label is blank"] * (not _strip(entry.get("label"))) + [f"{name}: key is reserved"] * (key == OTHER)
        metrics = []
        for m in entry.get("metrics") or []:
            mkey, label = _strip(m.get("key")), _strip(m.get("label"))
            mwords = [_strip(w) for w in m.get("keywords") or []]
            problems += _key_problems(f"{name}: metric", mkey) + _keyword_problems(f"{name}: metric {mkey}", mwords)
            problems += [f"{name}: metric {mkey}: label is blank"] * (not label)
            problems += [f"{name}: metric {mkey} is repeated"] * any(x.key == mkey for x in metrics)
            if label and labels.setdefault(mkey, label) != label:
                problems.append(f"{name}: metric {mkey} has another label elsewhere")
            metrics.append(Metric(mkey, label, tuple(mwords)))
        problems += [f"{name}: no metrics"] * (not metrics)
        types.append(EventType(key, _strip(entry.get("label")), tuple(words), tuple(metrics)))
    problems += [f"event type {k} is repeated" for k, n in Counter(t.key for t in types).items() if n > 1]
    if problems:
        raise InvalidCatalog(problems)
    return Catalog(tuple(types))


def load_catalog(path: str | None = None) -> Catalog:
    """The catalog in a file, or the default one."""
    if path is None:
        return parse_catalog(CATALOG_YAML)
    try:
        with open(path, encoding="utf-8") as f:
            return parse_catalog(f.read())
    except OSError as e:
        raise InvalidCatalog([f"unreadable: {e}"]) from e
