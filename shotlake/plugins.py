"""Plug-in points for what is outside data processing: encoders, recognisers, readers, remote engines.

A plug-in is a Python object that a registry makes from a name. On executors it
runs within Arrow batches and is made once for each worker.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


@runtime_checkable
class Retriever(Protocol):
    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        """(query_id, kind, text) -> (query_id, video_id, timestamp_ms, score, rank)."""


@runtime_checkable
class RankingChannel(Protocol):
    name: str

    def supports(self, kind: str) -> bool: ...

    def rank(self, subs: DataFrame, depth: int) -> DataFrame:
        """(query_id, label, text) -> (query_id, label, rank, shot_key, score)."""


@runtime_checkable
class ImageTextEncoder(Protocol):
    model_id: str
    dim: int

    def encode_texts(self, texts: list[str]) -> np.ndarray: ...

    def encode_images(self, images: list[np.ndarray]) -> np.ndarray: ...


@runtime_checkable
class TextEmbedder(Protocol):
    """Dense vectors and sparse term weights; queries and documents may be embedded differently."""

    model_id: str
    dim: int

    def dense(self, texts: list[str], query: bool) -> np.ndarray: ...

    def sparse(self, texts: list[str], query: bool) -> list[dict[str, float]]: ...


@runtime_checkable
class ShotDetector(Protocol):
    def detect(self, path: str) -> list[tuple[int, int, float]]:
        """(start_ms, end_ms, confidence) of each shot."""


@runtime_checkable
class Recogniser(Protocol):
    """Speech, screen text or names: rows for one input."""

    def read(self, item: Any) -> list[dict]: ...


@runtime_checkable
class Counter(Protocol):
    def count(self, images: list[np.ndarray], concepts: list[str]) -> list[dict[str, list[dict]]]:
        """For each image the detections of every concept, none left out."""


@runtime_checkable
class Escalation(Protocol):
    name: str

    def run(self, candidates: DataFrame) -> DataFrame: ...


@runtime_checkable
class Translator(Protocol):
    def translate(self, texts: list[str]) -> list[str]: ...


@runtime_checkable
class Answerer(Protocol):
    def answer(self, questions: DataFrame, top_k: int) -> DataFrame: ...


@runtime_checkable
class Reader(Protocol):
    """Answers a question from an evidence pack, and tells whether a pack contradicts an answer."""

    def read(self, pack: dict, question: str) -> dict: ...

    def disconfirm(self, pack: dict, question: str, answer: str) -> bool: ...


@runtime_checkable
class StageWorker(Protocol):
    def run(self, video_id: str) -> dict[str, int]: ...


class Registry:
    """Makers of plug-ins by kind and name."""

    def __init__(self) -> None:
        self._makers: dict[tuple[str, str], Callable[..., Any]] = {}

    def register(self, kind: str, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def add(maker: Callable[..., Any]) -> Callable[..., Any]:
            if (kind, name) in self._makers:
                raise ValueError(f"{kind} {name!r} is registered already")
            self._makers[kind, name] = maker
            return maker

        return add

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._makers if k == kind)

    def make(self, kind: str, name: str, **settings: Any) -> Any:
        if (kind, name) not in self._makers:
            raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(self.names(kind))}")
        return self._makers[kind, name](**settings)


registry = Registry()


class ModelCache:
    """The models last used, at most `size`; the one unused for longest goes first. A failed load leaves nothing behind."""

    def __init__(self, size: int):
        if size < 1:
            raise ValueError("a cache holds one model at least")
        self._size, self._held, self._lock = size, OrderedDict(), threading.Lock()

    def get(self, key: str, load: Callable[[], Any]) -> Any:
        with self._lock:
            if key not in self._held:
                self._held[key] = load()
                while len(self._held) > self._size:
                    self._held.popitem(last=False)
            self._held.move_to_end(key)
            return self._held[key]

    def __contains__(self, key: str) -> bool:
        return key in self._held


#: One cache for each Python worker.
models = ModelCache(4)


def of_worker(key: str, make: Callable[[], Any]) -> Any:
    return models.get(key, make)


class EndpointPool:
    """Clients taken in turn. One that fails rests for `rest_s`; a request goes on to the next, except where it was refused for itself."""

    def __init__(self, clients: list[Callable[[Any], Any]], rest_s: float = 60.0, refused: Callable[[Exception], bool] = lambda e: False, clock: Callable[[], float] = time.monotonic):
        if not clients:
            raise ValueError("a pool needs a client")
        self._clients, self._rest, self._refused, self._clock = clients, rest_s, refused, clock
        self._until, self._next, self._lock = [0.0] * len(clients), 0, threading.Lock()

    def _order(self) -> list[int]:
        with self._lock:
            start, self._next = self._next, (self._next + 1) % len(self._clients)
            order = [(start + i) % len(self._clients) for i in range(len(self._clients))]
            awake = [i for i in order if self._until[i] <= self._clock()]
            return awake or order

    def call(self, request: Any) -> Any:
        last: Exception | None = None
        for i in self._order():
            try:
                return self._clients[i](request)
            except Exception as e:
                if self._refused(e):
                    raise
                last = e
                with self._lock:
                    self._until[i] = self._clock() + self._rest
        raise RuntimeError("no endpoint answered") from last

    def batch(self, requests: list[Any]) -> list[Any]:
        """Answers in the order of the requests; one that fails is None."""

        def one(request: Any) -> Any:
            try:
                return self.call(request)
            except Exception as e:
                log.warning("request skipped: %s", e)
                return None

        with ThreadPoolExecutor(len(self._clients)) as pool:
            return list(pool.map(one, requests))


def with_timeout(step: Callable[[DataFrame], DataFrame], candidates: DataFrame, seconds: float) -> DataFrame:
    """The step's candidates, or those given where it fails or takes too long; a late step's result is dropped."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(step, candidates).result(seconds)
    except Late:
        log.warning("step took more than %s s", seconds)
    except Exception as e:
        log.warning("step skipped: %s", e)
    finally:
        pool.shutdown(wait=False)
    return candidates


def mapped(rows: DataFrame, make: Callable[[], Any], key: str, use: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows through a plug-in, an Arrow batch at a time; the plug-in is made once for each worker."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = of_worker(key, make)
        for batch in batches:
            yield use(model, batch)

    return rows.mapInPandas(run, schema)


def texts_encoded(rows: DataFrame, make: Callable[[], ImageTextEncoder], key: str, id_col: str = "query_id") -> DataFrame:
    """(id_col, qvec) of (id_col, text)."""
    kind = rows.schema[id_col].dataType.simpleString()
    use = lambda m, b: pd.DataFrame({id_col: b[id_col], "qvec": [v.tolist() for v in m.encode_texts(b["text"].tolist())]})
    return mapped(rows.select(id_col, "text"), make, key, use, f"{id_col} {kind}, qvec array<double>")


def frames_of(videos: DataFrame, make: Callable[[], Callable[[bytes, list[int]], dict[int, bytes]]], key: str) -> DataFrame:
    """(video_id, at_ms, image) of (video_id, content, targets): a decoder gives the frame nearest to each target; those it can't find are left out."""

    def use(decode: Callable, batch: pd.DataFrame) -> pd.DataFrame:
        found = [(v, int(at), image) for v, data, targets in zip(batch["video_id"], batch["content"], batch["targets"], strict=True) for at, image in sorted(decode(data, list(targets)).items())]
        return pd.DataFrame(found, columns=["video_id", "at_ms", "image"])

    return mapped(videos.select("video_id", "content", "targets"), make, key, use, "video_id string, at_ms bigint, image binary")


def entropy_bits(image: np.ndarray) -> float:
    """Entropy of the 256 grey levels of a picture; colours are weighed as their brightness."""
    grey = image if image.ndim == 2 else image[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    p = np.bincount(np.clip(np.rint(grey), 0, 255).astype(np.int64).ravel(), minlength=256) / grey.size
    return float(-(p[p > 0] * np.log2(p[p > 0])).sum())


class RemoteRetriever:
    """Results of a running search service for (query_id, kind, text, reveals); clips are refused, longer lists are cut."""

    def __init__(self, base_url: str, timeout_s: float = 120.0, post: Callable[[str, dict], dict] | None = None):
        self._url, self._timeout, self._post = base_url.rstrip("/"), timeout_s, post

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        url, timeout, post = self._url, self._timeout, self._post

        def send(body: dict) -> dict:
            if post is not None:
                return post(f"{url}/api/search", body)
            request = urllib.request.Request(f"{url}/api/search", json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                for q, kind, text, reveals in zip(batch["query_id"], batch["kind"], batch["text"], batch["reveals"], strict=True):
                    if kind == "kis_v":
                        raise ValueError("a remote service takes no clips")
                    whole = "\n".join(p for p in [text or "", *(reveals if reveals is not None else [])] if p).strip()
                    if not whole:
                        raise ValueError(f"case {q} has no text")
                    rows = send({"query": whole, "top_k": top_k}).get("results")
                    if not isinstance(rows, list):
                        raise ValueError("the service's answer has no results")
                    found += [(q, str(r["video_id"]), int(r["timestamp_ms"]), float(r["score"]), r.get("keyframe_id"), i + 1) for i, r in enumerate(rows[:top_k])]
                yield pd.DataFrame(found, columns=["query_id", "video_id", "timestamp_ms", "score", "keyframe_id", "rank"])

        return queries.select("query_id", "kind", "text", "reveals").mapInPandas(run, "query_id string, video_id string, timestamp_ms bigint, score double, keyframe_id string, rank int")
