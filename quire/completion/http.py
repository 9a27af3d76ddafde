"""Hosted and local model backends over HTTP, called from Python workers in Arrow batches."""

from __future__ import annotations

import asyncio
import json
import os
import urllib.request
from collections.abc import Awaitable, Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame

from quire.completion.base import Ask, Completer, Reply, with_continuation
from quire.schemas import COMPLETIONS


@dataclass(frozen=True)
class Backend:
    """Where and how to call a model. ``kind`` is the wire format: ``chat`` or ``messages``."""

    name: str
    base_url: str
    model: str
    key_env: str | None = None
    kind: str = "chat"
    timeout: int = 120
    max_tokens: int | None = None
    headers: dict[str, str] = field(default_factory=dict)

    def key(self) -> str | None:
        key = os.environ.get(self.key_env) if self.key_env else "none"
        if self.key_env and not key:
            raise ValueError(f"set {self.key_env} to use {self.name}")
        return key


# Public addresses, default models and limits of known services.
BACKENDS = {
    "openai": Backend("openai", "https://api.openai.com/v1", "gpt-4o-mini", "OPENAI_API_KEY"),
    "groq": Backend("groq", "https://api.groq.com/openai/v1", "llama-3.3-70b-versatile", "GROQ_API_KEY"),
    "ollama": Backend("ollama", "http://localhost:11434/v1", "qwen2.5:7b", None, timeout=300),
    "claude": Backend("claude", "https://api.anthropic.com/v1", "claude-3-5-haiku-latest", "ANTHROPIC_API_KEY", kind="messages", max_tokens=4096, headers={"anthropic-version": "2023-06-01"}),
}


# Short names of hosted models.
MODEL_ALIASES = {"haiku": "claude-haiku-4-5-20251001", "sonnet": "claude-sonnet-4-6", "opus": "claude-opus-4-6"}


def compatible(base_url: str, model: str, key_env: str | None = None, timeout: int = 120) -> Backend:
    """Any service that speaks the chat format."""
    return Backend("compatible", base_url, model, key_env, timeout=timeout)


def post(url: str, body: dict, headers: dict[str, str], timeout: int) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


Send = Callable[[str, dict, dict[str, str], int], dict]


def call(backend: Backend, messages: list[dict[str, str]], max_tokens: int | None = None, send: Send = post) -> Reply:
    """One request; the finish reason is ``stop`` for a whole reply and ``length`` for a cut one."""
    body: dict = {"model": backend.model, "messages": messages, "temperature": 0.0}
    limit = max_tokens or backend.max_tokens
    if limit:
        body["max_tokens"] = limit
    key = backend.key()
    if backend.kind == "messages":
        answer = send(f"{backend.base_url}/messages", body, {"x-api-key": key or "", **backend.headers}, backend.timeout)
        text = "".join(part.get("text", "") for part in answer["content"] if part.get("type") == "text")
        return Reply(text.strip(), "stop" if answer.get("stop_reason") == "end_turn" else "length")
    answer = send(f"{backend.base_url}/chat/completions", body, {"Authorization": f"Bearer {key}", **backend.headers}, backend.timeout)
    choice = answer["choices"][0]
    return Reply((choice["message"].get("content") or "").strip(), "stop" if choice.get("finish_reason") == "stop" else "length")


async def gather_capped(jobs: Sequence[Callable[[], Awaitable]], limit: int | None = None) -> list:
    """Results in the order of the jobs, at most ``limit`` at a time; the first failure is raised."""
    gate = asyncio.Semaphore(limit) if limit else None

    async def one(job: Callable[[], Awaitable]):
        if gate is None:
            return await job()
        async with gate:
            return await job()

    return await asyncio.gather(*(one(job) for job in jobs))


class HttpCompleter(Completer):
    """Calls a backend for every distinct request.

    Each partition keeps at most ``inflight`` calls open, so the whole cluster keeps at most that
    times the running tasks; ``partitions=1`` makes it the cap of the whole job. Without ``inflight``
    the cap comes from the settings of the builder that uses it. Failures become rows with ``status``
    ``error``; tasks do not fail.
    """

    def __init__(self, backend: Backend, inflight: int | None = None, retries: int = 10, delay: float = 1.0, partitions: int | None = None, send: Send = post) -> None:
        self.backend, self.inflight, self.retries, self.delay, self.partitions, self.send = backend, inflight, retries, delay, partitions, send
        self.name = backend.name

    def capped(self, limit: int | None) -> HttpCompleter:
        if self.inflight is not None or limit is None:
            return self
        return HttpCompleter(self.backend, limit, self.retries, self.delay, self.partitions, self.send)

    def ask(self) -> Ask:
        backend, retries, delay, send = self.backend, self.retries, self.delay, self.send

        def one(stage: str, prompt: str, inputs: dict[str, str]) -> str:
            return with_continuation(lambda m, n: call(backend, m, n, send), prompt, backend.name, retries=retries, delay=delay).text

        return one

    def complete(self, requests: DataFrame) -> DataFrame:
        backend, inflight, retries, delay, send = self.backend, self.inflight, self.retries, self.delay, self.send

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def ask(prompt: str) -> tuple[str | None, str | None, str, str | None]:
                try:
                    reply = with_continuation(lambda m, n: call(backend, m, n, send), prompt, backend.name, retries=retries, delay=delay)
                    return reply.text.encode("utf-8", "replace").decode(), reply.finish_reason, "ok", None
                except Exception as error:
                    return None, None, "error", f"{type(error).__name__}: {error}"

            async def all_of(prompts: list[str]) -> list:
                return await gather_capped([lambda p=p: asyncio.to_thread(ask, p) for p in prompts], inflight)

            for batch in batches:
                replies = asyncio.run(all_of(batch["prompt"].tolist()))
                rows = [(key, *reply) for key, reply in zip(batch["req_id"], replies)]
                yield pd.DataFrame(rows, columns=["req_id", "text", "finish_reason", "status", "error"])

        once = requests.select("req_id", "prompt").dropDuplicates(["req_id"])
        return (once.repartition(self.partitions) if self.partitions else once).mapInPandas(run, COMPLETIONS)


_LOCAL: dict[tuple[str, bool], Callable[[list[dict[str, str]]], str]] = {}


def local_model(path: str, max_new_tokens: int = 2048, four_bit: bool = True) -> Callable[[list[dict[str, str]]], Reply]:
    """A fine-tuned model on this worker's device, loaded once per process; needs an optional library."""

    def load() -> Callable[[list[dict[str, str]]], str]:
        try:
            from transformers import pipeline
        except ImportError as error:
            raise ImportError("a local model needs the transformers library") from error
        options: dict = {}
        if four_bit:
            from transformers import BitsAndBytesConfig

            options = {"device_map": "auto", "model_kwargs": {"quantization_config": BitsAndBytesConfig(load_in_4bit=True)}}
        generate = pipeline("text-generation", model=path, **options)

        def text_of(messages: list[dict[str, str]]) -> str:
            text = generate(messages, max_new_tokens=max_new_tokens, do_sample=False)[0]["generated_text"]
            return text if isinstance(text, str) else text[-1]["content"]

        return text_of

    def ask(messages: list[dict[str, str]]) -> Reply:
        if (path, four_bit) not in _LOCAL:
            _LOCAL[path, four_bit] = load()
        return Reply(_LOCAL[path, four_bit](messages), "stop")

    return ask


class LocalCompleter(Completer):
    """A model that runs inside the Python workers, one request after the other in each.

    ``generate`` is any picklable function of messages, ``local_model(path)`` for one on disk. A
    failure is a row with ``status`` ``error``.
    """

    name = "local"

    def __init__(self, generate: Callable[[list[dict[str, str]]], Reply]) -> None:
        self.generate = generate

    def ask(self) -> Ask:
        generate = self.generate
        return lambda stage, prompt, inputs: generate([{"role": "user", "content": prompt}]).text

    def complete(self, requests: DataFrame) -> DataFrame:
        generate = self.generate

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for key, prompt in zip(batch["req_id"], batch["prompt"]):
                    try:
                        reply = generate([{"role": "user", "content": prompt}])
                        rows.append((key, reply.text, reply.finish_reason, "ok", None))
                    except Exception as error:
                        rows.append((key, None, None, "error", f"{type(error).__name__}: {error}"))
                yield pd.DataFrame(rows, columns=["req_id", "text", "finish_reason", "status", "error"])

        return requests.select("req_id", "prompt").dropDuplicates(["req_id"]).mapInPandas(run, COMPLETIONS)


def models_of(backend: Backend, send_get: Callable[[str], dict] | None = None) -> list[str]:
    """Names of the models a local server holds."""
    url = backend.base_url.removesuffix("/v1") + "/api/tags"
    if send_get is None:
        with urllib.request.urlopen(url, timeout=backend.timeout) as answer:
            found = json.load(answer)
    else:
        found = send_get(url)
    return [m["name"] for m in found.get("models", [])]


def is_available(backend: Backend, send_get: Callable[[str], dict] | None = None) -> bool:
    """Whether the local server holds the backend's model."""
    try:
        return any(backend.model in name for name in models_of(backend, send_get))
    except OSError:
        return False


def with_model(name: str, model: str) -> Backend:
    """A known backend with another model, which may be a short name of ``MODEL_ALIASES``."""
    return replace(BACKENDS[name], model=MODEL_ALIASES.get(model, model) if name == "claude" else model)
