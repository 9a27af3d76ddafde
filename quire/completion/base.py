"""The completion seam: a table of requests becomes a table of completions."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.completion.prompts import continue_reply


def req_id(provider: str, prompt: Column) -> Column:
    """The key of a request: the same prompt to the same provider is one request."""
    return F.sha2(F.concat(F.lit(provider + "\x1f"), prompt), 256)


class Completer(ABC):
    """Answers ``requests(req_id, doc_id, stage, key, prompt, inputs)``.

    Returns ``(req_id, text, finish_reason, status, error)``, one row per distinct ``req_id``.
    Callers write the result to a table before they use it twice: completions cost money and need
    not repeat themselves.
    """

    name = "base"

    @abstractmethod
    def complete(self, requests: DataFrame) -> DataFrame: ...

    def ask(self) -> Ask:
        """The same model as a function ``(stage, prompt, inputs)``, for stages that build on their own replies."""
        name = self.name

        def none(stage: str, prompt: str, inputs: dict[str, str]) -> str:
            raise NotImplementedError(f"{name} answers no sequential stage ({stage})")

        return none

    def capped(self, limit: int | None) -> Completer:
        """This completer with at most ``limit`` calls open at once, where it makes calls and has no cap of its own."""
        return self


@dataclass(frozen=True)
class Reply:
    text: str
    finish_reason: str


Ask = Callable[[str, str, dict[str, str]], str]
Call = Callable[[list[dict[str, str]], int | None], Reply]


def with_retry(call: Call, messages: list[dict[str, str]], name: str, max_tokens: int | None = None, retries: int = 10, delay: float = 1.0) -> Reply:
    """The reply of one call, tried up to ``retries`` times with a constant pause between tries."""
    for attempt in range(retries):
        try:
            return call(messages, max_tokens)
        except Exception as error:
            if attempt + 1 == retries:
                raise RuntimeError(f"[{name}] Failed after {retries} attempts: {type(error).__name__}: {error}") from error
            time.sleep(delay)
    raise RuntimeError(f"[{name}] no attempt allowed")


def with_continuation(
    call: Call, prompt: str, name: str, max_continuations: int = 5, retries: int = 10, delay: float = 1.0, max_tokens: int | None = None
) -> Reply:
    """A whole reply: one that was cut off is asked to go on, up to ``max_continuations`` times."""
    reply = with_retry(call, [{"role": "user", "content": prompt}], name, max_tokens, retries, delay)
    text = reply.text
    for _ in range(max_continuations):
        if reply.finish_reason == "stop":
            break
        history = [
            {"role": "user", "content": prompt}, {"role": "assistant", "content": text}, {"role": "user", "content": continue_reply()}
        ]
        reply = with_retry(call, history, name, max_tokens, retries, delay)
        text += reply.text
    return Reply(text, reply.finish_reason)
