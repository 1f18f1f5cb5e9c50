"""Models behind an interface: prompts in, answers out.  The default answers by rule, needs no network and is what tests
use; `from_settings` picks a served or an in-process model."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

SLACK = 5  # tokens below its limit at which an answer counts as cut off


class Truncated(ValueError):
    """The answer ran into its limit."""


class Provider:
    """Answers one prompt; made once in each Python worker."""

    def answer(self, prompt: str, max_tokens: int) -> str:
        raise NotImplementedError

    def free(self) -> None:
        """Give back what the model holds; called when a worker's prompts are done."""


class StubProvider(Provider):
    """Labels each numbered quotation with a member of the cast in the prompt, by turns, in the shapes that models
    answer in; a deterministic stand-in."""

    def answer(self, prompt: str, max_tokens: int) -> str:
        listed = prompt.partition("\n\n")[2].partition("\n\nSay of")[0]
        cast = re.findall(r"^(\S+) \| ", listed, re.MULTILINE) or ["unknown"]
        quotes: dict[str, object] = {}
        for number in map(int, re.findall(r'^\[Q(\d+)\] "', prompt, re.MULTILINE)):
            who = cast[number % len(cast)]
            shapes = (who, {"speaker": who, "emotion": "calm"}, {"speaker": {"id": who}, "emotion": ""})
            quotes[str(number)] = shapes[number % len(shapes)]
        return json.dumps({"quotes": quotes}, ensure_ascii=False)


class StubDesigner(Provider):
    """Describes a voice; of every three lengths of names one gets no answer and one an answer that breaks off."""

    def answer(self, prompt: str, max_tokens: int) -> str:
        name = re.search(r"^Character: (.*)$", prompt, re.MULTILINE).group(1)
        said = json.dumps(f"The voice of {name}", ensure_ascii=False)
        return ("I cannot say.", f'{{"instruct": {said}, "why": "as "they" say"}}', f'{{"instruct": {said}, "why": "x"}}')[len(name) % 3]


class StubNoter(Provider):
    """Notes one of seven readers by turns in each chapter."""

    def answer(self, prompt: str, max_tokens: int) -> str:
        n = int(re.search(r"^CHAPTER (\d+):$", prompt, re.MULTILINE).group(1))
        return json.dumps({"characters": [{"name": f"Reader {'ABCDEFG'[n % 7]}ora", "speaks": n % 2 == 0, "lines": f"{n} lines"}]})


@dataclass
class ServerProvider(Provider):
    """A chat server that speaks the usual JSON; an answer of status 507 is tried again, later each time."""

    url: str
    model: str
    api_key: str = ""
    retries: int = 6
    wait_s: float = 30.0
    timeout_s: float = 600.0
    extra: dict = field(default_factory=dict)

    def answer(self, prompt: str, max_tokens: int) -> str:
        asked = {"model": self.model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}], **self.extra}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        request = urllib.request.Request(self.url, json.dumps(asked).encode(), headers)
        got = self._sent(request)
        if got.get("usage", {}).get("completion_tokens", 0) >= max_tokens - SLACK:
            raise Truncated(f"an answer of {max_tokens} tokens")
        return got["choices"][0]["message"]["content"]

    def _sent(self, request: urllib.request.Request) -> dict:
        for tries_left in range(self.retries - 1, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout_s) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if e.code != 507 or not tries_left:
                    raise
            time.sleep(self.wait_s * (self.retries - tries_left))
        raise ValueError("no attempts")


@dataclass
class LocalProvider(Provider):
    """A model inside the worker's process, loaded at the first prompt.  load: a function from the model's name to one
    that answers (prompt, max_tokens, repetition_penalty) with a text and its number of tokens."""

    load: Callable[[str], Callable[[str, int, float], tuple[str, int]]]
    model: str
    repetition_penalty: float = 1.1
    _loaded: Callable | None = None

    def answer(self, prompt: str, max_tokens: int) -> str:
        if self._loaded is None:
            self._loaded = self.load(self.model)
        text, tokens = self._loaded(prompt, max_tokens, self.repetition_penalty)
        if tokens >= max_tokens - SLACK:
            raise Truncated(f"an answer of {max_tokens} tokens")
        return text

    def free(self) -> None:
        self._loaded = None


def from_settings(settings: Mapping, load: Callable | None = None) -> Callable[[], Provider]:
    """A maker of the provider that the settings name in llm_backend: "server", "local" (load: see LocalProvider), or
    "rule", the default."""
    kind = settings.get("llm_backend", "rule")
    if kind == "rule":
        return StubProvider
    if kind == "server":
        known = {k: settings[k] for k in ("api_key", "retries", "wait_s", "timeout_s") if k in settings}
        extra = {k: settings[k] for k in ("temperature",) if k in settings}
        return partial(ServerProvider, settings["llm_base_url"].rstrip("/") + "/chat/completions", settings["llm_model"], extra=extra, **known)
    if kind == "local":
        if load is None:
            raise ValueError("an in-process model needs a function that loads it")
        return partial(LocalProvider, load, settings["llm_model"], settings.get("repetition_penalty", 1.1))
    raise ValueError(f"unknown llm_backend {kind!r}")


# ---- what an answer must be ----


def json_object(raw: str) -> dict:
    """The JSON object in an answer, thoughts left out; ValueError if there is none that can be read."""
    bare = re.sub(r"(?s)<think>.*?</think>", "", raw)
    first, last = bare.find("{"), bare.rfind("}")
    if first < 0 or last < first:
        raise ValueError("no JSON object in the answer")
    return json.loads(bare[first : last + 1])


def any_object(raw: str) -> str:
    return json.dumps(json_object(raw), ensure_ascii=False)


def answered(provider: Provider, prompt: str, accept: Callable[[str], str], attempts: int, max_tokens: int) -> tuple[str | None, int, str | None]:
    """What is accepted of an answer, the attempts, and the last error.  A ValueError, Truncated among them, is tried
    again."""
    error = None
    for tried in range(1, attempts + 1):
        try:
            return accept(provider.answer(prompt, max_tokens)), tried, None
        except ValueError as e:
            error = f"{type(e).__name__}: {e}"
    return None, attempts, error


def ask(
    prompts: DataFrame, make: Callable[[], Provider] = StubProvider, keys: str | list[str] = "key", attempts: int = 3, max_tokens: int = 4096,
    accept: Callable[[str], str] = str,
) -> DataFrame:
    """(keys, raw, attempts, error) for prompts (keys, prompt); raw is what `accept` makes of the answer, null after the
    last attempt.  The retries are the provider's own: a task's would ask again for all prompts of a partition."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    kinds = ", ".join(f"{k} {prompts.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        try:
            for batch in batches:
                got = [answered(provider, p, accept, attempts, max_tokens) for p in batch["prompt"]]
                yield batch[keys].assign(**{c: [g[i] for g in got] for i, c in enumerate(("raw", "attempts", "error"))})
        finally:
            provider.free()

    return prompts.select(*keys, "prompt").mapInPandas(run, f"{kinds}, raw string, attempts int, error string")
