"""Language models behind one protocol, and narratives that only stand if the guard lets them."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.recommend import guarded_narrative
from quarrylight.sources.adapters import optional

PROVIDERS = ("litellm", "langchain")


class LanguageModel(Protocol):
    def complete(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class Settings:
    """How to reach a provider; the key itself is read from the environment only when it is called."""

    provider: str
    model: str
    key_variable: str = ""
    base: str = ""
    timeout: float | None = None
    temperature: float | None = None
    max_tokens: int | None = None

    def __post_init__(self) -> None:
        if self.provider not in PROVIDERS:
            raise ValueError(f"unsupported provider: {self.provider}")
        if not self.model:
            raise ValueError("a model is required")

    @classmethod
    def of(cls, env: Mapping[str, str], prefix: str) -> Settings:
        get = lambda name: env.get(f"{prefix}{name}", "").strip()
        number = lambda name, kind: kind(get(name)) if get(name) else None
        return cls(get("PROVIDER").lower(), get("MODEL"), get("API_KEY_ENV"), get("API_BASE"), number("TIMEOUT_SECONDS", float), number("TEMPERATURE", float), number("MAX_TOKENS", int))

    def arguments(self) -> dict[str, object]:
        found = {"model": self.model, "api_base": self.base, "timeout": self.timeout, "temperature": self.temperature, "max_tokens": self.max_tokens}
        key = os.environ.get(self.key_variable, "") if self.key_variable else ""
        return {k: v for k, v in (found | {"api_key": key}).items() if v not in (None, "")}


@dataclass(frozen=True)
class Provided:
    """A provider's model by its public library; `call` stands in for the library in tests."""

    settings: Settings
    call: Callable[..., object] | None = None

    def complete(self, prompt: str) -> str:
        if self.settings.provider == "litellm":
            call = self.call or optional("litellm", "completion")
            if call is None:
                raise RuntimeError("install litellm to use it")
            answer = call(messages=[{"role": "user", "content": prompt}], **self.settings.arguments())
            return answer["choices"][0]["message"]["content"]
        call = self.call or optional("langchain.chat_models", "init_chat_model")
        if call is None:
            raise RuntimeError("install langchain to use it")
        answer = call(**self.settings.arguments()).invoke(prompt)
        return getattr(answer, "content", answer)


@dataclass(frozen=True)
class Scripted:
    """A model for tests: the same answer, or one made of the prompt."""

    answer: str | Callable[[str], str]

    def complete(self, prompt: str) -> str:
        return self.answer(prompt) if callable(self.answer) else self.answer


def narratives(briefings: DataFrame, model: LanguageModel) -> DataFrame:
    """briefings (prompt, fallback, ...) with content (null where the model failed), error, and narrative: the content if the guard
    lets it stand, else the fallback."""
    kept = briefings.schema.fields

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = []
            for prompt in frame["prompt"]:
                try:
                    said.append((model.complete(prompt or ""), None))
                except Exception as e:  # noqa: BLE001 - a model that fails leaves the fallback
                    said.append((None, type(e).__name__))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(said, columns=["content", "error"])], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    told = briefings.mapInPandas(run, f"{kinds}, content string, error string")
    return told.withColumn("narrative", F.coalesce(guarded_narrative(F.col("content"), F.col("prompt"), F.col("fallback")), "fallback"))
