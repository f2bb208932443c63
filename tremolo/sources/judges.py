"""Judges behind providers' clients: which arguments a call takes, how a client is made, how often it may be asked.

A provider's package is imported where a client is made, so none is needed to read or score logs.
"""

from __future__ import annotations

import importlib
import os
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from tremolo.functions import fixed

Judge = Callable[[str], str]


@dataclass(frozen=True)
class Spec:
    """A judge of the registry."""

    name: str
    provider: str
    model_id: str
    key: str
    max_tokens: int
    cost_per_1k: float

    @property
    def pause(self) -> float:
        """Seconds between two calls."""
        return fixed.RATE_LIMITS.get(self.provider, fixed.DEFAULT_RATE)


REGISTRY = {name: Spec(name, provider, model_id, key, tokens, cost) for name, provider, model_id, key, tokens, cost, _ in fixed.JUDGES}


def spec(name: str) -> Spec:
    """The judge of a name or of a short name that the study also uses."""
    found = REGISTRY.get(fixed.ALIASES.get(name.lower(), name))
    if found is None:
        raise ValueError(f"unknown judge {name}; known are {', '.join(REGISTRY)}")
    return found


def token_argument(model_id: str) -> str:
    """The name under which a chat endpoint takes the limit of tokens."""
    return "max_completion_tokens" if model_id.lower().startswith(fixed.COMPLETION_TOKEN_IDS) else "max_tokens"


def chat_arguments(model_id: str, prompt: str, max_tokens: int, system: str | None = fixed.SYSTEM_PROMPT, temperature: float | None = 0.0) -> dict:
    """Arguments of a chat completion; ids that take no temperature get none."""
    said = [{"role": "system", "content": system}] if system else []
    out = {"model": model_id, "messages": [*said, {"role": "user", "content": prompt}], token_argument(model_id): max_tokens}
    if temperature is not None and not model_id.lower().startswith(fixed.NO_TEMPERATURE_IDS):
        out["temperature"] = temperature
    return out


def _chat(client, s: Spec) -> Judge:
    return lambda p: client.chat.completions.create(**chat_arguments(s.model_id, p, s.max_tokens), timeout=fixed.TIMEOUT).choices[0].message.content or ""


def _openai(s: Spec, key: str) -> Judge:
    where = {"novita": fixed.NOVITA_URL, "dashscope": os.environ.get("DASHSCOPE_BASE_URL", fixed.DASHSCOPE_URL)}
    return _chat(importlib.import_module("openai").OpenAI(api_key=key, base_url=where.get(s.provider)), s)


def _messages(s: Spec, key: str) -> Judge:
    client = importlib.import_module("anthropic").Anthropic(api_key=key)
    ask = lambda p: client.messages.create(model=s.model_id, max_tokens=s.max_tokens, system=fixed.SYSTEM_PROMPT, messages=[{"role": "user", "content": p}])
    return lambda p: ask(p).content[0].text


def _google(s: Spec, key: str) -> Judge:
    genai = importlib.import_module("google.genai")
    client = genai.Client(api_key=key)
    how = genai.types.GenerateContentConfig(max_output_tokens=s.max_tokens, temperature=0.0, thinking_config=genai.types.ThinkingConfig(thinking_budget=0))
    return lambda p: client.models.generate_content(model=s.model_id, contents=p, config=how).text


def _hub(s: Spec, key: str) -> Judge:
    client = importlib.import_module("huggingface_hub").InferenceClient(api_key=key)
    return lambda p: client.chat.completions.create(**chat_arguments(s.model_id, p, s.max_tokens, None, 0.01)).choices[0].message.content


def _mistral(s: Spec, key: str) -> Judge:
    client = importlib.import_module("mistralai").Mistral(api_key=key)
    return lambda p: client.chat.complete(**chat_arguments(s.model_id, p, s.max_tokens, None)).choices[0].message.content


PROVIDERS = {"openai": _openai, "novita": _openai, "dashscope": _openai, "anthropic": _messages, "google": _google, "huggingface": _hub, "mistral": _mistral}


def unpaced(name: str) -> Callable[[], Judge]:
    """maker without a pause: for callers that pace all tasks of a provider together."""
    return maker(name, paced=False)


def maker(name: str, paced: bool = True, sleep: Callable[[float], None] = time.sleep) -> Callable[[], Judge]:
    """A function that makes the judge in a task. The key is read here, on the driver; without it there is no judge (RuntimeError)."""
    s = spec(name)
    key = os.environ.get(s.key, "")
    if not key:
        raise RuntimeError(f"{name} needs the environment variable {s.key}")

    def make() -> Judge:
        ask = PROVIDERS[s.provider](s, key)
        return stripped(ask, s.pause if paced else 0.0, sleep)

    return make


def stripped(ask: Judge, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Judge:
    """ask without white space around its answers, and with a pause after each call, also a failed one."""

    def judge(prompt: str) -> str:
        try:
            return ask(prompt).strip()
        finally:
            if pause:
                sleep(pause)

    return judge


class Pace:
    """Lets a call begin every ``gap`` seconds at most, whichever thread asks."""

    def __init__(self, gap: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = gap, clock, sleep
        self.free, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = self.clock()
            begin = max(now, self.free)
            self.free = begin + self.gap
        if begin > now:
            self.sleep(begin - now)

    def judge(self, ask: Judge) -> Judge:
        """ask, whose calls keep this pace, repeated ones too."""

        def paced(prompt: str) -> str:
            self.wait()
            return ask(prompt)

        return paced


def in_flight(items: Iterable, work: Callable, most: int) -> Iterator:
    """work(item) of each item in order, at most ``most`` of them begun and not yet given back."""
    if most <= 1:
        yield from map(work, items)
        return
    with ThreadPoolExecutor(most) as pool:
        begun: deque = deque()
        for item in items:
            if len(begun) == most:
                yield begun.popleft().result()
            begun.append(pool.submit(work, item))
        while begun:
            yield begun.popleft().result()
