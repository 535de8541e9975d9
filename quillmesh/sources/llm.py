"""A chat-completions client for the injected ``chat(system, user)`` callables."""

from __future__ import annotations

import json
import os
import urllib.request
from dataclasses import dataclass


@dataclass(frozen=True)
class ChatClient:
    base_url: str
    model: str
    api_key: str
    timeout: float = 60.0
    temperature: float = 0.2
    max_tokens: int = 1200

    @property
    def url(self) -> str:
        """The completions address for a base that may end in a slash, in /v1 or in the address itself."""
        base = self.base_url.rstrip("/")
        if base.endswith("/chat/completions"):
            return base
        return f"{base}/chat/completions" if base.endswith("/v1") else f"{base}/v1/chat/completions"

    def request(self, system: str, user: str) -> urllib.request.Request:
        said = [dict(role=r, content=c) for r, c in (("system", system), ("user", user))]
        body = {"model": self.model, "messages": said, "temperature": self.temperature, "max_tokens": self.max_tokens}
        request = urllib.request.Request(self.url, json.dumps(body).encode())
        request.add_header("Authorization", f"Bearer {self.api_key}")
        request.add_header("Content-Type", "application/json")
        return request

    def __call__(self, system: str, user: str) -> str:
        with urllib.request.urlopen(self.request(system, user), timeout=self.timeout) as reply:
            return content_of(json.load(reply))


def content_of(reply: dict) -> str:
    try:
        found = reply["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError):
        found = None
    if not isinstance(found, str):
        raise ValueError("the reply has no text")
    return found


def default_client(prefix: str = "QUILL_LLM_") -> ChatClient | None:
    """From the environment; None without a key, and answers are then extractive."""
    key = os.environ.get(prefix + "API_KEY")
    if not key:
        return None
    get = lambda name, default: os.environ.get(prefix + name, default)
    return ChatClient(get("BASE_URL", "http://localhost:8080"), get("MODEL", "default"), key, float(get("TIMEOUT_S", "60")), float(get("TEMPERATURE", "0.2")), int(get("MAX_TOKENS", "1200")))
