"""Models behind HTTP services: embeddings and chat, called from tasks with batches of texts.

A service is named by its address; keys come from an environment variable of the workers, so that no plan
holds them.  Refusals for load (429), failures of the service (5xx) and broken connections are tried
again after a growing pause; other refusals and replies of another form fail at once.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.sources.embeddings import Embed

Chat = Callable[[str], str]


class ServiceError(RuntimeError):
    """A model's service refused, or gave a reply of another form."""


def post(address: str, body: dict, *, key_variable: str | None = None, timeout: float = 60.0, tries: int = 4, pause: float = 1.0) -> dict:
    """The service's JSON reply."""
    headers = {"Content-Type": "application/json"}
    if key_variable and (key := os.environ.get(key_variable)):
        headers["Authorization"] = f"Bearer {key}"
    asked = urllib.request.Request(address, json.dumps(body).encode(), headers)
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as error:
            if not left or not (error.code == 429 or error.code >= 500):
                raise ServiceError(f"{address}: status {error.code}") from error
        except (OSError, ValueError) as error:
            if not left:
                raise ServiceError(f"{address}: {error}") from error
        time.sleep(pause * 2 ** (tries - 1 - left))
    raise ServiceError(f"{address}: no try was allowed")


def http_embedding(address: str, model: str, *, dimensions: int | None = None, **options) -> Embed:
    """Vectors of a service that takes {model, input} and gives data[].embedding with its index, or embeddings."""
    body = {"model": model} | ({"dimensions": dimensions} if dimensions else {})

    def embed(texts: list[str]) -> list[list[float]]:
        reply = post(address, body | {"input": texts}, **options)
        if "data" in reply:
            found = [x["embedding"] for x in sorted(reply["data"], key=lambda x: x.get("index", 0))]
        else:
            found = reply.get("embeddings", [])
        if len(found) != len(texts):
            raise ServiceError(f"{address}: {len(found)} vectors for {len(texts)} texts")
        return found

    return embed


def http_chat(address: str, model: str, *, system: str | None = None, temperature: float = 0.0, max_tokens: int = 1024, image: tuple[bytes, str] | None = None, **options) -> Chat:
    """Replies of a service that takes {model, messages} and gives choices[].message or one message; ``image`` is (content, mime type)."""
    first = [{"role": "system", "content": system}] if system else []

    def chat(prompt: str) -> str:
        content: object = prompt
        if image:
            data = f"data:{image[1]};base64,{base64.b64encode(image[0]).decode()}"
            content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": data}}]
        body = {"model": model, "messages": [*first, {"role": "user", "content": content}], "temperature": temperature, "max_tokens": max_tokens, "stream": False}
        reply = post(address, body, **options)
        message = reply["choices"][0].get("message") if reply.get("choices") else reply.get("message")
        if not isinstance(message, dict) or not isinstance(message.get("content"), str):
            raise ServiceError(f"{address}: no message in the reply")
        return message["content"]

    return chat


def replies(prompt: Column, chat: Chat) -> Column:
    """A reply to each prompt; null for a null or blank prompt, and where the service fails after its tries."""

    @F.pandas_udf("string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            if text is None or not text.strip():
                return None
            try:
                return chat(text)
            except ServiceError:
                return None

        for some in prompts:
            yield some.map(one, na_action=None).astype(object)

    return run(prompt)
