"""Text recognition as a plug-in: what a service must offer, how often it is asked again, and the converter for images.

No service is built in. A client is made inside each worker by the given factory, so nothing of it crosses the wire.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from corpusloom.sources.converters import Converter, Options, Result

# A service's error codes after which to wait and ask again, or to renew the token.
BUSY_CODES = (4, 17, 18, 19)
TOKEN_CODES = (110, 111)


class OcrError(Exception):
    """What a service answered instead of text; ``status`` is that of the transport, if it failed there."""

    def __init__(self, message: str, code: int | None = None, status: int | None = None):
        super().__init__(message)
        self.code, self.status = code, status

    @property
    def passing(self) -> bool:
        return self.code in BUSY_CODES or (self.status or 0) >= 500


class OcrClient(Protocol):
    engine: str

    def recognise(self, image: bytes) -> list[str]:
        """The lines of an image; raises OcrError, or OSError if the service can't be reached."""

    def renew_token(self) -> None: ...


@dataclass
class Patience:
    """At least ``interval`` seconds between calls of a worker; up to ``retries`` repetitions with growing pauses, at most 30 s."""

    retries: int = 3
    interval: float = 0.5
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    last: float = field(default=float("-inf"))

    def call(self, client: OcrClient, image: bytes) -> list[str]:
        for attempt in range(self.retries + 1):
            wait = self.last + self.interval - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                return client.recognise(image)
            except OcrError as e:
                if attempt == self.retries or not (e.passing or e.code in TOKEN_CODES):
                    raise
                if e.code in TOKEN_CODES:
                    client.renew_token()
                    continue
            except OSError:
                if attempt == self.retries:
                    raise
            self.sleep(min(2.0**attempt, 30.0))
        raise AssertionError("unreachable")


class TokenCache:
    """A token kept in a file until a day before it expires, per service key (only its hash is written)."""

    MARGIN = 86_400

    def __init__(self, path: str, key: str, clock: Callable[[], float] = time.time):
        self.path, self.name, self.clock = path, hashlib.sha1(key.encode()).hexdigest()[:8], clock

    def get(self) -> str | None:
        try:
            with open(self.path, encoding="utf-8") as f:
                kept = json.load(f).get(self.name) or {}
        except (OSError, ValueError):
            return None
        return kept.get("token") if kept.get("until", 0) - self.MARGIN > self.clock() else None

    def put(self, token: str, seconds: float) -> None:
        try:
            with open(self.path, encoding="utf-8") as f:
                kept = json.load(f)
        except (OSError, ValueError):
            kept = {}
        kept[self.name] = {"token": token, "until": self.clock() + seconds}
        with open(self.path + ".new", "w", encoding="utf-8") as f:
            json.dump(kept, f)
        os.replace(self.path + ".new", self.path)


def image_converter(make_client: Callable[[], OcrClient], patience: Patience | None = None) -> Converter:
    """A converter for the kind ``image``: recognised lines as text; too large images are skipped, refused ones have failed."""
    made: list[OcrClient] = []
    patience = patience or Patience()

    def convert(raw: bytes, name: str, o: Options) -> Result:
        if len(raw) > o.image_bytes:
            return Result("skipped", skip_reason=f"image of more than {o.image_bytes} bytes", extra={"size": len(raw)})
        if not made:
            made.append(make_client())
        began = patience.clock()
        try:
            lines = patience.call(made[0], raw)
        except OcrError as e:
            return Result("failed", error=str(e), extra={"ocr_error_code": e.code})
        text = "\n".join(lines)
        extra = {"size": len(raw), "ocr_chars": len(text), "ocr_elapsed": round(patience.clock() - began, 3), "ocr_engine": made[0].engine, "ocr_lines": len(lines)}
        return Result(markdown=f"```text\n{text}\n```\n", extra=extra)

    return convert
