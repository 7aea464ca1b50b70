"""Progress of a run on the driver: nested stages as events, learnt durations, and a log that a stream can read."""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Callable, Iterator

from chronoloom.sources.sinks import write_json_atomic

ALPHA = 0.3


class Durations:
    """What stages took, as exponential means by path; kept in a JSON file if one is named."""

    def __init__(self, path: str | None = None) -> None:
        self.path, self.means = path, {}
        if path and os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as f:
                    self.means = {str(k): float(v) for k, v in json.load(f).items()}
            except (ValueError, TypeError, AttributeError):
                self.means = {}  # a broken file only costs its estimates

    def learn(self, stage: str, seconds: float) -> None:
        known = self.means.get(stage)
        self.means[stage] = seconds if known is None else ALPHA * seconds + (1 - ALPHA) * known

    def left(self, stage: str, share: float = 0.0) -> float | None:
        known = self.means.get(stage)
        return None if known is None else known * (1 - share)

    def save(self) -> None:
        if self.path:
            write_json_atomic(self.path, self.means)


class Reporter:
    """Events of nested stages, each a start and, whatever happens inside, a complete.

    An event is a dict as ``progress.EVENT`` has them: kind, stage_path, progress, elapsed_s, ts, and also eta_s, summary,
    message. ``sinks`` take events; one that fails doesn't stop the run.
    """

    def __init__(self, *sinks: Callable[[dict], None], durations: Durations | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.sinks, self.durations, self.clock = sinks, durations or Durations(), clock
        self.open: list[dict] = []

    def _tell(self, kind: str, path: list[str], **more) -> None:
        event = {"kind": kind, "stage_path": path, "progress": None, "elapsed_s": None, "eta_s": None, "summary": None, "message": None, "ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **more}
        for sink in self.sinks:
            with contextlib.suppress(Exception):
                sink(event)

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[Reporter]:
        path = [*(s["name"] for s in self.open), name]
        own = {"name": name, "began": self.clock(), "summary": None}
        self.open.append(own)
        self._tell("start", path, eta_s=self.durations.left("/".join(path)))
        try:
            yield self
        finally:
            self.open.remove(own)
            took = self.clock() - own["began"]
            self.durations.learn("/".join(path), took)
            self._tell("complete", path, elapsed_s=took, summary=own["summary"])

    def progress(self, share: float, message: str | None = None) -> None:
        """How much of the innermost stage is done; outside every stage nothing is told."""
        if not self.open:
            return
        path, share, spent = [s["name"] for s in self.open], min(1.0, max(0.0, share)), self.clock() - self.open[-1]["began"]
        eta = self.durations.left("/".join(path), share)
        if eta is None and share > 0:
            eta = spent * (1 - share) / share
        self._tell("progress", path, progress=share, elapsed_s=spent, eta_s=eta, message=message)

    def message(self, text: str) -> None:
        """A status without a share."""
        if self.open:
            self._tell("progress", [s["name"] for s in self.open], message=text)

    def summary(self, text: str) -> None:
        """What the innermost stage's complete event will say."""
        if self.open:
            self.open[-1]["summary"] = text


def append_to(path: str) -> Callable[[dict], None]:
    """A sink: one line of JSON per event at the end of a file, for other programs (or ``spark.read.json``) to follow."""

    def sink(event: dict) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(event, ensure_ascii=False) + "\n")

    return sink
