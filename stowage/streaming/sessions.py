"""Scan sessions: running, completed, cancelled or failed, on the driver (streaming/states.py has the same from events)."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

RUNNING, COMPLETED, CANCELLED, FAILED = "running", "completed", "cancelled", "failed"


class Cancelled(Exception):
    pass


class Sessions:
    """A registry of scans, each on a thread of its own under a Spark tag, so that its jobs can be interrupted."""

    def __init__(self, spark):
        self.spark, self.lock, self.sessions = spark, threading.Lock(), {}

    def start(self, work: Callable[[str, Callable[[dict], None], Callable[[], bool]], dict]) -> str:
        """work(scan_id, emit, cancelled) returns a report."""
        scan_id = uuid.uuid4().hex
        s = {"status": RUNNING, "report": None, "error": None, "events": [], "cancel": threading.Event()}
        with self.lock:
            self.sessions[scan_id] = s

        def emit(event: dict) -> None:
            if s["cancel"].is_set():
                raise Cancelled
            with self.lock:
                s["events"].append(event | {"seq": len(s["events"]) + 1, "scan_id": scan_id})

        def run() -> None:
            self.spark.addTag(scan_id)
            try:
                report = work(scan_id, emit, s["cancel"].is_set)
                s["report"], s["status"] = report, CANCELLED if s["cancel"].is_set() else COMPLETED
            except Exception as e:
                s["error"], s["status"] = (None, CANCELLED) if isinstance(e, Cancelled) or s["cancel"].is_set() else (str(e), FAILED)
            finally:
                self.spark.removeTag(scan_id)

        s["thread"] = threading.Thread(target=run, daemon=True)
        s["thread"].start()
        return scan_id

    def events(self, scan_id: str, from_seq: int = 0) -> list[dict]:
        with self.lock:
            return [e for e in self._of(scan_id)["events"] if e["seq"] > from_seq]

    def cancel(self, scan_id: str) -> bool:
        """Whether there was something to cancel."""
        s = self._of(scan_id)
        if s["status"] != RUNNING:
            return False
        s["cancel"].set()
        self.spark.interruptTag(scan_id)
        return True

    def get(self, scan_id: str) -> dict:
        s = self._of(scan_id)
        return {"scan_id": scan_id, "status": s["status"], "error": s["error"], "report": s["report"], "event_count": len(s["events"])}

    def wait(self, scan_id: str, seconds: float = 60) -> dict:
        self._of(scan_id)["thread"].join(seconds)
        return self.get(scan_id)

    def _of(self, scan_id: str) -> dict:
        if scan_id not in self.sessions:
            raise KeyError(f"no session {scan_id!r}")
        return self.sessions[scan_id]
