"""Log records as JSON lines."""

from __future__ import annotations

import json
import logging
import sys


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        row = {"ts": self.formatTime(record), "lvl": record.levelname, "mod": record.name, "msg": record.getMessage()}
        if record.exc_info:
            row["error"] = self.formatException(record.exc_info)
        return json.dumps(row, ensure_ascii=False)


def logger(name: str, stream=None) -> logging.Logger:
    """A logger that writes one JSON object a line; asked for again, the same."""
    out = logging.getLogger(name)
    if not out.handlers:
        handler = logging.StreamHandler(stream or sys.stdout)
        handler.setFormatter(JsonFormatter())
        out.addHandler(handler)
        out.setLevel(logging.INFO)
        out.propagate = False
    return out
