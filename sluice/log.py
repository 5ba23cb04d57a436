"""Logging of the library: silent unless asked for, in plain text or as JSON.

``LOG_LEVEL``, ``LOG_FORMAT`` and ``LOG_OUTPUT`` of the environment win over the
settings, so that a deployment is tuned without touching code.
"""

from __future__ import annotations

import json
import logging
import os
import sys
from logging.handlers import RotatingFileHandler
from pathlib import Path

from .config import Settings

#: Bytes of a log file, and how many older ones are kept.
FILE_BYTES, FILES = 10_000_000, 7


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S%z"), "level": record.levelname, "logger": record.name, "message": record.getMessage()})


def set_up(settings: Settings, own_handlers: bool = True) -> logging.Logger:
    """The library's logger; set up anew, without what an earlier call added.

    With ``own_handlers=False`` records go to the handlers of the application only.  A log file that cannot be
    written is said on the console and stops nothing.
    """
    log = logging.getLogger("sluice")
    for handler in list(log.handlers):
        log.removeHandler(handler)
        handler.close()
    if not settings.enable_logging:
        log.addHandler(logging.NullHandler())
        log.propagate = False
        return log
    log.setLevel(os.environ.get("LOG_LEVEL", settings.log_level).upper())
    log.propagate = not own_handlers
    if not own_handlers:
        return log
    as_json = (os.environ.get("LOG_FORMAT") or settings.log_format).lower() == "json"
    formatter = JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(message)s", "%Y-%m-%dT%H:%M:%S%z")
    console = logging.StreamHandler(sys.stdout if os.environ.get("LOG_OUTPUT") == "stdout" else sys.stderr)
    handlers: list[logging.Handler] = [console]
    trouble = None
    if settings.log_file:
        try:
            Path(settings.log_file).parent.mkdir(parents=True, exist_ok=True)
            handlers = [RotatingFileHandler(settings.log_file, maxBytes=FILE_BYTES, backupCount=FILES, encoding="utf-8")]
        except OSError as error:
            trouble = error
    for handler in handlers:
        handler.setFormatter(formatter)
        log.addHandler(handler)
    if trouble is not None:
        log.warning("no log file %s: %s", settings.log_file, trouble)
    return log
