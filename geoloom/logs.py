"""Console and file logging; LOG_LEVEL names the level."""

from __future__ import annotations

import csv
import logging
import os
import sys


def logger(name: str, folder: str | None = None) -> logging.Logger:
    """A logger with one console handler and, given a folder, a file `<name>.log`; made once for each name."""
    log = logging.getLogger(f"geoloom.{name}")
    if not log.handlers:
        log.setLevel(os.environ.get("LOG_LEVEL", "INFO").upper())
        log.propagate = False
        targets: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
        if folder:
            os.makedirs(folder, exist_ok=True)
            targets.append(logging.FileHandler(os.path.join(folder, f"{name}.log"), encoding="utf-8"))
        for t in targets:
            t.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
            log.addHandler(t)
    return log


def append_row(path: str, row: dict[str, object]) -> None:
    """Adds a row to a CSV log of the driver; the header is written once, with the file."""
    new = not os.path.exists(path) or os.path.getsize(path) == 0
    with open(path, "a", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, list(row))
        if new:
            out.writeheader()
        out.writerow(row)
