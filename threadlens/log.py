"""Logging to the console and, if asked, to a file on the driver."""

from __future__ import annotations

import logging

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def get_logger(name: str, path: str | None = None) -> logging.Logger:
    """A logger with one console handler and at most one handler for each file."""
    logger = logging.getLogger(name)
    logger.setLevel(logging.INFO)
    if not any(type(h) is logging.StreamHandler for h in logger.handlers):
        logger.addHandler(logging.StreamHandler())
    if path and not any(getattr(h, "baseFilename", None) == path for h in logger.handlers):
        logger.addHandler(logging.FileHandler(path))
    for handler in logger.handlers:
        handler.setFormatter(logging.Formatter(FORMAT))
    return logger
