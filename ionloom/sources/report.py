"""What a tool tells besides its tables: a log file with a console, and a page with a histogram."""

from __future__ import annotations

import logging
from html import escape

from pyspark.sql import DataFrame


def tool_logger(name: str, path: str | None = None) -> logging.Logger:
    """A logger of a tool: everything goes to ``path`` (if given), information and above to the console."""
    log = logging.getLogger(f"ionloom.{name}")
    log.setLevel(logging.DEBUG)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    console = logging.StreamHandler()
    console.setLevel(logging.INFO)
    log.addHandler(console)
    if path is not None:
        file = logging.FileHandler(path, encoding="utf-8")
        file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(file)
    return log


def histogram_page(bins: DataFrame, centre: str, counts: list[str], title: str, most: int = 2000) -> str:
    """A page with a bar per bin and column of ``counts`` (targets and decoys, say). Over ``most`` bins are an error, as they reach the driver."""
    rows = bins.select(centre, *counts).orderBy(centre).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} bins")
    top = max((r[c] or 0 for r in rows for c in counts), default=0) or 1
    wide = 800 / max(1, len(rows))
    colours = ("#4477aa", "#ee6677", "#228833", "#ccbb44")
    bars = [
        f'<rect x="{i * wide + k * wide / len(counts):.2f}" y="{300 - 300 * (r[c] or 0) / top:.2f}" width="{wide / len(counts):.2f}" height="{300 * (r[c] or 0) / top:.2f}" fill="{colours[k % 4]}"><title>{escape(c)} at {r[centre]}: {r[c]}</title></rect>'
        for i, r in enumerate(rows)
        for k, c in enumerate(counts)
    ]
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><svg viewBox="0 0 800 300">{"".join(bars)}</svg></body></html>'


def write_page(bins: DataFrame, page: str, path: str, mode: str = "errorifexists") -> None:
    """The page as one text file under ``path``, in any store that Spark writes."""
    bins.sparkSession.createDataFrame([(page,)], "page string").coalesce(1).write.mode(mode).text(path)
