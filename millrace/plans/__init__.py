"""Named queries over the tables, and their SQL."""

from millrace.plans import analysis, extras, files, frames, images, more, outcomes, pages, reports, returns, runs, scores, sinks, stored, strategies, studies, texts, timing, tuning, validation, verdicts, weekly
from millrace.plans.registry import ORACLES, QUERIES
from millrace.streaming import queries as streams

__all__ = ["ORACLES", "QUERIES", "analysis", "extras", "files", "frames", "images", "more", "outcomes", "pages", "reports", "returns", "runs", "scores", "sinks", "stored", "strategies", "streams", "studies", "texts", "timing", "tuning", "validation", "verdicts", "weekly"]
