"""Building and evaluating labelled sentence sets on Spark."""

from .api import collect_logs, convert_treebanks, filter_treebanks, probe_folder, probe_task
from .plans.build import build_filter_task, build_ud_tasks
from .plans.pattern import Pattern
from .session import get_session

__all__ = [
    "Pattern", "build_filter_task", "build_ud_tasks", "collect_logs", "convert_treebanks",
    "filter_treebanks", "get_session", "probe_folder", "probe_task",
]
