"""Readers, writers and the shared staging folder."""

from runsight.sources.commit_log import parse_actions, read_actions, read_checkpoints, select_tables
from runsight.sources.readers import read_event_log, read_json_dir, read_prompts
from runsight.sources.staging import recorded_staging, remove_staged, scratch_root, stage
from runsight.sources.writers import append_labelled, materialize, run_name

__all__ = [
    "append_labelled",
    "materialize",
    "parse_actions",
    "read_actions",
    "read_checkpoints",
    "read_event_log",
    "read_json_dir",
    "read_prompts",
    "recorded_staging",
    "remove_staged",
    "run_name",
    "scratch_root",
    "select_tables",
    "stage",
]
