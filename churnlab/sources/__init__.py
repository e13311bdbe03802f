"""Event sources and result sinks."""

from churnlab.sources.events import choose_event_path, load_events, read_json_events, to_events
from churnlab.sources.sinks import land_events_by_date, load_cv_model, model_path, read_metrics, save_model, write_table

__all__ = [
    "choose_event_path",
    "land_events_by_date",
    "load_cv_model",
    "load_events",
    "model_path",
    "read_json_events",
    "read_metrics",
    "save_model",
    "to_events",
    "write_table",
]
