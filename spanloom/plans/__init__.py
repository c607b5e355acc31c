from .config import TraceConfig
from .pipeline import (
    base_events,
    context,
    diagnostics,
    dump_trace,
    keep,
    kept_context,
    open_traces,
    prepare,
    process_trace,
    run,
)
