from .results import block_lines, read_result, result_lines, typed, write_blocks, write_dump, write_result_text
from .store import keep, release, shared_folder
from .traces import decode_events, read_lines, relative_time, trace_starts
