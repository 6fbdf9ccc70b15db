from .apply import apply_row_state, score_stream, write_stream  # noqa: F401
