"""The stateless operators applied to a stream of notes.

The reference has no streaming source; its per-row operators (filters, text cleaning,
date parsing, joins against static tables, label encoding) accept a streaming
DataFrame unchanged.  ``on_files`` applies any of them to a file-source stream,
``clean_note_stream`` the cleaning chain; ``write_stream`` is an exactly-once Parquet sink.
"""

from clinloom.streaming.notes import clean_note_stream, on_files, write_stream

__all__ = ["clean_note_stream", "on_files", "write_stream"]
