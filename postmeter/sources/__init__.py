"""Where posts come from and where cleaned posts are kept."""

from .csv_posts import read_posts_csv, stream_posts_csv
from .events import event_posts
from .tables import drop_table, keep_clean, read_clean, shared_dir, write_clean

__all__ = [
    "drop_table",
    "event_posts",
    "keep_clean",
    "read_clean",
    "read_posts_csv",
    "shared_dir",
    "stream_posts_csv",
    "write_clean",
]
