"""linkloom: post / title-corpus analytics on Spark DataFrames.

Everything here is plain DataFrame, SQL, Spark ML and Structured Streaming
code: functions take and return DataFrames (or Columns), keep no global state
and never loop over collected rows on the driver.
"""

from linkloom.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
