"""Change-history analytics on Spark DataFrames.

Tables of commits, file changes, merge requests, discussions and documents go
in; significance labels, chunks, ranked hits, symbol timelines and evaluation
reports come out.  Every public function takes and returns DataFrames.
"""

__version__ = "0.1.0"
