"""quarry: a Spark-native engine for code-and-text findings.

Files and tool reports are read as tables, cut into entities with exact line
ranges, scanned with data-driven rules; findings from many detectors are
unioned, de-duplicated, filtered and rolled up; entities are indexed for
vector, keyword and hybrid top-k retrieval; batches of work items advance
through set-based propose/review rounds with a pluggable scoring function.
"""

__version__ = "0.1.0"
