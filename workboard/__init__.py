"""workboard: task and project analytics as Spark jobs.

Every public function maps DataFrames to a lazy DataFrame (or a ChangeSet of
them); Catalyst plans it and AQE runs it.

* ``workboard.plans.reports``  status summary, per-project completion,
  productivity ranking, task details, overdue tasks, dashboard totals
* ``workboard.plans.views``    task / project / user views and pages
* ``workboard.plans.changes``  change sets: requests + snapshots -> new
  snapshot, accepted, rejected (with reason), audit rows
* ``workboard.plans.audit``    audit capture, trail, overdue check, log lines
* ``workboard.plans.quality``  unique / foreign-key / domain violations
* ``workboard.plans.jobs``     change sets applied to stored tables
* ``workboard.streaming``      the audit drain (Structured Streaming)
* ``workboard.operators``      skew-safe keyed scan, histogram rank, salted
  joins, paging
* ``workboard.sources``        schemas, storage layout and sinks, test-data
  mapping
"""

__version__ = "0.1.0"
