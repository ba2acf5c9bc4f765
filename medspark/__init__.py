"""medspark: medicines-activity analytics as Spark DataFrame operators.

Every public function takes DataFrames plus column names and returns a lazy
DataFrame; nothing is collected to the driver.  Sub-packages:

* ``functions``  - column expressions: missing-value rules (N1-N16), scalar
  helpers (title case, first-match replace, labels), the dose conversion.
* ``operators``  - relational building blocks: lookups, codelists, joins,
  windows, calendar filling, reshaping, profiling.
* ``sources``    - readers / writers (CSV, XML, parquet), materialisation and
  the mapping of the driver's test tables onto the domain.
* ``plans``      - composite reports and the query catalogue used by
  ``__spark_entry__``.
"""

from medspark.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
