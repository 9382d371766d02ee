"""Customer-retention analytics on Spark.

Every operator is a DataFrame / Spark SQL / Spark ML transformation: the
library declares plans and Catalyst picks the physical strategy. Subpackages:

* ``functions`` - fixed values and Column expressions (no DataFrames)
* ``sources``   - scans of the driver tables, the customer fixture view, files, sinks
* ``operators`` - DataFrame -> DataFrame operators (features, encoding, split, CLV,
  scoring, metrics, explanations, SMOTE, Spark ML models)
* ``plans``     - end-to-end flows (batch pipeline, scoring, dashboard reports)
* ``streaming`` - the stateless scoring flow on a streaming source
"""

__version__ = "0.1.0"
