"""flowsieve: network-flow analytics on Spark SQL.

Every public operator is a ``DataFrame -> DataFrame`` function (or a small
fit step that returns a dataclass of numbers) built from Spark SQL
expressions, so its work is planned by Catalyst and runs on executors.
"""

from flowsieve.session import get_session, work_dir

__all__ = ["get_session", "work_dir"]
