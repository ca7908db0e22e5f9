"""eventlake — sparse timestamped multi-channel event analytics on PySpark.

Every public function takes and returns DataFrames; nothing collects rows to
the driver.  See README.md for the operator map.
"""

from eventlake.facade import EventLake

__all__ = ["EventLake"]
