"""panelcast: station-panel cleaning, imputation, forecasting and backtesting on PySpark."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

from panelcast.spec import PanelSpec

# Grouped-pandas helpers travel to the workers with the job, so no --py-files is needed.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["PanelSpec"]
