"""Every registered query of the analytics engine with its SQL twin."""

from incidence.plans.base import QUERIES, SQL  # noqa: F401
from incidence.plans import (  # noqa: F401  the modules register their queries
    boosted,
    bulletins,
    dashboards,
    endpoints,
    features,
    forecast,
    hotspots,
    learning,
    matching,
    operations,
    spatial,
    statistics,
    text,
    topics,
    training,
    tuning,
)

FLAGSHIP = "dangerous_roads"
