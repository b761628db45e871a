"""Importing this module registers every query."""

from . import signal_queries  # noqa: F401
from . import spectral_queries  # noqa: F401
from . import graph_queries  # noqa: F401
from . import feature_queries  # noqa: F401
from . import transform_queries  # noqa: F401
from . import scoring_queries  # noqa: F401
from . import evaluate_queries  # noqa: F401
from . import stream_queries  # noqa: F401
