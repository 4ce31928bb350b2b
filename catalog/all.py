"""Importing this module registers every query."""

from . import q_bills  # noqa: F401
from . import q_series  # noqa: F401
from . import q_quality  # noqa: F401
from . import q_sources  # noqa: F401
from . import q_model  # noqa: F401
from . import q_eval  # noqa: F401
from . import q_projection  # noqa: F401
from . import q_parts  # noqa: F401
from . import q_fit  # noqa: F401
