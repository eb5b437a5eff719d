"""All registered queries."""

from . import windows  # noqa: F401
from . import segments  # noqa: F401
from . import sequences  # noqa: F401
from . import learning  # noqa: F401
from . import io  # noqa: F401
from .registry import QUERIES, oracle, run_query  # noqa: F401
