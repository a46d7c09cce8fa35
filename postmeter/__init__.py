"""Campaign post analytics on Spark."""

from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .plans import *  # noqa: F403
from .plans import __all__ as _plans
from .sources import *  # noqa: F403
from .sources import __all__ as _sources
from .streaming import *  # noqa: F403
from .streaming import __all__ as _streaming

__all__ = [*_operators, *_plans, *_sources, *_streaming]
