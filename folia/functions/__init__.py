"""Column functions: row-local steps of document layout analysis."""

from .geometry import *  # noqa: F403
from .text import *  # noqa: F403
