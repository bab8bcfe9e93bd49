"""The 51 checks of a table; importing this package fills ``CHECKS``."""

from . import cells, columns, records  # noqa: F401
from .registry import CHECKS  # noqa: F401
