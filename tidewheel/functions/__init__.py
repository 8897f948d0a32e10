"""The dialect's functions; importing the package registers them all."""

from . import datetime, json, network, numeric, session, spatial, strings  # noqa: F401
from .registry import FUNCTIONS, ArityError, Unsupported, call  # noqa: F401
