"""Imports every query module so the registry is complete."""

from postmill.plans import q_curate  # noqa: F401
from postmill.plans import q_countdown  # noqa: F401
from postmill.plans import q_preference  # noqa: F401
from postmill.plans import q_training  # noqa: F401
from postmill.plans import q_streaming  # noqa: F401
from postmill.plans import q_exchange  # noqa: F401
