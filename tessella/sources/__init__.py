"""Readers that give tables of the data model, writers of them, and synthetic data."""

from .readers import *  # noqa: F403
from .synthetic import *  # noqa: F403
from .writers import *  # noqa: F403
