"""Every registered query of the engine proper, with its SQL."""

from krylake.plans import extensions, fields, kernels, reaches, readings, relational, semi, shapes, solvers, spatial, state, stores, streams, trees  # noqa: F401  they register
from krylake.plans.registry import ORACLES, QUERIES  # noqa: F401
