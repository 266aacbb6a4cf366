"""All registered queries; importing this module fills the registry."""

from skyquilt.workload import end_to_end, evaluation, raster, refinement, sequence, sources, streams, training  # noqa: F401
from skyquilt.workload.registry import ORACLES, QUERIES  # noqa: F401
