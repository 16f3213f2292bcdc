"""Named end-to-end plans over the test tables; importing registers them all."""

from vocalframe.plans import arrays, folds, jobs, runs, scalars, scoring, sinks, splits  # noqa: F401
from vocalframe.plans.registry import OPS, ORACLES, QUERIES  # noqa: F401
