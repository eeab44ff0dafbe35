"""Importing this package registers every query."""

from canopyframe.plans.queries import clouds, images, landscape, records, trees  # noqa: F401
from canopyframe.plans.queries import tiles  # noqa: F401  (repeats queries of the others)
